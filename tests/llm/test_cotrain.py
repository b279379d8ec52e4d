import random

import numpy as np
import pyarrow as pa

from factspark.llm import cotrain, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(n, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = r.random() < 0.7, r.random() < 0.2
        words = [f"w{r.randint(0, 200)}" for _ in range(r.randint(20, 80))]
        if toxic:
            words[3] = words[11] = r.choice(["badword", "slurword"])
        if not good:
            words = [w + r.choice(["***", "###"]) for w in words]
        source = "farm" if not good and r.random() < 0.9 else f"site{r.randint(0, 5)}"
        docs.append((i, " ".join(words), r.choice(["en", "fr"]), source, None))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_exchange(spark):
    docs, labels = made(1500)
    df = spark.createDataFrame(docs, SCHEMA)
    model = cotrain.train(df, spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    assert model.heads["quality"].exchanged[0][0] > 100  # the text view taught the metadata view
    got = {r.doc_id: (r.p_quality >= 0.5, r.p_toxic >= 0.5) for r in cotrain.score(df, model).collect()}
    right = [np.mean([got[i][k] == bool(x[k]) for i, *x in labels[1000:]]) for k in (0, 1)]
    assert right[0] > 0.98 and right[1] > 0.97, right
    # the metadata view has learnt that the farm's pages are poor
    row, bucket = cotrain.metadata_features(["en", "en"], ["farm", "site1"], [300, 300])
    poor, fine = model.heads["quality"].meta.score(row, bucket, np.zeros((2, 0)), 2)
    assert poor < fine


def test_odd_rows(spark, tmp_path):
    docs, labels = made(300, 4)
    odd = [(None, None, None, None, None), (900, "", "en", None, 0), (901, None, None, "farm", None), (902, "badword " * 20_000, "en", "site1", 3), (0, "again", "en", "site1", 5)]
    df = spark.createDataFrame([(*x, "k") for x in docs + odd], SCHEMA + ", p_quality string")
    marks = spark.createDataFrame(labels[:200] + [(0, 1, None), (None, 1, 1), (12345, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op5_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.p_quality <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    kept = cotrain.keep_accepted(df, cotrain.train(df, marks))
    assert kept.columns == df.columns and kept.count() == sum(r.accepted for r in got)
    assert cotrain.score(df.limit(0), cotrain.train(df, marks)).collect() == []


def test_no_labels_and_labels_of_one_kind(spark):
    docs, labels = made(120, 6)
    df = spark.createDataFrame(docs, SCHEMA)
    schema = "doc_id long, quality int, toxic int"
    none = cotrain.train(df, spark.createDataFrame([], schema))
    assert {(r.p_quality, r.p_toxic) for r in cotrain.score(df, none).collect()} == {(0.5, 0.5)}
    assert cotrain.keep_accepted(df, none).count() == 120
    one = cotrain.train(df, spark.createDataFrame([(i, q, 0) for i, q, _ in labels[:98]], schema))
    assert {r.p_toxic for r in cotrain.score(df, one).collect()} == {0.01}
    assert len({r.p_quality for r in cotrain.score(df, one).collect()}) > 10
    empty = cotrain.train(df.limit(0), spark.createDataFrame(labels, schema))
    assert cotrain.keep_accepted(df.limit(0), empty).collect() == []


def test_evidence_is_brute_force(spark):
    """Counts of pseudo-labels over all unlabelled documents, whatever the partitions, are those of a plain loop."""
    docs, labels = made(400, 7)
    df = spark.createDataFrame([d for d in docs], SCHEMA)
    features = cotrain._features(df)
    table = features.toArrow().combine_chunks()
    text, meta = cotrain._unpacked(table)
    ids = np.arange(100)
    y = np.array([labels[i][1] if i < 100 else -1 for i in table["doc_id"].to_pylist()])
    views = {"quality": cotrain.fit_views(text, meta, y)}
    got = cotrain._all_counts(features.repartition(5), views, ids, 0.9)["quality"]
    p = [cotrain._sigmoid(v.score(*x, len(y))) for v, x in zip(views["quality"], (text, (*meta, np.zeros((len(y), 0)))))]
    for me, other, (row, bucket), shift in ((0, 1, text[:2], 4), (1, 0, meta, 0)):
        want = np.zeros_like(got[me])
        for i, doc in enumerate(table["doc_id"].to_pylist()):
            for label, sure in enumerate((p[other][i] <= 0.1, p[other][i] >= 0.9)):
                if doc >= 100 and sure:
                    want[label, -1] += 1
                    for b in bucket[row == i]:
                        want[label, b >> shift] += 1
        assert (got[me] == want).all()
    assert got[0][:, -1].sum() > 0


def test_dense_figures():
    row, bucket, dense = cotrain.text_features(pa.array(["a*** b## c", "X!! Y!!", "a | b |", "so so so so", "", None]))
    share = np.round(dense**2, 3)
    assert share[0, 0] == 0.667 and share[1, 1] == 1.0 and share[2, 2] == 0.5 and share[3, 3] == 0.75
    assert (dense[4] == dense[5]).all() and set(row) == {0, 1, 2, 3}

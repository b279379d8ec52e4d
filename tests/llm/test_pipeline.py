import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_is_brute_force(spark, tmp_path):
    r = random.Random(5)
    word = lambda: f"w{r.randint(0, 3000)}"
    docs, labels, poor, toxic = [], [], set(), set()
    for i in range(600):
        words = [word() for _ in range(r.randint(30, 80))]
        if r.random() < 0.2:
            poor.add(i)
            words = [w + "***" for w in words]
        elif r.random() < 0.25:
            toxic.add(i)
            words[4] = words[9] = words[20] = "slurword"
        docs.append([i, " ".join(words), r.choice(["en", "fr"]), f"src{r.randint(0, 7)}", 0])
        labels.append((i, int(i not in poor), int(i in toxic)))
    clean = [i for i in range(600) if i not in poor | toxic]
    items = [" ".join(word() for _ in range(20)) for _ in range(3)]
    leaks = set(clean[10:16])
    for n, i in enumerate(sorted(leaks)):
        docs[i][1] += " " + items[n % 3]
    copies = {}
    for n, i in enumerate(clean[100:110]):
        copies[1000 + n] = i
        docs.append([1000 + n, docs[i][1] + (" more" if n % 2 else ""), "en", "src1", 0])
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels[:450], "doc_id long, quality int, toxic int"), ("benchmark", list(enumerate(items)), "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    step, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, step, str(tmp_path))
        if name != "tokens":
            assert out.columns == step.columns
        out.write.parquet(f"{tmp_path}/{n}")
        step = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append({x.doc_id for x in step.collect()})
    accepted = set(clean) | set(copies)
    assert len(kept[0] ^ accepted) <= 24, (len(kept[0] - accepted), len(accepted - kept[0]))
    assert kept[1] == {i for i in kept[0] if i not in copies or copies[i] not in kept[0]}
    assert kept[2] == kept[1] - leaks
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    text = {d[0]: d[1] for d in docs}
    size = {i: len(text[i].split()) for i in kept[2]}
    assert 0.88 < sum(size[i] for i in kept[3]) / sum(size.values()) < 0.95
    t, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for x in sorted(step.collect(), key=lambda x: x.doc_id):
        assert (x.start, x.n_tokens) == (start, len(t.encode(text[x.doc_id], add_special_tokens=False).ids) + 1)
        start += x.n_tokens
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_odd_and_empty_tables(spark, tmp_path):
    wide = SCHEMA + ", mix_epoch int, __id long, id string, row string, place long, n_tokens int, rep long"
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s1", 1), (1, text, "en", "s1", 1), (2, text + " x", "en", "s2", 1), (None, text, None, None, None), (3, None, "fr", None, 0), (4, "", None, "s1", 0), (5, "long " * 60_000, "en", "s3", 5), (6, "x" * 300_000, "en", "s3", 5)]
    rows = [(*r, 1, 2, "a", "b", 3, 4, 5) for r in rows]
    for folder, docs in (("odd", rows), ("empty", [])):
        spark.createDataFrame(docs, wide).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 1, 1), (9, None, None)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "a b")] if docs else [], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
        step = spark.read.parquet(f"{tmp_path}/{folder}/documents.parquet")
        kept = []
        for name, stage in corpus_pipeline.STAGES[:-1]:
            step = stage(spark, step, f"{tmp_path}/{folder}")
            step.write.parquet(f"{tmp_path}/{folder}/{name}")
            step = spark.read.parquet(f"{tmp_path}/{folder}/{name}")
            assert step.columns == [x.split()[0] for x in wide.split(", ")]
            kept.append(sorted((x.doc_id or 0 for x in step.collect())))
        if docs:
            assert kept[:3] == [[0, 1, 1, 2, 3, 4, 5, 6], [0, 1, 3, 4, 5, 6], [0, 1, 3, 4, 5, 6]]
        assert sorted((x.doc_id or 0 for x in corpus_pipeline.STAGES[-1][1](spark, step, f"{tmp_path}/{folder}").collect())) == kept[3]

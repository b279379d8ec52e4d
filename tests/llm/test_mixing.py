import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factspark.llm import mixing, queries

LEVELS = [("domain", lambda: F.col("domain")), ("lang", lambda: F.col("lang")), ("source", lambda: F.col("source"))]


def test_shortages_go_to_siblings_first():
    held = {("web", "en", "a"): 10, ("web", "en", "b"): 1000, ("web", "fr", "c"): 1000, ("books", "en", "d"): 1000}
    got = mixing.budgets(held, 800, {("web",): 3.0, ("books",): 1.0}, 1)
    # web gets 600 of 800, en 300 of it; a holds 10, so its sibling b gets 290 and nothing leaves the family
    assert got == {("web", "en", "a"): 10, ("web", "en", "b"): 290, ("web", "fr", "c"): 300, ("books", "en", "d"): 200}
    # en as a whole is short: the language's sibling is next, then the domain's
    held[("web", "en", "b")] = 20
    assert mixing.budgets(held, 800, {("web",): 3.0}, 1) == {("web", "en", "a"): 10, ("web", "en", "b"): 20, ("web", "fr", "c"): 570, ("books", "en", "d"): 200}
    held[("web", "fr", "c")] = 30
    assert mixing.budgets(held, 800, {("web",): 3.0}, 1)[("books", "en", "d")] == 740
    assert mixing.budgets(held, 10**9, {}, 2) == {k: 2 * v for k, v in held.items()}
    assert mixing.budgets({}, 5, {}, 1) == {}
    assert mixing.fill(10, {"a": 50, "b": 50}, {"a": 0.0}) == {"a": 0, "b": 10}
    assert mixing.fill(60, {"a": 50, "b": 50}, {"a": 0.0}) == {"a": 10, "b": 50}


def brute(rows, total, weights, epochs, seed):
    name = lambda x: "none" if x is None else x
    leaves = defaultdict(list)
    for i, text, *path in rows:
        leaves[tuple(map(name, path))].append((i, text, len((text or "").encode().split())))
    plan = mixing.budgets({k: sum(x[2] for x in v) for k, v in leaves.items()}, total, weights, epochs)
    out = []
    for leaf, docs in leaves.items():
        left, whole = plan[leaf], sum(x[2] for x in docs)
        for e in range(epochs):
            if left <= 0:
                break
            place = lambda x, e=e: int(hashlib.md5(f"{seed}|{e}|{'null' if x[0] is None else x[0]}|{hashlib.md5((x[1] or '').encode()).hexdigest() if x[0] is None else ''}".encode()).hexdigest()[:15], 16)
            done = 0
            for x in sorted(docs, key=lambda x: (place(x), x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
                if done < left or left >= whole:
                    out.append((x[0], e, x[2], "/".join(leaf)))
                done += x[2]
            left -= whole
    return sorted(out, key=str)


@pytest.mark.parametrize("share,epochs", [(0.4, 1), (1.7, 3), (0.0, 1)])
def test_mix_is_brute_force(spark, share, epochs):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 40), r.choice(["web", "books", None]), r.choice(["en", "fr"]), r.choice(["hot", "hot", "hot", "b", None])) for i in range(400)]
    rows += [(None, "null id", "web", "en", "hot"), (5, None, "web", "en", "hot"), *([rows[7]] * 3), (999, "long " * 5000, "books", "fr", "b")]
    weights = {("web",): 2.0, ("web", "fr"): 0.5, ("books", "en", "hot"): 5.0}
    total = int(sum(len((x[1] or "").split()) for x in rows) * share)
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    got = mixing.mix(df, LEVELS, total=total, weights=weights, epochs=epochs, seed=9)
    assert sorted(((x.doc_id, x.mix_epoch, x.mix_tokens, x.mix_leaf) for x in got.collect()), key=str) == brute(rows, total, weights, epochs, 9)


def test_large_trees_are_budgeted_alike(spark, monkeypatch):
    r = random.Random(12)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["web", "books", None]), r.choice(["en", "fr"]), f"s{r.randint(0, 9)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string")
    weights = {("web",): 2.0, ("web", "fr"): 0.0, ("books", "en", "s1"): 5.0}
    total = int(sum(len(x[1].split()) for x in rows) * 1.3)
    monkeypatch.setattr(mixing, "MAX_LEAVES", 7)
    got = mixing.mix(df, LEVELS, total=total, weights=weights, epochs=2, seed=4)
    assert sorted(((x.doc_id, x.mix_epoch, x.mix_tokens, x.mix_leaf) for x in got.collect()), key=str) == brute(rows, total, weights, 2, 4)


def test_empty_table_and_names_in_the_way(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_mixture(spark, str(tmp_path)).collect() == []
    rows = [(i, "a b c", "web", "en", "s", 7, 8, "x") for i in range(20)]
    clash = spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, mix_epoch int, mix_id int, MIX_place string")
    got = mixing.mix(clash, LEVELS, total=30, seed=9)
    assert got.columns == [*clash.columns, "mix_epoch_", "mix_tokens", "mix_leaf"] and mixing.added(clash)[0] == "mix_epoch_"
    found = got.collect()
    assert len(found) == 10 and {(r.mix_epoch, r.mix_id, r.MIX_place, r.mix_epoch_, r.mix_tokens) for r in found} == {(7, 8, "x", 0, 3)}
    clash.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert len(queries.op8_mixture(spark, f"{tmp_path}/b").collect()) == 10

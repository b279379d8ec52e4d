import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factspark.llm import queries, suffix

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=8):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        windows += [(i, tuple(w[p : p + n])) for p in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    found.add(i)
                    hit.update(range(p, p + len(x)))
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def made(seed):
    r = random.Random(seed)
    vocabulary = ["The", "of", "é", "a1", "Zug", "x", "schön", "re"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-", "_"]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 8, 9, 14, 20]))) for i in range(12)] + [(20, None), (21, ""), (22, "..."), (3, "the the the the the the the the the")]
    docs = [(d, text(r.choice([0, 2, 20, 60])) + r.choice([t or "" for _, t in items]) + text(5)) for d in range(40)]
    return docs + [(50, None), (51, ""), (52, docs[0][1]), (0, docs[0][1]), (53, "the " * 3000)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_annotate_is_brute_force(spark, seed):
    docs, items = made(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix.annotate(spark.createDataFrame(docs, "doc_id long, text string"), suffix.read_items(bench)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got) == sorted(brute(docs, items))


def test_longest_match_and_removal(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a b {passage} c", "u"), (2, " ".join(passage.split()[5:17]), "v"), (3, "nothing here", None), (None, None, None)], "doc_id long, text string, item_ids string")
    items = suffix.read_items(bench)
    rows = {(r.doc_id, r.item_id): (r.words, r.doc_word, r.item_word) for r in suffix.longest_matches(docs, items).collect()}
    assert rows == {(1, 7): (30, 2, 0), (2, 7): (12, 0, 5)}
    left = suffix.decontaminate(docs, items)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {3, None}


def test_suffix_array_is_sorted_to_the_end():
    r = np.random.default_rng(5)
    for _ in range(40):
        texts = [r.integers(0, r.choice([1, 2, 5]), r.integers(0, 40)) for _ in range(r.integers(0, 6))]
        if len(texts) > 2:
            texts[1] = texts[0]
        rank = np.concatenate([np.append(x + len(texts), i) for i, x in enumerate(texts)] or [np.zeros(0, np.int64)]).astype(np.int64)
        assert suffix.suffix_array(rank).tolist() == sorted(range(len(rank)), key=lambda i: rank[i:].tolist())


@pytest.mark.parametrize("pairs", [3, 1 << 21])
def test_longest_matches_are_brute_force(monkeypatch, pairs):
    docs, items = made(4)
    docs = [(d, t and t[:900]) for d, t in docs]
    items.append((30, "the " * 90 + "zug"))
    want = {}
    for d, t in {(d, t) for d, t in docs}:
        w = words(t)
        for i, x in items:
            x = words(x)
            n = min(8, len(x))
            best = (0, 0, 0)
            before = [0] * (len(x) + 1)
            for a in range(len(w) - 1, -1, -1):
                now = [0] * (len(x) + 1)
                for b in range(len(x) - 1, -1, -1):
                    if w[a] == x[b]:
                        now[b] = before[b + 1] + 1
                        best = max(best, (now[b], -a, -b))
                before = now
            if n and best[0] >= n and best[0] > want.get((d, t, i), (0,))[0]:
                want[d, t, i] = (best[0], -best[1], -best[2])
    monkeypatch.setattr(suffix, "PAIRS", pairs)
    bench = suffix._items([{"i": i, "t": t} for i, t in items if t is not None], 8)
    rows = list(dict.fromkeys(docs))
    shard = suffix.Shard(pa.array([t for _, t in rows]))
    got = {(*rows[d], bench.ids[i]): tuple(x) for d, i, *x in zip(*(c.tolist() for c in shard.matches(bench)))}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert {k: v for k, v in got.items() if k[2] != 3} == {k: v for k, v in want.items() if k[2] != 3}  # 3 has two texts


def test_blocks_of_the_benchmark(spark):
    docs, items = made(6)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    some = suffix.read_items(bench, block_bytes=100)
    assert len(some.blocks) > 3
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in suffix.annotate(df, some).collect()) == sorted(brute(docs, items))


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in suffix.annotate(docs, suffix.read_items(bench)).collect()] == [(1, 2, 0, [], 0)]
    assert suffix.annotate(docs.limit(0), suffix.read_items(bench)).collect() == []


def test_query_digest(spark, tmp_path):
    docs, items = made(3)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op10_decontaminate(spark, str(tmp_path)).orderBy(F.col("doc_id")).collect()
    want = [(d, n, h, len(i), hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest(), len(i) >= 2) for d, n, h, i in brute(docs, items)]
    assert sorted(tuple(r)[:6] for r in got) == sorted(want)

import random

import numpy as np
import pytest

from factspark.llm import graph, queries, sigtree


def shingle_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets)), key=str)


def made(seed, families=12):
    r = random.Random(seed)
    word = lambda: f"w{r.randint(0, 300)}"
    shared = [" ".join(word() for _ in range(40)) for _ in range(3)]
    rows, n = [], 0
    for _ in range(families):
        base = [word() for _ in range(r.choice([3, 12, 40, 90]))]
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w).upper() if r.random() < 0.2 else " ".join(w) + (" " + r.choice(shared) if r.random() < 0.3 else "")))
            n += 1
    return rows + [(None, rows[0][1]), (500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (0, rows[0][1]), (505, "x " * 3000), (506, rows[1][1])]


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 9, 10), (2, 5, 4, 5)])
def test_join_is_brute_force(spark, seed, k, num, den):
    rows = made(seed)
    got = sigtree.join(spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, n string"), k, num, den)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, num, den)


def test_large_cluster_in_blocks(spark, monkeypatch):
    """A family of near copies in blocks of a few: those that the smallest one doesn't link meet in block pairs."""
    monkeypatch.setattr(sigtree, "TOGETHER", 2)
    monkeypatch.setattr(sigtree, "BLOCK", 8)
    monkeypatch.setattr(sigtree, "LEAST_FREQUENT", 5)
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(100)] = f"v{r.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = sigtree.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 9, 10)


def test_tree_traversal_is_exact():
    r = np.random.default_rng(7)
    pool = r.integers(0, 2**63, 400, dtype=np.uint64)
    sets = [np.unique(r.choice(pool[: r.choice([60, 400])], r.integers(1, 80))) for _ in range(150)]
    sets += [np.unique(np.delete(s, r.integers(0, len(s)))) for s in sets[:60] if len(s) > 12]
    for sides in (None, np.arange(len(sets)) % 2):
        got = sigtree.connect(sets, np.arange(len(sets)), 8, 10, sides)
        want = np.arange(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                if sides is not None and sides[a] == sides[b]:
                    continue
                both = len(np.intersect1d(sets[a], sets[b]))
                if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both) and want[a] != want[b]:
                    want[want == max(want[a], want[b])] = min(want[a], want[b])
        assert (got == want).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one_and_empty(spark, tmp_path):
    text = "a b c d e f g h i j k l m n o p"
    docs = spark.createDataFrame([(3, text, "x"), (2, text + " q", "y"), (2, text + " q", "z"), (7, "other words", None), (None, text, "n"), (8, None, "e")], "doc_id long, text string, label string")
    assert sorted(map(tuple, sigtree.keep_one(docs).collect()), key=str) == sorted([(2, text + " q", "y"), (7, "other words", None), (8, None, "e"), (None, text, "n")], key=str)
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op4_ngram_join(spark, str(tmp_path)).collect() == []

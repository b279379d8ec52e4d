import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factspark.llm import ctw, queries

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def grams_of(text, depth):
    b = (text or "").encode().translate(LOWER) + b"\0"
    padded = b"\0" * depth + b
    return [padded[i : i + depth + 1] for i in range(len(b))]


class Brute:
    """Context-tree weighting by recursion over dictionaries; contexts are byte strings, the last byte nearest."""

    def __init__(self, texts, depth, least=1):
        self.depth = depth
        self.count = [Counter(g[-d - 1 :] for t in texts for g in grams_of(t, depth)) for d in range(depth + 1)]
        self.count = [Counter({g: n for g, n in c.items() if n >= least}) for c in self.count]
        self.nodes = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
        self.kept = [{g[:-1] for g in c} for c in self.count]
        for d, c in enumerate(self.count):
            for g, n in c.items():
                for j in range(8):
                    self.nodes[d][g[:-1], (1 << j) | (g[-1] >> (8 - j))][(g[-1] >> (7 - j)) & 1] += n
        self.children = [defaultdict(list) for _ in range(depth + 1)]
        for d in range(1, depth + 1):
            for c, p in self.nodes[d]:
                self.children[d - 1][c[1:], p].append((c, p))

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def rest(self, d, node):
        a, b = self.nodes[d].get(node, (0, 0))
        for x in self.children[d][node]:
            a, b = a - self.nodes[d + 1][x][0], b - self.nodes[d + 1][x][1]
        return a, b

    def weight(self, d, node):
        own = self.kt(*self.nodes[d].get(node, (0, 0)))
        return own if d == self.depth else np.logaddexp(own, self.below(d, node)) - math.log(2)

    def below(self, d, node):
        return self.kt(*self.rest(d, node)) + sum(self.weight(d + 1, x) for x in self.children[d][node])

    def bit(self, context, prefix):
        def mixed(d):
            c = context[len(context) - d :]
            node = (c, prefix)
            a, b = self.nodes[d].get(node, (0, 0))
            own = (b + 0.5) / (a + b + 1)
            if d == self.depth:
                return own
            stop = self.kt(a, b) - np.logaddexp(self.kt(a, b), self.below(d, node))
            if context[len(context) - d - 1 :] in self.kept[d + 1]:
                deeper = mixed(d + 1)
            else:
                a, b = self.rest(d, node)
                deeper = (b + 0.5) / (a + b + 1)
            return math.exp(stop) * own + (1 - math.exp(stop)) * deeper

        return mixed(0)

    def log10(self, gram):
        out = 0.0
        for j in range(8):
            p = self.bit(gram[:-1], (1 << j) | (gram[-1] >> (8 - j)))
            out += math.log10(p if (gram[-1] >> (7 - j)) & 1 else 1 - p)
        return out


def model_of(texts, depth, least=1):
    out = []
    for d in range(depth + 1):
        c = Counter(int.from_bytes(g[-d - 1 :], "big") for t in texts for g in grams_of(t, depth))
        c = sorted((g, n) for g, n in c.items() if n >= least)
        out.append((np.array([g for g, _ in c], np.uint64), np.array([n for _, n in c], float)))
    return ctw.build(out)


@pytest.mark.parametrize("least", [1, 3])
def test_model_is_brute_force(least):
    r = random.Random(least)
    texts = ["".join(r.choice("abcé Z") for _ in range(r.randint(0, 60))) for _ in range(12)] + ["ababababab" * 9]
    brute, model = Brute(texts, 3, least), model_of(texts, 3, least)
    new = [*texts, "xyz abba", "ÿ", ""]
    grams = [g for t in new for g in grams_of(t, 3)]
    got = model.log10(np.array([int.from_bytes(g, "big") for g in grams], np.uint64))
    assert np.allclose(got, [brute.log10(g) for g in grams], atol=2e-4)
    for context in (b"aba", b"\0\0\0", b"zzz"):  # a distribution in every context
        all_bytes = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** model.log10(all_bytes)).sum() - 1) < 1e-4


def test_grams():
    grams, first, count = ctw.sequence(pa.array(["Ab", None, "é"]), 2)
    got = [[int(g).to_bytes(3, "big") for g in grams[f : f + c]] for f, c in zip(first, count)]
    assert got == [[b"\0\0a", b"\0ab", b"ab\0"], [b"\0\0\0"], [b"\0\0\xc3", b"\0\xc3\xa9", b"\xc3\xa9\0"]]
    assert np.allclose(ctw.lgamma(np.array([0.5, 1, 3.5, 1e6])), [math.lgamma(x) for x in (0.5, 1, 3.5, 1e6)])


def base(rows):
    words = lambda t: (t or "").encode().translate(LOWER).split() + [None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return {(i, t): (held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t))) for i, t in rows}


@pytest.mark.parametrize("most", [ctw.MAX_WORDS, 5])
def test_query_is_brute_force(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(ctw, "MAX_WORDS", most)
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["the", "The", "é", "x1", f"w{r.randint(0, 99)}"]) for _ in range(r.randint(0, 50)))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "no id"), (202, "long " * 4000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows + rows[:2]], "doc_id long, text string, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_context_tree(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    want = base(rows + rows[:2])
    model = model_of([t for (i, t) in rows + rows[:2] if not want[i, t][0]], ctw.DEPTH)
    by_id = {i: (t, want[i, t]) for i, t in rows}
    for x in got:
        text, (held, n, known, total, score) = by_id[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert abs(x.base_score - score) < 1e-6 * max(1, abs(score))
        code = model.log10(np.array([int.from_bytes(g, "big") for g in grams_of(text, ctw.DEPTH)], np.uint64)).sum()
        assert abs(x.score - code) < 1e-3 * max(1, abs(code)) and x.score < 0


def test_bounded_grams_and_empty_table(spark, tmp_path):
    r = random.Random(1)
    docs = spark.createDataFrame([("".join(r.choice("abcdefgh") for _ in range(400)),) for _ in range(40)], "text string")
    model = ctw.train(docs, 3, 300)[0]
    assert max(map(len, model.grams)) <= 300 and len(model.grams[0]) == 9
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op9_context_tree(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("most", [1, 40])
def test_rare_grams_are_not_dropped(spark, monkeypatch, most):
    monkeypatch.setattr(ctw, "MAX_GRAMS", most)  # bounds only what goes to the tasks
    r = random.Random(5)
    rows = [(i, "".join(r.choice("abcdefgh é") for _ in range(r.randint(0, 90)))) for i in range(60)] + [(99, None), (98, "zzz")]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    model = model_of([texts[x.doc_id] for x in got if not x.held_out], ctw.DEPTH)
    for x in got:
        code = model.log10(np.array([int.from_bytes(g, "big") for g in grams_of(texts[x.doc_id], ctw.DEPTH)], np.uint64)).sum()
        assert abs(x.score - code) < 1e-3 * max(1, abs(code)), x


def test_more_grams_than_go_to_the_tasks(spark):
    r = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789 .,;-"
    rows = [(i, "".join(r.choice(letters) for _ in range(11_000))) for i in range(30)]
    got = ctw.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    model = model_of([texts[x.doc_id] for x in got if not x.held_out], ctw.DEPTH)
    assert len(model.grams[-1]) > 1 << 18
    for x in got:
        code = model.log10(np.array([int.from_bytes(g, "big") for g in grams_of(texts[x.doc_id], ctw.DEPTH)], np.uint64)).sum()
        assert abs(x.score - code) < 1e-3 * abs(code), x

import hashlib
import random
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from factspark.llm import bottomk, queries

SPACE = " \t\n\x0b\x0c\r"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chain(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return signed(h)


def brute_sketch(text, k=bottomk.SIZE, width=5):
    words = [w for w in (text or "").translate({ord(c): " " for c in SPACE}).split(" ") if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    runs = [h[i : i + width] for i in range(len(h) - width + 1)] or ([h] if h else [])
    return sorted({chain(r) for r in runs})[:k]


def brute_near(a, b, k=bottomk.SIZE):
    both = sorted({*a, *b})[:k]
    return len({*both} & {*a} & {*b}) / len(both) if both else 1.0


def made(seed, n=60):
    r = random.Random(seed)
    text = lambda: "".join(r.choice(["a", "B", "schön", "😀", "the", f"w{r.randint(0, 50)}"]) + r.choice(SPACE) * r.randint(1, 2) for _ in range(r.choice([0, 1, 4, 5, 30, 400])))
    rows = [(i * 3 % 1000 + (i > n // 2) * 10**9, text()) for i in range(n)]
    return rows + [(5, rows[0][1]), (5, rows[0][1]), (7, None), (8, ""), (None, "no id at all is here"), (11, rows[3][1])]


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 0)])
def test_query_is_brute_force(spark, tmp_path, seed, n):
    rows = made(seed, n) if n else [(4, "one two three four five six")]
    spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, sketch string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_bottomk(spark, str(tmp_path)).collect()
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (-(2**63) if x[0] is None else x[0], x[1].encode()))
    want = []
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        a, e, f = brute_sketch(t), brute_sketch(edited), brute_sketch(following)
        text = lambda s: "".join(f"{x % 2**64:016X}" for x in s)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(e), brute_near(a, e), brute_near(a, f)))
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)


def test_estimates_and_merge(spark):
    r = random.Random(3)
    a = [f"t{r.random()}" for _ in range(6000)]
    b = a[:4000] + [f"t{r.random()}" for _ in range(2000)]
    df = spark.createDataFrame([("x", " ".join(a)), ("y", " ".join(b))], "n string, text string")
    s = {x.n: x for x in bottomk.with_sketch(df, "text", "s", 512).select("n", "s").collect()}
    one = spark.createDataFrame([(s["x"].s, s["y"].s)], "a array<long>, b array<long>")
    a_, b_ = F.col("a"), F.col("b")
    near, part, count = one.select(bottomk.resemblance(a_, b_, 512), bottomk.containment(a_, b_, 512), bottomk.distinct_count(a_, 512)).first()
    assert abs(near - 0.5) < 0.08 and abs(part - 2 / 3) < 0.12 and abs(count / 5996 - 1) < 0.15
    merged = bottomk.merge(spark.createDataFrame([("k", x.s) for x in s.values()] + [("k", []), ("l", [])], "k string, s array<long>"), ["k"], "s", 512)
    assert {x.k: list(x.s) for x in merged.collect()} == {"k": sorted({*s["x"].s, *s["y"].s})[:512], "l": []}


def test_empty_table_and_native_plan(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.op2_bottomk(spark, str(tmp_path))
    assert df.collect() == []
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan

"""What plans do and don't hold, and cases that plans could get wrong."""

import pytest
from factspark import Data, Math, Ref, Relation, RelationSource, TripleSource, fact
from factspark.functions import python_formula
from factspark.operators import Fold, count_
from factspark.plans.ir import Formula, Not
from factspark.queries import QUERIES
from factspark.values import float_text, float_text_of
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["join_star", "flagship", "rule_composition", "induction_step"])
def test_tables_without_a_key_are_one_scan(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and plan.count("l_orderkey") + plan.count("l_partkey") + plan.count("l_linenumber") > 0
    files = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert files.count("FileScan parquet") <= {"join_star": 3, "flagship": 4, "rule_composition": 4, "induction_step": 1}[name]


def test_rows_without_a_key_are_told_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("x", None), ("x", "null"), ("a", "b|c")], "p string, q string")
    source = RelationSource([Relation("t", df, None, {"p": "p", "q": "q"})])
    T = fact("t", p=str, q=str)
    assert {(r.p, r.q) for r in T().query(source).select("p", "q").collect()} == {("a|b", "c"), ("a", "b|c"), ("x", "null")}
    assert T().query(source).select("this").distinct().count() == 3
    # an entity found through one attribute has its own row's others only
    Pair = fact(p=str, q=str).where(lambda v: [fact("t", p=str)(this=v.e, p=v.p), Data.greater(this=v.p, than=""), fact("t", q=str)(this=v.e, q=v.q)])
    assert {(r.p, r.q) for r in Pair().query(source).collect()} == {("a|b", "c"), ("a", "b|c"), ("x", "null")}


def chain(spark, n):
    db = TripleSource.create(spark, [("g/to", Ref(str(a)), Ref(str(a + 1))) for a in range(n)])
    Edge = fact("g", to=object)
    return db, fact(a=object, b=object), Edge


def test_only_new_values_are_bounded(spark):
    db, shape, Edge = chain(spark, 12)
    Reach = shape.when(lambda v: {"one": [Edge(this=v.a, to=v.b)], "more": [Edge(this=v.a, to=v.m), Reach(a=v.m, b=v.b)]})
    assert Reach().query(db, limit=3).count() == 12 * 13 // 2
    Up = fact(n=int).when(lambda v: {"first": [Data.same(this=0, as_=v.n)], "next": [Up(n=v.m), Math.Sum(of=v.m, with_=1, is_=v.n)]})
    with pytest.raises(RuntimeError):
        Up().query(db, limit=3)


def test_recursion_beyond_the_driver(spark, monkeypatch):
    from factspark.plans import fixpoint

    monkeypatch.setattr(fixpoint, "SMALL_ROWS", 9)
    monkeypatch.setattr(fixpoint, "MERGE", 3)
    db, shape, Edge = chain(spark, 9)
    Reach = shape.when(lambda v: {"one": [Edge(this=v.a, to=v.b)], "more": [Edge(this=v.a, to=v.m), Reach(a=v.m, b=v.b)]})
    assert {(int(r.a), int(r.b)) for r in Reach().query(db).collect()} == {(a, b) for a in range(9) for b in range(a + 1, 10)}


def test_floats_have_one_text(spark):
    values = [1e-05, 2500000000000.25, -0.1, 5e-324, 2.0**-1022, 2.0**-1074 * 3, 1.7976931348623157e308, 1 - 2**-53, 1 + 2**-52, 0.3, -7.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(float_text(F.col("v"))).collect()] == [float_text_of(v) for v in values]


def test_plan_shows_the_order(spark):
    db, _, Edge = chain(spark, 3)
    Two = fact(a=object, b=object).where(lambda v: [Edge(this=v.a, to=v.m), Edge(this=v.m, to=v.b)])
    shown = Two().plan(db)
    assert shown.count("scan g/to of") == 2 and "Physical Plan" in shown


def test_fold_by_groups(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(50)], "k int, x int")
    fold = Fold(lambda: 0, lambda s, r: s + r["x"], lambda s: {"total": s}, lambda a, b: a + b)
    assert {tuple(r) for r in fold.run_by(rows.repartition(4), ["k"], "total long").collect()} == {(k, sum(range(k, 50, 3))) for k in range(3)}
    with pytest.raises(ValueError):
        Fold(lambda: 0, lambda s, r: s).run_by(rows, ["k"], "total long")
    assert rows.groupBy("k").agg(count_()).count() == 3


def test_formula_of_records(spark):
    db = TripleSource.create(spark, [("p/text", "1", "a-b-c"), ("p/text", "2", "x"), ("p/text", "3", "q-q")])
    cut = python_formula(lambda text: [{"at": i, "part": x} for i, x in enumerate(text.split("-"))], "struct<at:bigint,part:string>", {"at": "integer", "part": "string"}, ["of"])
    P = fact("p", text=str)
    Q = fact(text=str, at=int, part=str).where(lambda v: [P(text=v.text), Formula("cut", {"of": v.text}, {"at": v.at, "part": v.part})])
    assert {tuple(r) for r in Q().query(db, {"cut": cut}).select("text", "at", "part").collect()} == {("a-b-c", 0, "a"), ("a-b-c", 1, "b"), ("a-b-c", 2, "c"), ("x", 0, "x"), ("q-q", 0, "q"), ("q-q", 1, "q")}
    Second = fact(text=str, part=str).where(lambda v: [P(text=v.text), Formula("cut", {"of": v.text}, {"at": 1, "part": v.part})])
    assert {tuple(r) for r in Second().query(db, {"cut": cut}).select("text", "part").collect()} == {("a-b-c", "b"), ("q-q", "q")}
    Lone = fact(text=str).where(lambda v: [P(text=v.text), Not(Formula("cut", {"of": v.text}, {"at": 1}))])
    assert {r.text for r in Lone().query(db, {"cut": cut}).collect()} == {"x"}


def test_maps_of_maps(spark):
    db = TripleSource.create(spark, [("p/n", "1", 3), ("p/n", "2", 4)])
    twice = fact("p", n=int).map(lambda r: r["n"] * 2).map(lambda n: {"n": n + 1})
    assert sorted(x["n"] for x in twice.query(db)) == [7, 9] == sorted(r.n for r in twice.frame(db, "n long").collect())


def test_locals_are_no_members():
    with pytest.raises(TypeError):
        fact(a=int).with_(a=int)
    assert fact(a=int).with_(b=int).members == {"a": int}

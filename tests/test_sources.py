import random

from factspark import CachingSource, Collection, Data, InspectingSource, Math, Ref, Relation, RelationSource, Text, TripleSource, fact
from factspark.functions import python_formula
from factspark.plans.ir import Formula
from factspark.sources.files import as_json, read_csv, read_json
from factspark.streaming import facts_of, run_rules


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_json_and_back(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"m1": {"movie": {"title": "T \\"x\\"", "year": 1999, "cast": [{"/": "p1"}, {"/": "p2"}]}, "imdb": {"rating": 8.5}}}\n{"p1": {"actor": {"name": "A", "alive": true}}}\n')
    db = read_json(spark, str(tmp_path / "in.json"))
    Movie, Actor = fact("movie", title=str, year=int, cast=object), fact("actor", name=str, alive=bool)
    Q = fact(title=str, name=str, year=int).where(lambda v: [Movie(title=v.title, cast=v.a, year=v.year), Actor(this=v.a, name=v.name, alive=True)])
    assert rows(Q().query(db), "title", "name", "year") == [('T "x"', "A", 1999)]
    as_json(db).write.text(str(tmp_path / "out"))
    again = read_json(spark, str(tmp_path / "out"))
    key = lambda d: sorted((r["the"], r["of"], str(r["is"])) for r in d.df.collect())
    assert key(again) == key(db)


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('title,year,genres\nA,2000,"Drama, War"\nB,,Drama\n')
    db = read_csv(spark, str(tmp_path / "x.csv"), "movie", ["title"], {"genres": ","}, "title string, year int, genres string")
    assert rows(fact("movie", title=str, genres=str)().query(db), "title", "genres") == [("A", "Drama"), ("A", "War"), ("B", "Drama")]
    assert rows(fact("movie", title=str, year=int)().query(db), "title", "year") == [("A", 2000)]


def test_wrapped_sources_and_star(spark):
    df = spark.createDataFrame([(1, "a", 10), (2, "b", None), (3, "c", 1)], "id int, name string, boss int")
    base = RelationSource([Relation("p", df, "id", {"name": "name", "boss": "boss"}, {"boss": "p"})])
    P = fact("p", name=str, boss=object)
    seen = InspectingSource(base)
    assert rows(P(boss=Ref("p:1")).query(seen), "name") == [("c",)]
    assert {"star": ["p/name", "p/boss"]} in seen.scans
    kept = CachingSource(base, 1)
    for _ in range(2):
        assert rows(fact("p", name=str)().query(kept), "name") == [("a",), ("b",), ("c",)]
    assert rows(fact("p")().query(kept), "this") == [("p:1",), ("p:2",), ("p:3",)] and len(kept.kept) == 1
    kept.clear()
    Boss = fact(low=str, high=str).where(lambda v: [P(this=v.x, name=v.low, boss=v.y), fact("p", name=str)(this=v.y, name=v.high)])
    assert rows(Boss().query(base), "low", "high") == [("c", "a")]
    any_of = fact(at=str).where(lambda v: [Collection(this=Ref("p:2"), at=v.at, of=v.x)])
    assert rows(any_of().query(base), "at") == [("p/name",)]
    plan = P(boss=Ref("p:1")).query(base)._jdf.queryExecution().toString()
    assert "Join" not in plan  # one scan, no self-joins


def test_formula_edges(spark):
    db = TripleSource.create(spark, [("t/v", "a", "ab\r\ncd"), ("t/v", "b", " x  "), ("t/v", "c", "piz%"), ("t/v", "d", "pizza"), ("t/v", "e", "a*c"), ("t/n", "n", 7), ("t/n", "z", 0), ("t/n", "m", -7)])
    T, N = fact("t", v=str), fact("t", n=int)
    out = lambda make, s=T, m="v": rows(fact(e=object, o=object).where(lambda v: [s(this=v.e, **{m: v.x}), make(v)])().query(db), "e", "o")
    assert ("a", "ab") in out(lambda v: Text.Lines(of=v.x, is_=v.o)) and ("b", "x") in out(lambda v: Text.Trim(of=v.x, is_=v.o))
    like = lambda p: [e for e, _ in out(lambda v: [Text.match(this=v.x, pattern=p), Data.same(this=1, as_=v.o)])]
    assert like("piz%") == ["c"] and like("p?z*") == ["c", "d"] and like("a\\*c") == ["e"] and like("*\n*") == ["a"]
    assert ("d", "zz") in out(lambda v: Text.Slice(of=v.x, start=2, end=-1, is_=v.o)) and ("d", 5) in out(lambda v: Text.Length(of=v.x, is_=v.o))
    divided = out(lambda v: Math.Division(of=7, by=v.x, is_=v.o), N, "n")
    assert divided == [("m", -1.0), ("n", 1.0)]
    assert out(lambda v: Math.Modulo(of=v.x, by=2, is_=v.o), N, "n") == [("m", -1), ("n", 1), ("z", 0)]
    assert out(lambda v: [Math.Sum(of=0, with_=v.x, is_=0), Data.same(this=v.x, as_=v.o)], N, "n") == [("z", 0)]
    halves = python_formula(lambda n: [n // 2] if n % 2 else [n, n + 1], "bigint", "integer", ["of"])
    Q = fact(e=object, o=int).where(lambda v: [N(this=v.e, n=v.x), Formula("halves", {"of": v.x}, v.o)])
    assert rows(Q().query(db, formulas={"halves": halves}), "e", "o") == [("m", -4), ("n", 3), ("z", 0), ("z", 1)]


def test_stream_of_facts(spark, tmp_path):
    schema = "id int, name string, boss string"
    for n, part in enumerate(([(1, "a", None), (2, "b", "a")], [(3, "c", "b")])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    P = fact("p", name=str, boss=str)
    top = fact("p", name=str)
    Top = fact(name=str).where(lambda v: [top(this=v.e, name=v.name), P.not_(this=v.e)])
    found = {}
    query = run_rules(facts_of(stream, "p", "id"), f"{tmp_path}/facts", {"boss": P(), "top": Top()}, lambda name, df, n: found.__setitem__((name, n), rows(df, "name")), f"{tmp_path}/check", availableNow=True)
    query.awaitTermination()
    last = max(n for _, n in found)
    assert found["boss", last] == [("b",), ("c",)] and found["top", last] == [("a",)]


def test_log_of_batches(spark, tmp_path, monkeypatch):
    """Random assertions and retractions, batch by batch, against a plain dictionary; snapshots in between."""
    from factspark.sources.triples import SCHEMA, tag_value
    from factspark.streaming import continuous

    monkeypatch.setattr(continuous, "SNAPSHOT", 3)
    r, path, held = random.Random(11), str(tmp_path / "log"), {}
    for n in range(8):
        made = [(r.choice(["assert", "assert", "retract"]), f"x/{r.randint(0, 2)}", str(r.randint(0, 2)), r.choice([1, "1", 2.5, None])) for _ in range(6)]
        spark.createDataFrame([(op, the, of, tag_value(v), str(n)) for op, the, of, v in made], f"op string, {SCHEMA}").write.parquet(f"{path}/batch-{n}")
        for op, *key in made:
            if op == "assert":
                held.setdefault(tuple(map(repr, key)), str(n))
        for op, *key in made:
            if op == "retract":
                held.pop(tuple(map(repr, key)), None)
        facts = continuous.facts_upto(spark, path, n)
        if n % 3 == 2:
            facts.write.parquet(f"{path}/snapshot-{n}")
            assert continuous._stored(spark, path, n) == (n, [])
        got = {(repr(f["the"]), repr(f["of"]), repr({"integer": f["is"]["l"], "string": f["is"]["s"], "float": f["is"]["d"], "null": None}[f["is"]["t"]])): f["cause"] for f in facts.collect()}
        assert got == held


def test_types_are_known_without_a_scan(spark):
    db = TripleSource.create(spark, [("a/x", "1", 1), ("a/x", "2", 2.5), ("a/y", "1", "t"), ("a/z", "1", None), ("a/w", "1", 4)])
    assert db._types == {"a/x": "float", "a/y": "string", "a/z": "any", "a/w": "integer"}
    after = db.transact([{"assert": ("a/y", "2", 3)}, {"assert": ("a/v", "2", True)}, {"retract": ("a/w", "1", 4)}])
    assert after._types == {"a/x": "float", "a/y": "any", "a/z": "any", "a/w": "integer", "a/v": "boolean"}
    assert TripleSource(db.df).types == db._types

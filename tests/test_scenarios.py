"""Rules over small stores: joins, negation, disjunction, recursion, claims, transactions, grouping."""

import pytest

from factspark import Collection, Data, Fold, InspectingSource, Math, Ref, Text, TripleSource, V, count_, fact, parse_rule, same, shred, to_dict
from factspark.plans.compiler import Compiler

STAFF = [
    ("Warbucks Oliver", "Slumerville, Top Heap Road", "Administration big wheel", 150000, None),
    ("Scrooge Eben", "Weston, Shady Lane 10", "Chief accountant", 75000, "Warbucks Oliver"),
    ("Cratchet Robert", "Allston, N Harvard Street 16", "accounting scrivener", 18000, "Scrooge Eben"),
    ("Bitdiddle Ben", "Slumerville, Ridge Road 10", "Computer wizard", 60000, "Warbucks Oliver"),
    ("Hacker Alyssa P", "Cambridge, Mass Ave 78", "Computer programmer", 40000, "Bitdiddle Ben"),
    ("Fect Cy D", "Cambridge, Ames Street 3", "Computer programmer", 35000, "Bitdiddle Ben"),
    ("Tweakit Lem E", "Boston, Bay State Road 22", "Computer technician", 25000, "Bitdiddle Ben"),
    ("Reasoner Louis", "Slumerville, Pine Tree Road 80", "Computer programmer trainee", 30000, "Hacker Alyssa P"),
    ("Aull DeWitt", "Slumerville, Onion Square 5", "Administration secretary", 25000, "Warbucks Oliver"),
]
Person = fact("person", name=str, address=str)
Job = fact("job", title=str, salary=int)
Supervisor = fact("job", supervisor=object)


@pytest.fixture(scope="module")
def staff(spark):
    facts = []
    for name, address, title, salary, boss in STAFF:
        e = Ref(name)
        facts += [("person/name", e, name), ("person/address", e, address), ("job/title", e, title), ("job/salary", e, salary)]
        facts += [("job/supervisor", e, Ref(boss))] if boss else []
    return TripleSource.create(spark, facts)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_supervisors(staff):
    Manager = fact(employee=str, manager=str).where(lambda v: [Person(this=v.sub, name=v.employee), Person(this=v.boss, name=v.manager), Supervisor(this=v.sub, supervisor=v.boss), Manager.claim(employee=v.employee, manager=v.manager)])
    assert len(rows(Manager().query(staff), "employee", "manager")) == 8
    assert rows(Manager(manager="Bitdiddle Ben").query(staff), "employee") == [("Fect Cy D",), ("Hacker Alyssa P",), ("Tweakit Lem E",)]
    either = fact(employee=str).when(lambda v: {"a": [Manager(employee=v.employee, manager="Bitdiddle Ben")], "b": [Manager(employee=v.employee, manager="Hacker Alyssa P")]})
    assert len(rows(either().query(staff), "employee")) == 4
    wheel = fact(name=str).where(lambda v: [Person(this=v.x, name=v.name), Supervisor(this=v.m, supervisor=v.x), Supervisor(this=v.e, supervisor=v.m)])
    assert rows(wheel().query(staff), "name") == [("Bitdiddle Ben",), ("Warbucks Oliver",)]


def test_filters_and_globs(staff):
    paid = lambda op, n: len(rows(fact(name=str).where(lambda v: [Person(this=v.e, name=v.name), Job(this=v.e, salary=v.s), op(this=v.s, than=n)])().query(staff), "name"))
    assert paid(Data.greater, 30000) == 5 and paid(Data.less, 100000) == 8 and paid(Data.greater_or_equal, 30000) == 6 and paid(Data.less_or_equal, 18000) == 1
    of = lambda *body: rows(fact(name=str).where(lambda v: [Person(this=v.e, name=v.name, address=v.a), Job(this=v.e, title=v.t), *[b(v) for b in body]])().query(staff), "name")
    assert len(of(lambda v: Text.match(this=v.t, pattern="Computer*"))) == 5
    assert len(of(lambda v: Text.not_(this=v.t, pattern="Computer*"))) == 4
    assert len(of(lambda v: Text.match(this=v.t, pattern="Computer ?rogramm?r"))) == 2
    assert len(of(lambda v: Text.includes(this=v.a, slice="Slumerville"))) == 4
    assert of(lambda v: same.not_(v.t, "Computer programmer"), lambda v: Text.match(this=v.t, pattern="Computer programmer*")) == [("Reasoner Louis",)]


def test_negated_join_and_near(staff):
    idle = fact(name=str).where(lambda v: [Person(this=v.e, name=v.name), Supervisor(this=v.e, supervisor=v.b), Job.not_(this=v.b, title="Computer wizard"), Supervisor.not_(supervisor=v.e), Job.not_(this=v.e, title="Administration secretary")])
    assert rows(idle().query(staff), "name") == [("Cratchet Robert",), ("Reasoner Louis",)]
    Near = fact(a=str, b=str).where(
        lambda v: [Person(name=v.a, address=v.x), Person(name=v.b, address=v.y), Text.Words(of=v.x, is_=v.town), Text.match(this=v.town, pattern="*,"), Text.Concat(of=v.town, with_="*", is_=v.pattern), Text.match(this=v.y, pattern=v.pattern), same.not_(v.a, v.b)]
    )
    assert len(rows(Near().query(staff), "a", "b")) == 4 * 3 + 2


def test_recursion_over_a_cycle_and_a_chain(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 1)]
    db = TripleSource.create(spark, [("list/next", Ref(f"n{a}"), Ref(f"n{b}")) for a, b in edges])
    Node = fact("list", next=object)
    Reach = fact(start=object, end=object).when(lambda v: {"base": [Node(this=v.start, next=v.end)], "step": [Node(this=v.start, next=v.mid), Reach(start=v.mid, end=v.end)]})
    want = {(a, b) for a in range(4) for b in (1, 2, 3)}
    assert {(int(a[1:]), int(b[1:])) for a, b in rows(Reach().query(db), "start", "end")} == want
    assert rows(Reach(start=Ref("n0")).query(db), "end") == [("n1",), ("n2",), ("n3",)]
    # a filter after recursion holds for its answers
    Late = fact(end=object).where(lambda v: [Reach(start=Ref("n0"), end=v.end), same.not_(v.end, Ref("n2"))])
    assert rows(Late().query(db), "end") == [("n1",), ("n3",)]


def test_range_and_runaway(spark):
    db = TripleSource.create(spark, [("a/b", "x", 1)])
    Range = fact(n=int, from_=int, to=int).when(
        lambda v: {
            "base": [Data.less(this=v["from"], than=v.to), Data.same(this=v["from"], as_=v.n), Range.claim(n=v.n, from_=v["from"], to=v.to)],
            "step": [Data.less(this=v["from"], than=v.to), Math.Sum(of=v["from"], with_=1, is_=v.m), Range(n=v.n, from_=v.m, to=v.to)],
        }
    )
    got = rows(Range(from_=1, to=5).query(db), "n", "from", "this")
    assert [r[:2] for r in got] == [(n, 1) for n in (1, 2, 3, 4)]
    assert [r[2] for r in got] == [Range.assert_(n=n, from_=n, to=5).this.id for n in (1, 2, 3, 4)]
    with pytest.raises(ReferenceError):
        Range(to=5).query(db)
    Up = fact(n=int).when(lambda v: {"a": [same(0, v.n)], "b": [Up(n=v.m), Math.Sum(of=v.m, with_=1, is_=v.n)]})
    with pytest.raises(RuntimeError):
        Up().query(db, limit=4)


def test_tautologies(spark):
    db = TripleSource.create(spark, [("meta/name", i, n) for i, n in enumerate("abc")])
    Meta = fact("meta", name=str)
    T = Meta.where(lambda v: [Meta(this=v.this, name=v.name), T(this=v.this, name=v.name)])
    assert rows(T().query(db), "name") == [("a",), ("b",), ("c",)]
    P = fact(name=str, extra=object).where(lambda v: [Meta(this=v.this, name=v.name), P(this=v.this, name=v.name, extra=v.extra)])
    assert rows(P().query(db), "name") == []


def test_optional_default_is_null(spark):
    db = TripleSource.create(spark, [("list/next", Ref("1"), Ref("2")), ("meta/name", Ref("1"), "a"), ("meta/name", Ref("2"), "b")])
    Implicit = fact(at=str, is_=object, default=None).when(lambda v: {"explicit": [Collection(this=v.this, at=v.at, of=v["is"]), Data.Type(of=v.default, is_=v._)], "implicit": [Collection.not_(this=v.this, at=v.at), Data.same(this=v.default, as_=v["is"])]})
    Node = fact(name=str, next=object).where(lambda v: [fact("meta", name=str)(this=v.e, name=v.name), Implicit(this=v.e, at="list/next", is_=v.next, default=None)])
    got = {r["name"]: r["next"] for r in Node().query(db).collect()}
    assert got["a"]["s"] == "2" and got["b"]["t"] == "null"


def test_state_machine(spark):
    Counter, Increment = fact("counter", count=int), fact("increment", command=object)
    New = Counter.when(
        lambda v: {"new": [Counter.not_(this=v.this), same(Ref("c"), v.this), same(0, v.count)], "next": [Increment(command=v.this), Counter(this=v.this, count=v.last), Math.Sum(of=v.last, with_=1, is_=v.count)]}
    )
    db = TripleSource.create(spark, [("x/y", "z", 1)])
    first = Counter.assert_(this=Ref("c"), count=0)
    db = db.transact(first)
    assert rows(Counter().query(db), "count") == [(0,)]
    db = db.transact(Increment.assert_(command=Ref("c")))
    nexts = fact("next", count=int).where(lambda v: [Increment(command=v.this), Counter(this=v.this, count=v.last), Math.Sum(of=v.last, with_=1, is_=v.count)])
    assert rows(nexts().query(db), "count") == [(1,)]
    db = db.transact([*first.retract(), *Counter.assert_(this=Ref("c"), count=1)])
    assert rows(Counter().query(db), "count") == [(1,)] and db.version == 3
    assert New.cells == ["this", "count"]


def test_transactions_are_idempotent(spark):
    db = TripleSource.create(spark, [("a/b", "x", 1), ("a/b", "x", 1), ("a/b", "x", "1")])
    assert db.df.count() == 2
    again = db.transact([{"assert": ("a/b", "x", 1)}, {"assert": ("a/b", "y", 2)}])
    assert {(r["of"], r["is"]["l"], r["cause"]) for r in again.df.where("is.t = 'integer'").collect()} == {("x", 1, "0"), ("y", 2, "1")}
    assert again.transact([{"retract": ("a/b", "x", 1)}, {"retract": ("a/b", "no", 1)}]).df.count() == 2


def test_nested_records_and_collections(spark):
    delegation = lambda cid, *caps: {"ucan/cid": cid, "ucan/capabilities": [{"capability/can": c, "capability/with": w} for c, w in caps]}
    db = TripleSource.create(spark, {"upload": delegation("up", ("upload/add", "alice")), "store": delegation("st", ("store/add", "alice"), ("store/list", "bob"))})
    U, C = fact("ucan", cid=str, capabilities=object), fact("capability", can=str, with_=str)
    D = fact(cid=str, can=str, subject=str).where(lambda v: [U(this=v.u, cid=v.cid, capabilities=v.cs), Collection(this=v.cs, of=v.c), C(this=v.c, can=v.can, with_=v.subject)])
    P = fact(space=str, upload=str, store=str).where(lambda v: [D(subject=v.space, can="upload/add", cid=v.upload), D(subject=v.space, can="store/add", cid=v.store)])
    assert rows(P().query(db), "space", "upload", "store") == [("alice", "up", "st")]
    with pytest.raises(TypeError):
        list(shred({"a": object()}))
    df = spark.createDataFrame([(1, "n", [3, 4], {"k": 1.5}, (True,))], "id int, name string, list array<int>, map map<string,double>, inner struct<flag:boolean>")
    nested = TripleSource.from_nested(df, "thing", "id")
    Thing = fact("thing", name=str, list=object, inner=object)
    Q = fact(at=str, value=object).where(lambda v: [Thing(list=v.l), Collection(this=v.l, at=v.at, of=v.value)])
    assert [(a, x["l"]) for a, x in rows(Q().query(nested), "at", "value")] == [("[0]", 3), ("[1]", 4)]
    assert rows(fact(flag=bool).where(lambda v: [Thing(inner=v.i), fact("thing", flag=bool)(this=v.i, flag=v.flag)])().query(nested), "flag") == [(True,)]


def test_grouping_and_folds(spark):
    lists = {"a": ["x", "y", "z"], "b": ["x", "w"]}
    db = TripleSource.create(spark, [("l/name", n, n) for n in lists] + [("l/item", n, i) for n, items in lists.items() for i in items] + [("l/tag", n, t) for n in lists for t in "pq"])
    L = fact("l", name=str, item=str, tag=str)
    got = {r["name"]: r for r in L.select(lambda v: {"name": v.name, "items": [{"item": v.item}], "tags": [v.tag], "more": {"n": v.name}}).query(db).collect()}
    assert [x["item"] for x in got["a"]["items"]] == ["x", "y", "z"] and got["a"]["tags"] == ["p", "q"] and got["b"]["more"]["n"] == "b"
    assert L.match(name="b").select(lambda v: [v.item]).query(db).first()["items"] == ["w", "x"]
    plain = Fold(list, lambda s, r: s.append(r["item"]), sorted)
    assert fact(name=str, item=str).where(lambda v: [fact("l", name=str, item=str)(name=v.name, item=v.item)]).aggregate(plain).query(db) == ["w", "x", "x", "y", "z"]
    assert {r["name"]: r["n"] for r in fact("l", name=str, item=str).aggregate(by=["name"], n=count_()).query(db).collect()} == {"a": 3, "b": 2}
    assert sorted(fact("l", name=str).map(lambda r: r["name"].upper()).query(db)) == ["A", "B"]


def test_value_types_stay_apart(spark):
    db = TripleSource.create(spark, [("t/v", str(i), x) for i, x in enumerate([1, "1", True, 1.5, None, b"1", Ref("1"), 10**20, "", 0, False, float("nan")])])
    typed = fact(e=object, t=str).where(lambda v: [fact("t", v=object)(this=v.e, v=v.x), Data.Type(of=v.x, is_=v.t)])
    assert {int(e): t for e, t in rows(typed().query(db), "e", "t")} == {0: "integer", 1: "string", 2: "boolean", 3: "float", 4: "null", 5: "bytes", 6: "reference", 7: "bigint", 8: "string", 9: "integer", 10: "boolean"}
    found = lambda x: rows(fact(e=object).where(lambda v: [fact("t", v=object)(this=v.e, v=x)])().query(db), "e")
    assert [found(x) for x in (1, "1", True, None, b"1", "", 0, False)] == [[("0",)], [("1",)], [("2",)], [("4",)], [("5",)], [("8",)], [("9",)], [("10",)]]


def test_planning(spark):
    order = [{"match": {"the": "movie/title", "of": V.movie, "is": V.title}}, {"match": {"the": "movie/cast", "of": V.movie, "is": V.actor}}, {"match": {"the": "person/name", "of": V.actor, "is": "A. S."}}]
    rule = parse_rule({"match": {"title": V.title}, "when": {"where": order}})
    assert to_dict(rule)["when"]["where"] == order
    db = InspectingSource(TripleSource.create(spark, [("person/name", "p", "A. S."), ("movie/cast", "m", Ref("p")), ("movie/title", "m", "T")]))
    df, _ = Compiler(db).rule(rule, {"title": V.t})
    assert [s["the"] for s in db.scans] == ["person/name", "movie/cast", "movie/title"]
    assert [tuple(r) for r in df.collect()] == [("T",)]


def test_errors(spark):
    db = TripleSource.create(spark, [("a/b", "x", 1)])
    A = fact("a", b=int)
    with pytest.raises(ReferenceError, match="does not bind variable"):
        parse_rule({"match": {"x": V.x, "y": V.y}, "when": [{"match": {"of": V.x}}]})
    with pytest.raises(ReferenceError, match="both input and output"):
        parse_rule({"match": {"x": V.x}, "when": [{"match": {"of": V.x, "with": 1, "is": V.x}, "operator": "+"}]})
    with pytest.raises(ReferenceError, match="Unbound"):
        fact(q=int).where(lambda v: [A(this=v.e, b=v.b), Math.Sum(of=v.nowhere, with_=v.b, is_=v.q)])().query(db)
    with pytest.raises(ReferenceError, match="requires binding|omits required"):
        Compiler(db).rule(parse_rule({"match": {"x": V.x}}), {"x": V.y})
    for bad in (lambda: fact("x", _=int), lambda: fact(), lambda: fact("x", this=3), lambda: fact("x", y=[1]), lambda: A.assert_(), lambda: A.assert_(b=1, the="z"), lambda: A(zzz=1)):
        with pytest.raises(TypeError):
            bad()
    B = fact(x=int).where(lambda v: [D(x=v.x)])
    D = fact(x=int).where(lambda v: [B(x=v.x)])
    with pytest.raises(ReferenceError):
        B().query(db)


def test_claims_and_assertions_agree(spark):
    db = TripleSource.create(spark, [("a/b", "x", 1), ("a/c", "x", "é")])
    Copy = fact("copy", b=int, c=str).where(lambda v: [fact("a", b=int, c=str)(b=v.b, c=v.c), Copy.claim(b=v.b, c=v.c)])
    assert rows(Copy().query(db), "this") == [(Copy.assert_(b=1, c="é").this.id,)]
    Kept = fact("copy", b=int).where(lambda v: [fact("a", b=int)(this=v.this, b=v.b)])
    assert rows(Kept().query(db), "this", "b") == [("x", 1)]
    literal = fact("a", b=2, c=str)
    assert rows(literal().query(db), "c") == []

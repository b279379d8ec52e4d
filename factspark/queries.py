"""A query for each operator of the engine over the test tables, and the SQL that gives the same rows."""

from __future__ import annotations

import decimal
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .builder import UTF8, Collection, Data, Math, Text, fact, same
from .catalog import tables
from .functions.formulas import Outcome, python_formula
from .operators import Fold, count_, sum_
from .plans.compiler import Compiler
from .plans.fixpoint import shared_dir
from .plans.ir import Apply, Formula, Rule, Select, parse_rule
from .sources import TripleSource
from .sources.base import CachingSource, InspectingSource
from .terms import V, _
from .values import Bound, constant, plain, tagged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

Region = fact("region", name=str)
Nation = fact("nation", name=str, region=object)
Customer = fact("customer", key=int, name=str, segment=str, nation=object, balance=float)
Supplier = fact("supplier", key=int, name=str, nation=object)
Part = fact("part", key=int, name=str, brand=str, type=str, size=int, price=float)
Order = fact("order", key=int, customer=object, status=str, total=float, priority=str)
Line = fact("lineitem", order=object, part=object, supplier=object, number=int, quantity=float, price=float, ship=str)
Doc = fact("doc", key=int, text=str, lang=str)
Label = fact("label", doc=object, quality=int)
Turn = fact("turn", conversation=int, number=int)


def _add(name: str, sql: str, *relations: str):
    """Register a query: a function of a source over the relations, and of the session, that gives a DataFrame."""

    def register(make):
        QUERIES[name] = lambda spark, sf_dir: make(tables(spark, sf_dir, *relations))
        SQL[name] = sql
        return make

    return register


def _rows(schema, source, *columns: str, **terms) -> DataFrame:
    return schema(**terms).query(source).select(*columns)


@_add("scan_pattern", "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'", "customer")
def scan_pattern(src):
    return _rows(Customer, src, "key", "name", segment="BUILDING")


@_add(
    "scan_variable_attribute",
    "SELECT DISTINCT the, v AS value FROM (SELECT 'nation/name' AS the, n_name AS v FROM nation UNION ALL SELECT 'nation/region', 'region:' || n_regionkey FROM nation)",
    "nation",
)
def scan_variable_attribute(src):
    df, cols = Compiler(src).rule(parse_rule({"match": {"the": V.the, "is": V["is"]}, "when": [{"match": {"the": V.the, "of": V.of, "is": V["is"]}}]}), {"the": V.t, "is": V.i})
    return df.select("the", cols["is"].column["s"].alias("value"))


@_add("tag_scan", "SELECT 'region:' || r_regionkey AS this FROM region", "region")
def tag_scan(src):
    return _rows(fact("region"), src, "this")


@_add("collection_array", "SELECT vec_id AS key, '[' || (i - 1) || ']' AS at, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)", "vec")
def collection_array(src):
    Vec = fact("vec", key=int, embedding=object)
    Cell = fact(key=int, at=str, value=object).where(lambda v: [Vec(key=v.key, embedding=v.e), Collection(this=v.e, at=v.at, of=v.value)])
    df = Cell().query(src)
    return df.select("key", "at", F.coalesce(F.col("value.d"), F.col("value.l").cast("double")).alias("value"))


@_add("assert_retract", "SELECT n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 UNION SELECT 'new ' || i FROM range(3) AS r(i)", "nation")
def assert_retract(src):
    Name = fact("nation", name=str)
    key = lambda n: n.rpartition("_")[2]
    known = [(f"nation:{key(n)}", n) for n in (r["n_name"] for r in src.relations["nation"].df.select("n_name").collect())]
    store = TripleSource.create(src.spark, [("nation/name", of, n) for of, n in known])
    new = [x for i in range(3) for x in Name.assert_(name=f"new {i}")]
    gone = [{"retract": ("nation/name", of, n)} for of, n in known if int(key(n)) % 5 == 0]
    absent = list(Name.assert_(name="never there").retract())
    return _rows(Name, store.transact(new + gone + absent), "name")


@_add(
    "join_star",
    "SELECT DISTINCT c_name AS customer, o_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS number, l_quantity AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY'",
    "customer", "order", "lineitem",
)
def join_star(src):
    Q = fact(customer=str, order_key=int, number=int, quantity=float).where(
        lambda v: [Customer(this=v.c, name=v.customer, segment="MACHINERY"), Order(this=v.o, customer=v.c, key=v.order_key), fact("lineitem", order=object, number=int, quantity=float)(order=v.o, number=v.number, quantity=v.quantity)]
    )
    return _rows(Q, src, "customer", "order_key", "number", "quantity")


@_add("join_chain3", "SELECT DISTINCT r_name AS region, n_name AS nation, s_name AS supplier FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey", "region", "nation", "supplier")
def join_chain3(src):
    Q = fact(region=str, nation=str, supplier=str).where(lambda v: [Region(this=v.r, name=v.region), Nation(this=v.n, region=v.r, name=v.nation), Supplier(nation=v.n, name=v.supplier)])
    return _rows(Q, src, "region", "nation", "supplier")


@_add("join_self_unify", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name <> b.n_name", "nation")
def join_self_unify(src):
    Q = fact(a=str, b=str).where(lambda v: [Nation(name=v.a, region=v.r), Nation(name=v.b, region=v.r), same.not_(v.a, v.b)])
    return _rows(Q, src, "a", "b")


@_add("join_theta", "SELECT DISTINCT a.p_partkey AS cheap, b.p_partkey AS dear FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_retailprice < b.p_retailprice", "part")
def join_theta(src):
    Q = fact(cheap=int, dear=int).where(lambda v: [Part(key=v.cheap, brand=v.b, type=v.t, price=v.x), Part(key=v.dear, brand=v.b, type=v.t, price=v.y), Data.less(this=v.x, than=v.y)])
    return _rows(Q, src, "cheap", "dear")


@_add("cartesian", "SELECT DISTINCT r_name AS region, c_mktsegment AS segment FROM region CROSS JOIN customer", "region", "customer")
def cartesian(src):
    Segment = fact(segment=str).where(lambda v: [Customer(segment=v.segment)])
    pairs = fact(region=str, segment=str).where(lambda v: [Region(name=v.region), Segment(segment=v.segment)])
    return _rows(pairs, src, "region", "segment")


@_add("semi_join", "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "customer", "order")
def semi_join(src):
    Q = fact(name=str).where(lambda v: [Customer(this=v.c, name=v.name), Order(customer=v.c, status="F")])
    return _rows(Q, src, "name")


@_add("anti_join", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')", "customer", "order")
def anti_join(src):
    Q = fact(name=str).where(lambda v: [Customer(this=v.c, name=v.name), Order.not_(customer=v.c, status="F")])
    return _rows(Q, src, "name")


@_add("optional_default", "SELECT d.doc_id AS key, CAST(coalesce(l.quality, -1) AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)", "doc", "label")
def optional_default(src):
    Known = fact(doc=object, quality=int).where(lambda v: [Label(doc=v.doc, quality=v.quality)])
    Q = fact(key=int, quality=int).when(
        lambda v: {"known": [fact("doc", key=int)(this=v.d, key=v.key), Known(doc=v.d, quality=v.quality)], "unknown": [fact("doc", key=int)(this=v.d, key=v.key), Known.not_(doc=v.d), same(-1, v.quality)]}
    )
    return _rows(Q, src, "key", "quality")


def _either(v):
    return {"segment": [Customer(key=v.key, segment="FURNITURE")], "nation": [Customer(key=v.key, nation=v.n), Nation(this=v.n, name="NATION_3")]}


@_add("union_disjunction", "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'FURNITURE' UNION SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'", "customer", "nation")
def union_disjunction(src):
    return _rows(fact(key=int).when(_either), src, "key")


@_add("intersect", "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'FURNITURE' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "customer", "order")
def intersect(src):
    Open = fact(key=int).where(lambda v: [Order(customer=v.c, status="O"), Customer(this=v.c, key=v.key)])
    return _rows(fact(key=int).where(lambda v: [Customer(key=v.key, segment="FURNITURE"), Open(key=v.key)]), src, "key")


@_add("except_", "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'FURNITURE' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "customer", "order")
def except_(src):
    Open = fact(key=int).where(lambda v: [Order(customer=v.c, status="O"), Customer(this=v.c, key=v.key)])
    return _rows(fact(key=int).where(lambda v: [Customer(key=v.key, segment="FURNITURE"), Open.not_(key=v.key)]), src, "key")


for _name, _sign, _op in (("gt", ">", Data.greater), ("ge", ">=", Data.greater_or_equal), ("lt", "<", Data.less), ("le", "<=", Data.less_or_equal)):

    @_add(f"filter_{_name}", f"SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size {_sign} 25", "part")
    def _filter(src, op=_op):
        return _rows(fact(key=int, size=int).where(lambda v: [Part(key=v.key, size=v.size), op(this=v.size, than=25)]), src, "key", "size")


@_add("filter_eq", "SELECT p_partkey AS key FROM part WHERE p_size = 7", "part")
def filter_eq(src):
    return _rows(fact(key=int).where(lambda v: [Part(key=v.key, size=v.s), Data.same(this=v.s, as_=7)]), src, "key")


@_add("filter_ne", "SELECT p_partkey AS key FROM part WHERE p_size <> 7", "part")
def filter_ne(src):
    return _rows(fact(key=int).where(lambda v: [Part(key=v.key, size=v.s), Data.same.not_(this=v.s, as_=7)]), src, "key")


@_add("bool_not", "SELECT CAST(b AS BOOLEAN) AS b, NOT b AS negated FROM (VALUES (true), (false)) AS t(b)", "region")
def bool_not(src):
    store = TripleSource.create(src.spark, [("flag/on", "1", True), ("flag/on", "2", False), ("flag/on", "3", "text")])
    Q = fact(b=bool, negated=bool).where(lambda v: [fact("flag", on=bool)(on=v.b), Data.not_(of=v.b, is_=v.negated)])
    df = Q().query(store)
    return df.select(F.col("b.b").alias("b"), "negated")


@_add("data_type", "SELECT 'customer/balance' AS the, CASE WHEN c_acctbal = floor(c_acctbal) THEN 'integer' ELSE 'float' END AS type, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'customer/' || x, t, count(*) FROM customer, (VALUES ('key', 'integer'), ('name', 'string'), ('nation', 'reference'), ('segment', 'string')) AS v(x, t) GROUP BY 1, 2", "customer")
def data_type(src):
    rule = parse_rule({"match": {"of": V.of, "the": V.the, "type": V.t}, "when": [{"match": {"the": V.the, "of": V.of, "is": V["is"]}}, {"match": {"of": V["is"], "is": V.t}, "operator": "data/type"}]})
    df, _ = Compiler(src).rule(rule, {"of": V.a, "the": V.b, "type": V.c})
    return df.groupBy("the", "type").agg(count_().alias("n"))


_CANONICAL = "'name:string:' || length(c_name) || ':' || c_name || ';segment:string:' || length(c_mktsegment) || ':' || c_mktsegment || ';'"


@_add("entity_hash", f"SELECT c_custkey AS key, sha256({_CANONICAL}) AS hash FROM customer", "customer")
def entity_hash(src):
    Q = fact(key=int, hash=object).where(lambda v: [Customer(key=v.key, name=v.n, segment=v.s), Data.Fact(name=v.n, segment=v.s, is_=v.hash)])
    return _rows(Q, src, "key", "hash")


@_add("claim_skolem", f"SELECT c_name AS name, c_mktsegment AS segment, sha256({_CANONICAL} || 'the:string:4:card;') AS this FROM customer", "customer")
def claim_skolem(src):
    Card = fact("card", name=str, segment=str).where(lambda v: [Customer(name=v.name, segment=v.segment), Card.claim(name=v.name, segment=v.segment)])
    return _rows(Card, src, "name", "segment", "this")


@_add("claim_is_assert", "SELECT s_name AS name, s_acctbal AS balance, true AS same FROM supplier", "supplier")
def claim_is_assert(src):
    Card = fact("card", name=str, balance=float).where(lambda v: [Supplier(this=v.s, name=v.name), fact("supplier", balance=float)(this=v.s, balance=v.balance), Card.claim(name=v.name, balance=v.balance)])
    claimed = Card().query(src)
    held = src.relations["supplier"].df.select("s_name", "s_acctbal").collect()
    asserted = [(fact("card", name=str, balance=float).assert_(name=r[0], balance=r[1]).this.id,) for r in held]
    known = src.spark.createDataFrame(asserted, "asserted string")
    return claimed.join(known, F.col("this") == F.col("asserted"), "left").select("name", "balance", F.col("asserted").isNotNull().alias("same"))


@_add("claim_floats", "SELECT count(*) AS n, true AS same FROM range(13)", "region")
def claim_floats(src):
    values = [1e-05, 2500000000000.25, 1.5, -0.1, 3.0, 1e300, 5e-324, 2.0**-1022, 1 - 2**-53, 123456789.123, 1e22, 0.0, -7.25]
    store = TripleSource.create(src.spark, [("x/of", str(i), x) for i, x in enumerate(values)])
    X = fact("x", of=float)
    Card = fact("card", of=float).where(lambda v: [X(of=v.of), Card.claim(of=v.of)])
    here = {fact("card", of=float).assert_(of=x).this.id for x in values}
    return Card().query(store).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("this").isin(list(here))).alias("same"))


@_add("claim_explicit_this", "SELECT 'nation:' || n_nationkey AS this, n_name AS label FROM nation", "nation")
def claim_explicit_this(src):
    Tag = fact("tag", label=str).where(lambda v: [Nation(this=v.n, name=v.label), Tag.claim(this=v.n, label=v.label)])
    return _rows(Tag, src, "this", "label")


@_add("argument_twice", "SELECT n_name AS name FROM nation WHERE n_nationkey = n_regionkey", "nation")
def argument_twice(src):
    Pair = parse_rule({"match": {"a": V.a, "b": V.b, "name": V.name}, "when": [{"match": {"the": "nation/region", "of": V.n, "is": V.r}}, {"match": {"the": "nation/name", "of": V.n, "is": V.name}}, {"match": {"of": V.n, "start": 7, "end": 99, "is": V.a}, "operator": "key"}, {"match": {"of": V.r, "start": 7, "end": 99, "is": V.b}, "operator": "key"}]})
    key = lambda i: Outcome(F.substring_index(plain(i["of"]).column, ":", -1), "string")
    df, _ = Compiler(src, {"key": key}).rule(Rule({"name": V.x}, {"where": [Apply(Pair, {"a": V.s, "b": V.s, "name": V.x})]}), {"name": V.x})
    return df.select("name")


@_add("name_twice", "SELECT r_name AS a, r_name AS b FROM region", "region")
def name_twice(src):
    Equal = Rule({"this": V.a, "as": V.a})
    rule = Rule({"a": V.x, "b": V.y}, {"where": [Select("region/name", V.r, V.x), Apply(Equal, {"this": V.x, "as": V.y})]})
    df, _ = Compiler(src).rule(rule, {"a": V.x, "b": V.y})
    return df.select("a", "b")


@_add("wildcard", "SELECT DISTINCT c_mktsegment AS segment FROM customer", "customer")
def wildcard(src):
    return _rows(fact(segment=str).where(lambda v: [Customer(this=_, name=_, segment=v.segment)]), src, "segment")


@_add("join_through_same", "SELECT c_name AS customer, s_name AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_mktsegment = 'BUILDING'", "customer", "supplier")
def join_through_same(src):
    Q = fact(customer=str, supplier=str).where(lambda v: [Customer(name=v.customer, segment="BUILDING", nation=v.n), Supplier(name=v.supplier, nation=v.m), same(v.n, v.m)])
    return _rows(Q, src, "customer", "supplier")


@_add("unit_rule", "SELECT r_name AS name FROM region", "region")
def unit_rule(src):
    Any = Rule({"this": V.t})
    df, _ = Compiler(src).rule(Rule({"name": V.n}, {"where": [Select("region/name", V.r, V.n), Apply(Any, {"this": V.n})]}), {"name": V.n})
    return df.select("name")


@_add("nested_object", "SELECT c_custkey AS key, c_name AS name, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'", "customer", "nation")
def nested_object(src):
    n = src.relations["nation"].df
    c = src.relations["customer"].df.where("c_mktsegment = 'BUILDING'")
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("label")).alias("at"))
    store = TripleSource.from_nested(rows, "who", "c_custkey")
    Q = fact(key=int, name=str, nation=str).where(lambda v: [fact("who", key=int, name=str, at=object)(key=v.key, name=v.name, at=v.place), fact("who", label=str)(this=v.place, label=v.nation)])
    return _rows(Q, store, "key", "name", "nation")


@_add("json_round_trip", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def json_round_trip(src):
    from .sources.files import as_json, read_json

    n, r = src.relations["nation"].df, src.relations["region"].df
    triple = lambda df, the, of, value, kind: df.select(F.lit(the).alias("the"), of.alias("of"), tagged(Bound(value, kind)).alias("is"), F.lit("0").alias("cause"))
    of = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    facts = triple(n, "nation/name", of("n", "n_nationkey"), F.col("n_name"), "string").unionByName(triple(n, "nation/region", of("n", "n_nationkey"), of("r", "n_regionkey"), "reference")).unionByName(triple(r, "region/name", of("r", "r_regionkey"), F.col("r_name"), "string"))
    path = f"{shared_dir(src.spark)}/facts-{uuid.uuid4().hex}"
    as_json(TripleSource(facts)).write.text(path)
    Q = fact(name=str, region=str).where(lambda v: [Nation(name=v.name, region=v.r), Region(this=v.r, name=v.region)])
    return _rows(Q, read_json(src.spark, path), "name", "region")


@_add("csv_load", "SELECT p_partkey AS key, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part", "part")
def csv_load(src):
    from .sources.files import read_csv

    path = f"{shared_dir(src.spark)}/parts-{uuid.uuid4().hex}"
    src.relations["part"].df.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).write.option("header", True).csv(path)
    store = read_csv(src.spark, path, "part", ["key"], schema="key long, name string, size long")
    return _rows(fact("part", key=int, name=str, size=int), store, "key", "name", "size")


@_add("inspected_and_cached", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def inspected_and_cached(src):
    Q = fact(nation=str, region=str).where(lambda v: [Nation(name=v.nation, region=v.r), Region(this=v.r, name=v.region)])
    return _rows(Q, InspectingSource(CachingSource(src)), "nation", "region")


@_add("python_udf", "SELECT p_partkey AS key, unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_size = 7", "part")
def python_udf(src):
    words = python_formula(lambda text: text.split(" "), "string", "string", ["of"])
    Q = fact(key=int, word=str).where(lambda v: [Part(key=v.key, name=v.name, size=7), Formula("words", {"of": v.name}, v.word)])
    return Q().query(src, {"words": words}).select("key", "word")


@_add("fold_by_group", "SELECT p_brand AS brand, count(*) AS n, CAST(max(p_size) AS BIGINT) AS largest FROM part GROUP BY 1", "part")
def fold_by_group(src):
    fold = Fold(lambda: [0, 0], lambda s, r: [s[0] + 1, max(s[1], r["size"])], lambda s: {"n": s[0], "largest": s[1]}, lambda a, b: [a[0] + b[0], max(a[1], b[1])])
    rows = fact(key=int, brand=str, size=int).where(lambda v: [Part(key=v.key, brand=v.brand, size=v.size)])
    return rows.aggregate(fold, by=["brand"], returns="n long, largest long").query(src)


@_add("glob_match", "SELECT p_partkey AS key, p_name AS name FROM part WHERE p_name GLOB '*ring'", "part")
def glob_match(src):
    return _rows(fact(key=int, name=str).where(lambda v: [Part(key=v.key, name=v.name), Text.match(this=v.name, pattern="*ring")]), src, "key", "name")


@_add("glob_not", "SELECT p_partkey AS key FROM part WHERE NOT p_name GLOB '*r?ng'", "part")
def glob_not(src):
    return _rows(fact(key=int).where(lambda v: [Part(key=v.key, name=v.name), Text.not_(this=v.name, pattern="*r?ng")]), src, "key")


@_add("glob_from_data", "SELECT a.n_name AS pattern, b.n_name AS name FROM nation a, nation b WHERE b.n_name GLOB (a.n_name || '*')", "nation")
def glob_from_data(src):
    Q = fact(pattern=str, name=str).where(lambda v: [Nation(name=v.pattern), Text.Concat(of=v.pattern, with_="*", is_=v.glob), Nation(name=v.name), Text.match(this=v.name, pattern=v.glob)])
    return _rows(Q, src, "pattern", "name")


def _text(name: str, sql: str, make, kind: object = str, relation=None, columns=("key", "out")):
    source, schema, column = relation or ("part", Part, "name")

    @_add(name, sql, source)
    def query(src):
        return _rows(fact(key=int, out=kind).where(lambda v: [schema(key=v.key, **{column: v.x}), make(v)]), src, *columns)


_DOC = ("doc", Doc, "text")
_text("text_concat", "SELECT p_partkey AS key, p_name || '!' AS out FROM part", lambda v: Text.Concat(of=v.x, with_="!", is_=v.out))
_text("text_words", "SELECT DISTINCT doc_id AS key, unnest(regexp_split_to_array(text, '\\s+')) AS out FROM documents", lambda v: Text.Words(of=v.x, is_=v.out), relation=_DOC)
_text("text_lines", "SELECT DISTINCT doc_id AS key, unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')) AS out FROM documents", lambda v: Text.Lines(of=v.x, is_=v.out), relation=_DOC)
_text("text_upper", "SELECT p_partkey AS key, upper(p_name) AS out FROM part", lambda v: Text.UpperCase(of=v.x, is_=v.out))
_text("text_lower", "SELECT p_partkey AS key, lower(p_type) AS out FROM part", lambda v: Text.LowerCase(of=v.x, is_=v.out), relation=("part", Part, "type"))
_text("text_trim", "SELECT p_partkey AS key, p_name AS out FROM part", lambda v: [Text.Concat(of=" \n\t", with_=v.x, is_=v.a), Text.Concat(of=v.a, with_="  ", is_=v.b), Text.Trim(of=v.b, is_=v.out)])
_text("text_trim_start", "SELECT p_partkey AS key, p_name || ' ' AS out FROM part", lambda v: [Text.Concat(of=" ", with_=v.x, is_=v.a), Text.Concat(of=v.a, with_=" ", is_=v.b), Text.TrimStart(of=v.b, is_=v.out)])
_text("text_trim_end", "SELECT p_partkey AS key, ' ' || p_name AS out FROM part", lambda v: [Text.Concat(of=" ", with_=v.x, is_=v.a), Text.Concat(of=v.a, with_=" ", is_=v.b), Text.TrimEnd(of=v.b, is_=v.out)])
_text("text_includes", "SELECT p_partkey AS key FROM part WHERE contains(p_name, 'an')", lambda v: [Text.includes(this=v.x, slice="an"), Data.same(this="", as_=v.out)], columns=("key",))
_text("text_slice", "SELECT p_partkey AS key, p_name[-4:-2] AS out FROM part", lambda v: Text.Slice(of=v.x, start=-4, end=-1, is_=v.out))
_text("text_slice_utf16", "SELECT p_partkey AS key, chr(128512) || substr(p_name, 1, 2) AS out FROM part", lambda v: [Text.Concat(of="\U0001f600", with_=v.x, is_=v.a), Text.Slice(of=v.a, start=0, end=4, is_=v.out)])
_text("text_length", "SELECT doc_id AS key, CAST(length(text) AS BIGINT) AS out FROM documents", lambda v: Text.Length(of=v.x, is_=v.out), int, _DOC)
_text("utf8_roundtrip", "SELECT doc_id AS key, text AS out FROM documents", lambda v: [UTF8.FromText(of=v.x, is_=v.b), UTF8.ToText(of=v.b, is_=v.out)], relation=_DOC)


def _math(name: str, sql: str, make, kind: object = int):
    @_add(name, f"SELECT p_partkey AS key, {sql}", "part")
    def query(src):
        return _rows(fact(key=int, out=kind).where(lambda v: [Part(key=v.key, size=v.x), make(v)]), src, "key", "out")


_BY = lambda v: [Math.Modulo(of=v.x, by=3, is_=v.r)]
_math("math_add", "CAST(p_size + 10 AS BIGINT) AS out FROM part", lambda v: Math.Sum(of=v.x, with_=10, is_=v.out))
_math("math_sub", "CAST(p_size - 10 AS BIGINT) AS out FROM part", lambda v: Math.Subtraction(of=v.x, by=10, is_=v.out))
_math("math_mul", "CAST(p_size * 3 AS BIGINT) AS out FROM part", lambda v: Math.Multiplication(of=v.x, by=3, is_=v.out))
_math("math_div", "CAST(p_size AS DOUBLE) / (p_size % 3) AS out FROM part WHERE p_size % 3 <> 0", lambda v: [*_BY(v), Math.Division(of=v.x, by=v.r, is_=v.out)], float)
_math("math_mod", "CAST(-p_size % (p_size % 3) AS BIGINT) AS out FROM part WHERE p_size % 3 <> 0", lambda v: [*_BY(v), Math.Subtraction(of=0, by=v.x, is_=v.n), Math.Modulo(of=v.n, by=v.r, is_=v.out)])
_math("math_pow", "CAST(p_size AS DOUBLE) ** 2 AS out FROM part", lambda v: Math.Power(of=v.x, exponent=2, is_=v.out), float)
_math("math_abs", "CAST(abs(p_size - 30) AS BIGINT) AS out FROM part", lambda v: [Math.Subtraction(of=v.x, by=30, is_=v.n), Math.Absolute(of=v.n, is_=v.out)])


@_add("math_pow_exact", "SELECT p_partkey AS key, '12157665459056928801' AS out FROM part", "part")
def math_pow_exact(src):
    big = {"of": decimal.Decimal(3), "by": decimal.Decimal(40)}
    df = fact(key=int, out=object).where(lambda v: [Part(key=v.key), Formula("**", big, v.out)])().query(src)
    return df.select("key", F.col("out").cast("string").alias("out"))


@_add("group_nested", "SELECT n_name AS nation, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS suppliers, count(DISTINCT s_name) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1", "nation", "supplier")
def group_nested(src):
    Q = fact(nation=str, supplier=str).where(lambda v: [Supplier(name=v.supplier, nation=v.n), Nation(this=v.n, name=v.nation)])
    df = Q.select(lambda v: {"nation": v.nation, "suppliers": [{"name": v.supplier}]}).query(src)
    return df.select("nation", F.array_join("suppliers.name", ",").alias("suppliers"), F.size("suppliers").cast("long").alias("n"))


@_add("group_list", "SELECT string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer", "customer")
def group_list(src):
    return fact(segment=str).where(lambda v: [Customer(segment=v.segment)]).select(lambda v: [v.segment]).query(src).select(F.array_join("items", ",").alias("segments"))


@_add("fold_count_sum", "SELECT c_mktsegment AS segment, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", "customer", "order")
def fold_count_sum(src):
    Q = fact(segment=str, order=object, total=float).where(lambda v: [Order(this=v.order, customer=v.c, total=v.total), Customer(this=v.c, segment=v.segment)])
    return Q.aggregate(by=["segment"], orders=count_(), total=sum_("total")).query(src).select("segment", "orders", F.round("total", 2).alias("total"))


@_add("fold_user", "SELECT count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total FROM part", "part")
def fold_user(src):
    fold = Fold(lambda: [0, 0], lambda s, r: [s[0] + 1, s[1] + r["size"]], tuple, lambda a, b: [a[0] + b[0], a[1] + b[1]])
    n, total = fact(key=int, size=int).where(lambda v: [Part(key=v.key, size=v.size)]).aggregate(fold).query(src)
    return src.spark.createDataFrame([(int(n), int(total))], "n long, total long")


def _next(v):
    return [Turn(conversation=v.conversation, number=v.at), Math.Sum(of=v.at, with_=1, is_=v.to), Turn(conversation=v.conversation, number=v.to)]


Next = fact(conversation=int, at=int, to=int).where(_next)
Later = fact(conversation=int, at=int, to=int).when(
    lambda v: {"base": [Next(conversation=v.conversation, at=v.at, to=v.to)], "step": [Next(conversation=v.conversation, at=v.at, to=v.m), Later(conversation=v.conversation, at=v.m, to=v.to)]}
)
_PAIRS = "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn"


@_add("closure_list", f"SELECT a.conv_id AS conversation, a.turn AS at, b.turn AS \"to\" {_PAIRS}", "turn")
def closure_list(src):
    return _rows(Later, src, "conversation", "at", "to")


@_add("closure_filtered", f"SELECT a.conv_id AS conversation, b.turn AS \"to\" {_PAIRS} WHERE a.turn = 0 AND b.turn > 2", "turn")
def closure_filtered(src):
    Q = fact(conversation=int, to=int).where(lambda v: [Later(conversation=v.conversation, at=0, to=v.to), Data.greater(this=v.to, than=2)])
    return _rows(Q, src, "conversation", "to")


@_add("closure_nonlinear", f"SELECT a.conv_id AS conversation, a.turn AS at, b.turn AS \"to\" {_PAIRS}", "turn")
def closure_nonlinear(src):
    Far = fact(conversation=int, at=int, to=int).when(
        lambda v: {"base": [Next(conversation=v.conversation, at=v.at, to=v.to)], "step": [Far(conversation=v.conversation, at=v.at, to=v.m), Far(conversation=v.conversation, at=v.m, to=v.to)]}
    )
    return _rows(Far, src, "conversation", "at", "to")


@_add("range_generate", "SELECT CAST(i AS BIGINT) AS n FROM range(1, 9) AS r(i)", "region")
def range_generate(src):
    Range = fact(n=int, at=int, to=int).when(
        lambda v: {
            "base": [Data.less(this=v.at, than=v.to), Data.same(this=v.at, as_=v.n)],
            "step": [Data.less(this=v.at, than=v.to), Math.Sum(of=v.at, with_=1, is_=v.m), Range(n=v.n, at=v.m, to=v.to)],
        }
    )
    return _rows(Range, src, "n", at=1, to=9)


@_add("tautology", "SELECT n_name AS name FROM nation", "nation")
def tautology(src):
    Q = fact(name=str).where(lambda v: [Nation(name=v.name), Q(name=v.name)])
    return _rows(Q, src, "name")


@_add("induction_step", "SELECT l_linenumber + 1 AS number FROM (SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem) UNION SELECT CAST(0 AS BIGINT)", "lineitem")
def induction_step(src):
    Count = fact(number=int).when(lambda v: {"start": [Data.same(this=0, as_=v.number)], "next": [fact("lineitem", number=int)(number=v.n), Math.Sum(of=v.n, with_=1, is_=v.number), Count(number=v.number)]}).inductive
    return _rows(Count, src, "number")


@_add("rule_composition", "SELECT DISTINCT n_name AS nation, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_size = 10", "nation", "supplier", "part", "lineitem")
def rule_composition(src):
    Sold = fact(nation=object, brand=str, size=int).where(lambda v: [fact("lineitem", part=object, supplier=object)(part=v.p, supplier=v.s), Part(this=v.p, brand=v.brand, size=v.size), Supplier(this=v.s, nation=v.nation)])
    Q = fact(nation=str, brand=str).where(lambda v: [Sold(nation=v.n, brand=v.brand, size=10), Nation(this=v.n, name=v.nation)])
    return _rows(Q, src, "nation", "brand")


@_add("map_rows", "SELECT r_name || ' (' || r_regionkey || ')' AS label FROM region", "region")
def map_rows(src):
    return Region.map(lambda r: {"label": f"{r['name']} ({r['this'].split(':')[1]})"}).frame(src, "label string")


@_add(
    "flagship",
    """SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE c_mktsegment = 'BUILDING' AND n_name GLOB 'NATION_1*'
      AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50) GROUP BY 1""",
    "customer", "order", "lineitem", "nation",
)
def flagship(src):
    Q = fact(nation=str, order=object, total=float).where(
        lambda v: [
            Customer(this=v.c, segment="BUILDING", nation=v.n),
            Nation(this=v.n, name=v.nation),
            Text.match(this=v.nation, pattern="NATION_1*"),
            Order(this=v.order, customer=v.c, total=v.total),
            fact("lineitem", order=object, quantity=float).not_(order=v.order, quantity=50.0),
        ]
    )
    return Q.aggregate(by=["nation"], orders=count_(), total=sum_("total")).query(src).select("nation", "orders", F.round("total", 2).alias("total"))


__all__ = ["QUERIES", "SQL", "constant"]

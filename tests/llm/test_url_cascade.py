import random

import duckdb
from pyspark.sql import functions as F

from factspark.llm import queries, url_cascade
from factspark.llm.url_cascade import Rule

RULES = [Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "x://example.org/en/12#a", "x://notexample.org/es/", "x://com/fr/", "x://a.com/fr", "x://a.com?/fr/", "a://b://c.com/de/1", "x://spam.example.com:80/de/", "x://spam.example.com/", "x://sub.spam.example.com", "x://org#", "x://.org/", "x://org./", "x://É.org/É", "x://exam\nple.org/e\ns/"]


def brute(url, listed):
    host, path = url_cascade.split_url(url)
    best = max((r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)), key=lambda r: len(r.key), default=None)
    bad = any(host == h or host.endswith("." + h) for h in listed)
    return host, path, best and best.key, best.action if best else "block" if bad else "allow"


def test_split():
    assert url_cascade.split_url("a://B.c/d?e#f") == ("b.c", "/d")
    assert url_cascade.split_url("a://b#/c") == ("b", "")
    assert url_cascade.split_url(None) == url_cascade.split_url("a:/b") == ("", "")


def test_judge_is_brute_force(spark):
    r = random.Random(4)
    urls = URLS + [f"http://{r.choice(['', 'a.', 'b.c.'])}{r.choice(['spam', 'good', 'x', str(r.randint(0, 400))])}.{r.choice(['example.', ''])}{r.choice(['org', 'com', 'net'])}/{r.choice(['es', 'fr', 'de', 'en'])}/{r.randint(0, 30)}" for _ in range(1500)]
    listed = ["spam.example.com", *(f"{i}.net" for i in range(0, 400, 3)), "spam.example.com"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[-1])], "page_id long, url string")
    made = url_cascade.build_filter(pages, RULES, spark.createDataFrame([(h,) for h in listed] + [(None,)], "h string"))
    assert len(made.hosts.levels) > 1  # false positives were encoded, and theirs
    got = {r.page_id: tuple(r)[1:] for r in url_cascade.judge(pages, made).collect()}
    assert got == {i: brute(u, listed) for i, u in [*enumerate(urls), (None, urls[-1])]}


def test_cascade_is_exact(spark):
    listed, rest = [f"l{i}" for i in range(700)], [f"u{i}" for i in range(20_000)]

    def universe(through):
        low, high = url_cascade.hashed(listed + rest)
        keep = through(low, high)
        return spark.createDataFrame(list(zip(low[keep].astype("int64").tolist(), high[keep].astype("int64").tolist())), "low long, high long")

    cascade = url_cascade.build(spark.createDataFrame([(k,) for k in listed], "k string"), universe)
    assert cascade.contains(*url_cascade.hashed(listed)).all() and not cascade.contains(*url_cascade.hashed(rest)).any()
    assert not url_cascade.build(spark.createDataFrame([], "k string"), universe).contains(*url_cascade.hashed(rest)).any()


def test_large_list(spark):
    hosts = queries.listed_hosts(spark)
    urls = [f"http://{r}.example.net/" for i in range(3000) for r in (f"listed-{40 * i}", f"unlisted-{i}")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    made = url_cascade.build_filter(pages, RULES, hosts)
    assert len(made.hosts.levels) > 2
    got = {r.page_id: r.verdict for r in url_cascade.judge(pages, made).collect()}
    assert got == {i: "block" if i % 2 == 0 and i // 2 * 40 < queries.LISTED_NUMBERED else "allow" for i in range(6000)}


def test_a_level_gives_its_words_once_however_keys_are_dealt(spark):
    low, high = url_cascade.hashed([str(i) for i in range(4000)])
    keys = spark.createDataFrame(list(zip(low.astype("int64").tolist(), high.astype("int64").tolist())), "low long, high long").repartition(40)
    level = url_cascade._level(keys, 4000, url_cascade.FIRST_RATE, 0)
    assert url_cascade._set_words(keys, 4000, len(level.bits), level.probes, 0).count() <= len(level.bits)
    assert level.holds(low, high).all()


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, host int")
    made = url_cascade.build_filter(pages, RULES, spark.createDataFrame([("h",)], "h string"))
    assert url_cascade.judge(pages, made).collect() == []


def test_query_is_its_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(URLS)) + [(99, "http://free-bets.example.com/en/1"), (100, "http://a.listed-99999.example.net/x"), (101, "http://listed-100000.example.net/x"), (102, "http://listed-7.example.net.de/x")], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op1_url_filter(spark, str(tmp_path)).orderBy(F.col("page_id")).collect()
    duckdb.sql(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = duckdb.sql(queries.oracle_sql()["op1_url_filter"] + " order by page_id").fetchall()
    assert [tuple(r) for r in got] == want

"""One query for each operator, over its whole table with production parameters, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, chaining, cotrain, ctw, mixing, sigtree, suffix, tokenfile, url_cascade, warc
from .common import fresh_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: The mixture's tree: a source's domain is its number's remainder by 4.
DOMAINS = ["web", "books", "code", "news"]
MIX_LEVELS = [
    ("domain", lambda: F.get(F.array(*map(F.lit, DOMAINS)), F.pmod(F.regexp_extract("source", "([0-9]{1,9})$", 1).try_cast("int"), F.lit(4)))),
    ("lang", lambda: F.col("lang")),
    ("source", lambda: F.col("source")),
]
MIX_WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("code",): 1.0, ("news",): 2.0, **{(d, "en"): 5.0 for d in DOMAINS}, **{(d, "de"): 2.0 for d in DOMAINS}}


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for a mixture of half the corpus's tokens, a scarce leaf up to four times."""
    docs = _read(spark, sf_dir, "documents")
    found = mixing.mix(docs, MIX_LEVELS, share=0.5, weights=MIX_WEIGHTS, epochs=4, seed=17)
    epoch, tokens, leaf = mixing.added(docs)
    return found.select("doc_id", F.col(leaf).alias("leaf"), F.col(epoch).alias("epoch"), F.col(tokens).alias("n_tokens"))


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of each document under a context tree of the training documents, and under their word counts."""
    return ctw.score(_read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a benchmark window, and the items they come from."""
    items = suffix.read_items(_read(spark, sf_dir, "benchmark"))
    found = suffix.annotate(_read(spark, sf_dir, "documents"), items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (F.size("item_ids") >= 2).alias("contaminated"),
    )


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = "coalesce(regexp_extract_all(" + _LOWER_SQL.format("text") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+'), [])"
_WINDOWS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(8, len(w)) AS size, w[p:p + least(8, len(w)) - 1] AS words FROM i, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS u(p) WHERE len(w) > 0),
places AS (SELECT n, size, p, w[p:p + size - 1] AS words FROM d, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - size + 2)) AS u(p) WHERE len(w) >= size),
found AS (SELECT n, p, windows.size AS size, item_id FROM places JOIN windows USING (size, words)),
hits AS (SELECT n, count(DISTINCT h) AS hit FROM found, unnest(range(p, p + size)) AS u(h) GROUP BY n),
items AS (SELECT n, count(DISTINCT item_id) AS items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (n) LEFT JOIN items USING (n)"""


#: Rules of the url query; the longest that fits decides.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts that the url query lists besides, each for its subdomains too: some names, and as many numbered ones.
LISTED_NAMES, LISTED_TOPS, LISTED_NUMBERED = ("ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"), ("com", "net", "org"), 100_000


def listed_hosts(spark: SparkSession) -> DataFrame:
    """The list as a table of one column."""
    names = spark.createDataFrame([(f"{name}.example.{top}",) for name in LISTED_NAMES for top in LISTED_TOPS], "host string")
    return names.unionByName(spark.range(LISTED_NUMBERED).select(F.concat(F.lit("listed-"), F.col("id").cast("string"), F.lit(".example.net")).alias("host")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of each page: the longest fitting rule's, else that of the listed hosts."""
    pages = _read(spark, sf_dir, "pages")
    return url_cascade.judge(pages, url_cascade.build_filter(pages, [url_cascade.Rule(*r) for r in URL_RULES], listed_hosts(spark)))


_URL_SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(action, rule_host, rule_path) AS (VALUES {", ".join(map(str, URL_RULES))}),
listed AS (
  SELECT name || '.example.' || top AS listed_host FROM (VALUES {", ".join(f"('{n}')" for n in LISTED_NAMES)}) AS n(name), (VALUES {", ".join(f"('{t}')" for t in LISTED_TOPS)}) AS t(top)
  UNION ALL SELECT 'listed-' || i || '.example.net' FROM range({LISTED_NUMBERED}) AS r(i)),
numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
best AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM numbered JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n),
domains AS (SELECT n, array_to_string(string_split(host, '.')[i:], '.') AS domain FROM numbered, unnest(range(1, len(string_split(host, '.')) + 1)) AS u(i)),
bad AS (SELECT DISTINCT n FROM domains JOIN listed ON domain = listed_host)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.n = numbered.n) THEN 'block' ELSE 'allow' END) AS verdict
FROM numbered LEFT JOIN best USING (n)"""


def op2_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch of each document, of its edited text, and their likeness."""
    found = bottomk.compare_edited(_read(spark, sf_dir, "documents"))
    text = {"fingerprint": "sketch", "edited_fingerprint": "edited_sketch"}
    return found.select("doc_id", "n_chars", "edited_sha256", *(bottomk.as_text(F.col(c)).alias(n) for n, c in text.items()), "near_edited", "near_next")


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that each document shares with an earlier one."""
    return chaining.passages(_read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document, linked at a Jaccard similarity of 0.9 of its 3-word shingles."""
    return sigtree.join(_read(spark, sf_dir, "documents"), 3, 9, 10)


#: Links of documents by the shingles that they share, and the smallest id that links lead to.
_LINKS_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all({_LOWER_SQL.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT n, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [hash(w)] ELSE list_distinct([hash(w[i:i + 2]) FOR i IN range(1, len(w) - 1)]) END AS shingles FROM d),
x AS (SELECT n, len(shingles) AS size, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.n AS a, b.n AS b, count(*) AS common FROM x AS a JOIN x AS b USING (shingle) WHERE a.n < b.n AND 100 * a.size >= 90 * b.size AND 100 * b.size >= 90 * a.size GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN s AS sa ON sa.n = a JOIN s AS sb ON sb.n = b WHERE 100 * common >= 90 * (len(sa.shingles) + len(sb.shingles) - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, doc) AS (SELECT n, doc_id FROM s UNION SELECT b, doc FROM reach JOIN ways ON a = node)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least_doc AS component_id
FROM s JOIN (SELECT node, min(doc) AS least_doc FROM reach GROUP BY node) ON node = n"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities of good quality and of toxicity for each document, and whether it is accepted."""
    docs = _read(spark, sf_dir, "documents")
    found = cotrain.score(docs, cotrain.train(docs, _read(spark, sf_dir, "labels")))
    return found.withColumn("accepted", (F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record as read back from the written archives."""
    return warc.round_trip(_read(spark, sf_dir, "pages")).drop("segments")


#: Five hexadecimal digits are four digits of base 32.
_BASE32_SQL = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, {5 * i + 1}, 5))::INT >> {shift}) & 31 AS INT) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
_WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, {_BASE32_SQL} AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM g"""


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write token files of docs and read them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = fresh_path(spark, "tokens")
    tokenfile.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read(spark, path).drop("part", "file")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, as read back from the written files."""
    return token_files(spark, _read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_url_filter": op1_url_filter, "op2_bottomk": op2_bottomk, "op3_passages": op3_passages, "op4_ngram_join": op4_ngram_join, "op5_quality": op5_quality, "op6_warc_round_trip": op6_warc_round_trip, "op7_token_files": op7_token_files, "op8_mixture": op8_mixture, "op9_context_tree": op9_context_tree, "op10_decontaminate": op10_decontaminate}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _URL_SQL, "op4_ngram_join": _LINKS_SQL, "op6_warc_round_trip": _WARC_SQL, "op10_decontaminate": _WINDOWS_SQL}

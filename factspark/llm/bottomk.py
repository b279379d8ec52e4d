"""Bottom-k sketches of word shingles, with DataFrame functions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles (runs of five words; all
words where there are fewer; none without words). Sketches of parts merge to the sketch of the whole, and two sketches
give estimates of resemblance, containment and the number of distinct shingles; below k shingles all are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

SIZE, WIDTH = 128, 5
_LEAST = -(2**63)
#: Quantiles of ids that are looked up by comparisons; within two of them buckets have equal width.
CELLS = 128


def with_sketch(df: DataFrame, text: str, name: str, k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """df with the sketch of column `text` as column `name`; a null text has an empty sketch.

    The arrays between are columns of their own: a lambda that looked into an expression would compute it for each word.
    """
    words, last = f"{name}__h", F.size(f"{name}__h") - width + 1
    split = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \t-\r]+"), lambda w: w != "")
    df = df.withColumn(words, F.transform(split, lambda w: F.xxhash64(w)))
    h = F.col(words)
    run = F.transform(F.slice(h, 1, F.greatest(last, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, width))))
    few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    all_of = F.when(last > 0, run).otherwise(few)
    return df.withColumn(name, F.slice(F.array_distinct(F.sort_array(all_of)), 1, k)).drop(words)


def union(a: Column, b: Column, k: int = SIZE) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated Jaccard similarity; 1 for two empty sketches."""
    both = union(a, b, k)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def distinct_count(a: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles."""
    reach = (F.element_at(a, -1).cast("double") - F.lit(float(_LEAST))) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / reach)


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    part = resemblance(a, b, k) * distinct_count(union(a, b, k), k) / distinct_count(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), part))


def merge(df: DataFrame, keys: list[str], sketch: str, k: int = SIZE, salts: int = 64) -> DataFrame:
    """A sketch for each key, of all its rows; parts meet in two steps, so no task gathers all rows of a hot key."""
    whole = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, k).alias(sketch)
    part = df.select(*keys, sketch).distinct().groupBy(*keys, F.pmod(F.hash(sketch), F.lit(salts)).alias("__salt")).agg(whole)
    return part.groupBy(*keys).agg(whole)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _bucket(key: Column, bounds: list[int], parts: int) -> Column:
    """Ascending buckets of a key: a tree of comparisons finds its cell between bounds, and equal widths divide that."""

    def cell(low: int, high: int) -> Column:
        if high - low == 1:
            a, b = bounds[low], bounds[high]
            share = (key.cast("double") - F.lit(float(a))) / F.lit(float(max(b - a, 1)))
            return F.lit(low * parts) + F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts))).cast("int")
        middle = (low + high) // 2
        return F.when(key < F.lit(bounds[middle]), cell(low, middle)).otherwise(cell(middle, high))

    return cell(0, len(bounds) - 1)


def with_next(docs: DataFrame, order: str, tie: str, columns: list[str], more: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs with next_<c> for each of columns: its value in the next row by (order, tie), in the first row for the last.
    more: adds columns that are made of a row; it is applied to all rows once, and to the few that ranges begin with.

    Rows are dealt once, by ranges of `order`; where a range ends, the next one's first row is joined in. `order` is a
    long, its nulls come first.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(order), F.lit(_LEAST))
    wanted = 4 * partitions(spark)
    cells = min(CELLS, wanted)
    found = docs.agg(F.percentile_approx(order, [i / cells for i in range(cells + 1)], 10_000).alias("b")).first()["b"]
    bounds = sorted(set(found or [0, 1]))
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1]
    placed = docs.withColumn("__key", key).withColumn("__bucket", _bucket(key, bounds, -(-wanted // cells)))
    w = Window.partitionBy("__bucket").orderBy("__key", tie)
    whole = more(placed)
    rows = whole.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), F.lead(F.lit(True)).over(w).alias("__inside"))
    # a row for each bucket: as many as partitions, whatever the number of documents
    firsts = sorted((r[0], r[1]) for r in docs.select(_bucket(key, bounds, -(-wanted // cells)).alias("b"), key.alias("k")).groupBy("b").agg(F.min("k")).collect())
    follow = [(b, firsts[(n + 1) % len(firsts)][1]) for n, (b, _) in enumerate(firsts)]
    heads = spark.createDataFrame(follow, "__b int, __k long")
    least = more(placed.join(F.broadcast(heads), F.col("__key") == F.col("__k"))).groupBy("__b").agg(F.min(F.struct(F.col(tie).alias("__tie"), *columns)).alias("__head"))
    joined = rows.join(least, F.col("__bucket") == F.col("__b"), "left")
    out = [F.when(F.col("__inside"), F.col(f"next_{c}")).otherwise(F.col(f"__head.{c}")).alias(f"next_{c}") for c in columns]
    return joined.select(*(c for c in whole.columns if c not in ("__key", "__bucket")), *out)


def compare_edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = SIZE, width: int = WIDTH) -> DataFrame:
    """Sketches of each text, of the text with its last quarter replaced by the next document's beginning, and likeness.

    Returns id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next. The next document is the one with
    the next larger id (rows with one id: by text; nulls first), for the last the first. Null texts are empty.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    rows = with_next(rows, "id", "text", ["text", "sketch"], lambda df: with_sketch(df, "text", "sketch", k, width))
    size = F.char_length("text")
    tail = F.floor(size / 4).cast("int")
    rows = rows.withColumn("n_chars", size.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), size - tail), F.substring(F.col("next_text"), F.lit(1), tail)))
    rows = rows.select("id", "n_chars", "edited", "sketch", "next_sketch")
    rows = with_sketch(rows, "edited", "edited_sketch", k, width)
    return rows.select(
        F.col("id").alias(id_column),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )

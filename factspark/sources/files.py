"""Facts from JSON and CSV files, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import Bound, tagged
from .triples import TripleSource

def _typed(value, kind):
    """Text of a JSON value with its kind as a tagged value."""
    cells = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean", "reference": "string"}
    out = tagged(Bound(F.lit(None), "null"))
    for name, t in cells.items():
        out = F.when(kind == name, tagged(Bound(value.try_cast(t), name))).otherwise(out)
    return out


def read_json(spark: SparkSession, path: str) -> TripleSource:
    """A dump of one object a line, {id: {namespace: {name: value or list of values}}}; {"/": id} is a reference.

    Each line is parsed as maps, so attributes needn't be known; lists are attributes with several values.
    """
    entities = spark.read.text(path).select(F.explode(F.from_json("value", "map<string,map<string,map<string,string>>>")).alias("of", "spaces"))
    spaces = entities.select("of", F.explode("spaces").alias("space", "names"))
    cells = spaces.select("of", F.explode("names").alias("name", "json"), "space")
    the = F.concat("space", F.lit("/"), "name")
    # a string in the map is the value's text: lists and references are still JSON
    listed = F.col("json").startswith("[")
    many = cells.where(listed).select(the.alias("the"), "of", F.explode(F.from_json("json", "array<string>")).alias("v"))
    one = cells.where(~listed | F.col("json").isNull()).select(the.alias("the"), "of", F.col("json").alias("v"))
    rows = many.unionByName(one)
    link = F.get_json_object("v", "$./")
    kind = (
        F.when(F.col("v").isNull(), "null")
        .when(F.col("v").startswith('{"/"'), "reference")
        .when(F.col("v").rlike(r"^-?\d{1,18}$"), "integer")
        .when(F.col("v").rlike(r"^-?\d+\.?\d*([eE][-+]?\d+)?$"), "float")
        .when(F.col("v").isin("true", "false"), "boolean")
        .otherwise("string")
    )
    key = F.regexp_extract("v", r'^\{"/":\s*"(.*)"\}$', 1)
    value = F.when(kind == "reference", F.coalesce(F.nullif(key, F.lit("")), link)).otherwise(F.col("v"))
    return TripleSource(rows.select("the", "of", _typed(value, kind).alias("is"), F.lit("0").alias("cause")).dropDuplicates(["the", "of", "is"]))


def read_csv(spark: SparkSession, path: str, namespace: str, key: list[str], lists: dict[str, str] | None = None, schema: str | None = None) -> TripleSource:
    """Rows of a CSV file with a header as entities, named by the hash of their key columns; lists: separators of columns
    that hold several values. Empty cells are absent. Without a schema all values are strings."""
    from ..values import entity_hash, spark_type

    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    of = entity_hash({k: Bound(F.col(k).cast("string"), "string") for k in key})
    parts = None
    for name, data in df.dtypes:
        the = F.lit(f"{namespace}/{name}").alias("the")
        if name in (lists or {}):
            rows = df.select(the, of.alias("of"), F.explode(F.split(name, f"\\s*[{lists[name]}]\\s*")).alias("v")).select("the", "of", tagged(Bound(F.col("v"), "string")).alias("is"))
        else:
            kind = spark_type(data)
            wide = {"integer": "bigint", "float": "double"}.get(kind, data)
            rows = df.where(F.col(name).isNotNull()).select(the, of.alias("of"), tagged(Bound(F.col(name).cast(wide), kind)).alias("is"))
        parts = rows if parts is None else parts.unionByName(rows)
    return TripleSource(parts.withColumn("cause", F.lit("0")).dropDuplicates(["the", "of", "is"]))


def as_json(source: TripleSource) -> DataFrame:
    """A line {id: {namespace: {name: [values]}}} for each entity, as read_json reads it; write it with .write.text()."""
    c = F.col("is")
    text = lambda x: F.to_json(F.array(x))
    inner = F.when(c["t"] == "string", text(c["s"])).when(c["t"] == "reference", text(F.struct(c["s"].alias("/")))).when(c["t"] == "integer", text(c["l"])).when(c["t"] == "float", text(c["d"])).when(c["t"] == "boolean", text(c["b"])).otherwise(F.lit("[null]"))
    rows = source.df.select("of", F.substring_index("the", "/", 1).alias("space"), F.regexp_replace("the", "^[^/]*/", "").alias("name"), inner.alias("j"))
    rows = rows.select("of", "space", "name", F.substring(F.col("j"), F.lit(2), F.char_length("j") - 2).alias("v"))
    quote = lambda n: F.to_json(F.array(F.col(n)))
    bare = lambda n: F.substring(quote(n), F.lit(2), F.char_length(quote(n)) - 2)
    names = rows.groupBy("of", "space", "name").agg(F.concat(bare("name"), F.lit(":["), F.array_join(F.sort_array(F.collect_list("v")), ","), F.lit("]")).alias("n"))
    spaces = names.groupBy("of", "space").agg(F.concat(bare("space"), F.lit(":{"), F.array_join(F.sort_array(F.collect_list("n")), ","), F.lit("}")).alias("s"))
    return spaces.groupBy("of").agg(F.concat(F.lit("{"), bare("of"), F.lit(":{"), F.array_join(F.sort_array(F.collect_list("s")), ","), F.lit("}}")).alias("value")).select("value")

"""Streams of transactions and the answers of rules after each.

Rules with negation, recursion or distinct answers aren't incremental in Structured Streaming, so each micro-batch of
assertions and retractions is added to a log, and the rules are evaluated on the facts that the log leaves. The log has a
table for each batch number, so a batch that runs again writes the same table; after each SNAPSHOT batches all facts are
written as one, and later batches read that and the log since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..builder import Match
from ..sources.triples import SCHEMA, TripleSource
from ..values import Bound, spark_type, tagged

#: An instruction: op is assert or retract.
INSTRUCTION = f"op string, {SCHEMA}"


def facts_of(stream: DataFrame, namespace: str, key: str, op: str = "assert") -> DataFrame:
    """A stream of rows as a stream of instructions, one for each column but the key; nulls are absent."""
    entity = F.concat(F.lit(f"{namespace}:"), F.col(key).cast("string"))
    cells = []
    for name, data in stream.dtypes:
        if name != key:
            kind = spark_type(data)
            wide = {"integer": "bigint", "float": "double", "string": "string"}.get(kind, data)
            cells.append(F.struct(F.lit(f"{namespace}/{name}").alias("the"), F.when(F.col(name).isNotNull(), tagged(Bound(F.col(name).cast(wide), kind))).alias("is")))
    rows = stream.select(entity.alias("of"), F.explode(F.array(*cells)).alias("c")).where("c.is is not null")
    return rows.select(F.lit(op).alias("op"), F.col("c.the").alias("the"), "of", F.col("c.is").alias("is"), F.lit(None).cast("string").alias("cause"))


#: Batches after which all facts are written as one table.
SNAPSHOT = 16


def _stored(spark: SparkSession, path: str, upto: int) -> tuple[int, list[int]]:
    """The last whole snapshot of a batch up to this one (-1: none), and the log's batches after it, up to this one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    done = [n.split("-") for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    numbers = {kind: sorted(int(n) for k, n in done if k == kind and int(n) <= upto) for kind in ("snapshot", "batch")}
    last = max(numbers["snapshot"], default=-1)
    return last, [n for n in numbers["batch"] if n > last]


def facts_upto(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The facts after a batch. A fact keeps the cause of its first assertion since it was last retracted; within a batch
    a retraction wins. For each fact the snapshot and the few batches since have an event each at most."""
    last, batches = _stored(spark, path, number)
    log = spark.createDataFrame([], f"op string, {SCHEMA}, b int")
    for n in batches:
        log = log.unionByName(spark.read.schema(f"op string, {SCHEMA}").parquet(f"{path}/batch-{n}").withColumn("b", F.lit(n)))
    if last >= 0:
        held = spark.read.schema(SCHEMA).parquet(f"{path}/snapshot-{last}")
        log = log.unionByName(held.withColumn("op", F.lit("assert")).withColumn("b", F.lit(last)))
    events = log.groupBy("the", "of", "is").agg(F.collect_set(F.struct("b", "op", "cause")).alias("e"))
    gone = F.coalesce(F.array_max(F.transform(F.filter("e", lambda x: x["op"] == "retract"), lambda x: x["b"])), F.lit(-1))
    since = F.array_min(F.filter("e", lambda x: (x["op"] == "assert") & (x["b"] > F.col("gone"))))
    left = events.withColumn("gone", gone).withColumn("first", since).where("first is not null")
    return left.select("the", "of", "is", F.col("first.cause").alias("cause"))


def run_rules(instructions: DataFrame, path: str, queries: dict[str, Match], sink: Callable[[str, DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start a stream: store its instructions under path, and give sink each query's name and answers after every batch.

    Within a batch a retraction wins over an assertion of the same fact. trigger: as for writeStream.trigger().
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        made = batch.select("op", "the", "of", "is", F.lit(str(number)).alias("cause")).distinct()
        made.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        facts = facts_upto(spark, path, number)
        if number % SNAPSHOT == SNAPSHOT - 1:
            facts.write.mode("overwrite").parquet(f"{path}/snapshot-{number}")
            facts = spark.read.schema(SCHEMA).parquet(f"{path}/snapshot-{number}")
        source = TripleSource(facts, version=number)
        for name, match in queries.items():
            sink(name, match.query(source), number)

    writer = instructions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

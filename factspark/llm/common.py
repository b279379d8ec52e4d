"""Session helpers shared by the operators: a shared folder, lineage cuts and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit

MAX_BITS = 1 << 28
_LIBC = ctypes.CDLL(None)
#: Rows of an Arrow batch; texts may be long, so far fewer than Spark's own default.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: spark.checkpoint.dir, else one under the warehouse (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends here and lost executors cost no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once what was made of them is itself written."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows, as whole texts travel in them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give free memory back to the system: a worker that waits for its next task holds little then."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def pieces(batch: pa.RecordBatch | pa.Table, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of a batch whose texts in `column` have about max_bytes together; one row at least. After the last one free
    memory is released."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


def only_ids(rows: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """rows without most of those whose id is not in ids (one long column): what a bitmap of hashed ids lets through.

    It comes before a join on the id, so that few texts are shuffled that the join would drop.
    """
    known = bitmap(ids)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known(batch.column(id_column))))

    return rows.mapInArrow(keep, rows.schema)


def bitmap(ids: DataFrame) -> Callable[[pa.Array], np.ndarray]:
    """For tasks, whether values are in ids (one long column), which lets some others through. It has 16 bits for each id,
    MAX_BITS at most, whatever the input."""
    count = max(1, ids.count())
    words = min(MAX_BITS, 1 << (16 * count - 1).bit_length()) >> 6
    words = max(1, words)

    def place(values: pa.Array) -> np.ndarray:
        return textkit.mix(pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % np.uint64(64 * words)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(words, np.uint64)
        for batch in batches:
            p = place(batch.column(0))
            np.bitwise_or.at(bits, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["word", "bits"])

    found = ids.mapInArrow(gather, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def known(values: pa.Array) -> np.ndarray:
        p = place(values)
        return (shared.value[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)

    return known

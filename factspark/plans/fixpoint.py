"""Recursion: semi-naive iteration with cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows that are held by the driver between steps; larger sets are written to tables.
SMALL_ROWS, SMALL_BYTES = 50_000, 8 << 20
#: Tables of new rows after which all known rows are written as one.
MERGE = 16


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach: spark.checkpoint.dir, else one under the warehouse (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def cut(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows from a table in the cluster's shared folder, so lineage ends and lost executors cost no recomputation;
    and how many there are, counted as they are written."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def _nullable(schema: pa.Schema) -> pa.Schema:
    def loose(f: pa.Field) -> pa.Field:
        kind = pa.struct([loose(f.type.field(i)) for i in range(f.type.num_fields)]) if pa.types.is_struct(f.type) else f.type
        return pa.field(f.name, kind, True)

    return pa.schema([loose(f) for f in schema])


def _key(value: object) -> object:
    """A cell to be compared with others of its column: structs as tuples, NaN equal to itself."""
    if isinstance(value, dict):
        return tuple(_key(v) for v in value.values())
    return "NaN" if value != value else value


class Rows:
    """A growing set of rows: in the driver while it is small, then in tables of the shared folder."""

    def __init__(self, spark: SparkSession, schema: StructType):
        # a later step's columns may be nullable where the first's weren't
        self.spark, self.schema = spark, StructType([StructField(f.name, f.dataType) for f in schema.fields])
        self.arrow: pa.Schema | None = None
        self.local: pa.Table | None = None
        self.seen: set = set()
        self.table: DataFrame | None = None
        self.parts = 0

    def _frame(self, rows: pa.Table) -> DataFrame:
        return self.spark.createDataFrame(rows, self.schema)

    def add(self, df: DataFrame, likely: int) -> tuple[DataFrame, int]:
        """Takes the rows of df that it hasn't; gives them, each once, with their number. likely: how many there may be."""
        if self.table is None and likely <= SMALL_ROWS:
            rows = df.limit(SMALL_ROWS + 1).toArrow()
            self.arrow = self.arrow or _nullable(rows.schema)
            rows = rows.cast(self.arrow)
            if rows.num_rows + len(self.seen) <= SMALL_ROWS and rows.nbytes + (self.local.nbytes if self.local else 0) <= SMALL_BYTES:
                new = []
                for i, row in enumerate(rows.to_pylist()):
                    key = _key(row)
                    if key not in self.seen:
                        self.seen.add(key)
                        new.append(i)
                rows = rows.take(pa.array(new, pa.int64()))
                self.local = rows if self.local is None else pa.concat_tables([self.local, rows])
                return self._frame(rows), len(new)
        if self.table is None and self.local is not None:
            self._store(cut(self._frame(self.local))[0])
        self.local, self.seen = None, set()
        df = df.distinct().alias("n")
        if self.table is not None:
            df = df.join(self.table.alias("k"), [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in self.schema.names], "left_anti")
        new, count = cut(df)
        self._store(new)
        return new, count

    def _store(self, table: DataFrame) -> None:
        self.table = table if self.table is None else self.table.unionByName(table)
        self.parts += 1
        if self.parts >= MERGE:
            self.table, self.parts = cut(self.table)[0], 1

    def frame(self) -> DataFrame:
        return self._frame(self.local) if self.table is None else self.table


def fixpoint(base: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame | None], limit: int | None = None) -> DataFrame:
    """The smallest set of rows with base and step(new rows, all rows) of it. step gets only the rows found last.

    Ends when a step finds nothing new; with a limit it raises RuntimeError after so many steps, as arithmetic may never
    end. Few rows stay in the driver between steps, so that a step costs no table and no shuffle of its own.
    """
    known = Rows(base.sparkSession, base.schema)
    new, count = known.add(base, 0)
    steps = 0
    while count:
        if limit is not None and steps >= limit:
            raise RuntimeError(f"recursion found new rows in each of {limit} steps")
        steps += 1
        found = step(new, known.frame())
        if found is None:
            break
        new, count = known.add(found.select(*base.columns), count)
    return known.frame()

"""Helpers shared by operators: table access, Arrow row mapping, joins that stand hot keys, shared checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a right side may have at most to be broadcast by hot_join.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, times: int = 1) -> DataFrame:
    """More partitions where a scan gives fewer than `times` the cluster's cores (a row group isn't split).

    Only the scan's own number of partitions is looked at; no job runs.
    """
    cores = times * df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:
        return df
    parts = df.rdd.getNumPartitions()
    return df.repartition(cores) if parts < cores else df


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list[tuple]]], schema: str | T.StructType) -> DataFrame:
    """Applies a Python function to the columns of every row, by Arrow batches.

    make() runs once in each Python worker and gives a function of one row's values (in the order of df's columns)
    that returns the output rows as tuples in the order of schema.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                rows.extend(f(*values))
                if len(rows) > 50_000:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)

    return df.mapInArrow(run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[..., list[list]]], schema: str | T.StructType) -> DataFrame:
    """Like map_rows, for functions of whole batches: columns as lists in, output columns as lists (or arrays) out."""
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            cols = f(*(c.to_pylist() for c in b.columns))
            if len(cols[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", salt: str | None = None, salts: int = 32) -> DataFrame:
    """Joins a table whose keys may be hot with one that has one row per key.

    right is counted first: up to BROADCAST_ROWS rows it is broadcast. Beyond that, left's rows of a key are spread
    over `salts` partitions by a hash of column `salt` and right is repeated once for each of these.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, how)
    by = F.xxhash64(salt) if salt else F.xxhash64(*left.columns)
    spreaded = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(by, F.lit(salts)).cast("int")).join(spreaded, [on, "_salt"], how).drop("_salt")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder of spark.checkpoint.dir; a local folder is set only on a single machine without one."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: below spark.checkpoint.dir, or a local one where the only machine is this one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "siftwork")
    return f"{base.rstrip('/')}/{name}"


def digits(c: Column) -> Column:
    """Only the ASCII digits."""
    return F.regexp_replace(c, "[^0-9]", "")

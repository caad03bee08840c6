"""Helpers shared by the operators: reading a table, tables written once to the shared folder, sizing."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.session import ensure_checkpoint_dir

#: A word is a run of characters other than blank and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch on its way to a Python worker (a longer row is a batch of its own); Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet under the shared checkpoint folder and continue from the written copy.

    The copy survives lost executors, is read back with column pruning and statistics, and keeps a costly plan from running twice.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator, deleted together once its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def clear(self) -> None:
        for path in self.paths:
            discard(self.spark, path)
        self.paths = []


def with_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """Left join of ``facts`` (one row per key, with the number of ``rows`` that bear it in ``count``) that no hot key can stall.

    Keys of at least one row in ``share`` are at most ``share`` many and are broadcast; their rows get a key of their own in the shuffle for all others.
    ``facts`` should be a written table; ``count`` is not handed on.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    values = [c for c in facts.columns if c not in (key, count)]
    flag, at, own = (fresh(rows, stem) for stem in ("_hot", "_at", "_own"))
    is_hot = F.col(count) * share >= total
    hot = F.broadcast(facts.filter(is_hot).select(key, F.struct(*values).alias(flag)))
    cold = facts.filter(~is_hot).select(F.struct(F.col(key).cast("string").alias("k"), F.lit(0).alias("spread")).alias(at), F.struct(*values).alias(own))
    spread = F.when(F.col(flag).isNotNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).cast("int") + 1).otherwise(0)
    met = rows.join(hot, key, "left").withColumn(at, F.struct(F.col(key).cast("string").alias("k"), spread.alias("spread"))).join(cold, at, "left")
    found = F.coalesce(flag, own)
    return met.select(*rows.columns, *[found[c].alias(c) for c in values])


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that no later step reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, so that callers' extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unit(hashed: Column) -> Column:
    """Uniform double in [0, 1) from a 64-bit hash: its upper 53 bits."""
    return F.shiftrightunsigned(hashed, 11).cast("double") * F.lit(2.0**-53)


def count_words(text: Column) -> Column:
    """Words of a text as BIGINT; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def give_back() -> None:
    """Hand what a Python worker has freed back to the system: a worker outlives its task, and its idle memory counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches, column: str, limit: int = 8 << 20):
    """Cut Arrow batches into slices whose ``column`` holds about ``limit`` bytes at most; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop

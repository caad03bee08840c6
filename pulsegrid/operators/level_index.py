"""Positions by Level: inverted lists from Level to onsets, cut into blocks of ticks and delta-coded.

A block spans ``BLOCK`` ticks, and hits are unique per tick, so a row never holds more positions than that however many attacks a Level has; the blocks of a hot score
are rows like any others, grouped in one shuffle without ordering the score.  The first delta counts from the start of the block, the others from the position before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.rational import int_div

BLOCK = 1024
KEYS = ("score_id", "segment_index")


def block_of(at: Column) -> Column:
    return int_div(at - F.pmod(at, F.lit(BLOCK)), BLOCK)


def build(events: DataFrame) -> DataFrame:
    """score_id, segment_index, level, block, positions, deltas of all events that reached a Level."""
    reached = events.select(*KEYS, F.col("onset").cast("bigint").alias("onset"), F.explode("levels").alias("level"))
    lists = reached.groupBy(*KEYS, "level", block_of(F.col("onset")).alias("block")).agg(F.array_sort(F.collect_set("onset")).alias("_at"))  # at most BLOCK
    before = F.concat(F.array(F.col("block") * BLOCK), F.slice("_at", F.lit(1), F.size("_at") - 1))
    return lists.select(*KEYS, "level", "block", F.size("_at").cast("bigint").alias("positions"), F.zip_with("_at", before, lambda a, b: a - b).alias("deltas"))


def positions(index: DataFrame) -> DataFrame:
    """score_id, segment_index, level, onset: the lists read back."""
    start = F.struct((F.col("block") * BLOCK).alias("at"), F.array().cast("array<bigint>").alias("out"))
    sums = F.aggregate("deltas", start, lambda s, d: F.struct((s["at"] + d).alias("at"), F.array_append(s["out"], s["at"] + d).alias("out")), lambda s: s["out"])
    return index.select(*KEYS, "level", F.explode(sums).alias("onset"))


def between(index: DataFrame, start: int, end: int, highest: int | None = None) -> DataFrame:
    """Positions with ``start <= onset < end`` of the Levels up to ``highest``; only the blocks that overlap are read."""
    blocks = index.filter((F.col("block") >= start // BLOCK) & (F.col("block") <= (end - 1) // BLOCK))
    kept = blocks if highest is None else blocks.filter(F.col("level") <= highest)
    return positions(kept).filter((F.col("onset") >= start) & (F.col("onset") < end))


def marks(events: DataFrame, index: DataFrame, labels: DataFrame) -> DataFrame:
    """Result rows of the Levels: per segment and Level the number of positions, blocks, first and last onset, and the label of the first Level-1 position."""
    spans = positions(index).groupBy(*KEYS, "level").agg(F.count(F.lit(1)).alias("positions"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset"))
    blocks = index.groupBy(*KEYS, "level").agg(F.count(F.lit(1)).alias("blocks"))
    first = labels.groupBy(*KEYS).agg(F.min_by("label", "onset").alias("first_label"))
    held = events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"))
    return spans.join(blocks, [*KEYS, "level"]).join(held, list(KEYS)).join(first, list(KEYS), "left").withColumn("first_label", F.when(F.col("level") == 1, F.col("first_label")))

"""Adapter: any keyed, timestamped event table as a corpus of timelines.

A user is a score, a day is a measure, the event type is the part and pitch.  The meter of a day follows from its week
(4/4, 3/4, 6/8 in turn); a quarter is 64 ticks and the day is stretched over its measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.operators.hits import merge_hits
from pulsegrid.operators.segments import measure_starts, meter_segments, segment_hits
from pulsegrid.operators.levels import refine

TPQ = 64
EPOCH = "2024-01-01 00:00:00"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def seconds_since_epoch(ts: str = "ts") -> Column:
    """Whole seconds, rounded down, so that days before the epoch count -1, -2 and so on."""
    return F.expr(f"CAST(floor(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', {ts}) / 1000000D) AS BIGINT)")


def day_of(sec: Column) -> Column:
    return F.call_function("div", sec - F.pmod(sec, F.lit(86400)), F.lit(86400)).cast("int")


def week_of(day: Column) -> Column:
    return F.call_function("div", day - F.pmod(day, F.lit(7)), F.lit(7)).cast("int")


def calendar(events: DataFrame) -> DataFrame:
    """score_id, measure_index of every day of a user: from the epoch, or the first event if that is earlier, to the last event."""
    day = day_of(seconds_since_epoch())
    days = events.groupBy(F.col("user_id").alias("score_id")).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    return days.select("score_id", F.explode(F.sequence(F.least(F.lit(0), F.col("_first")), F.col("_last"))).alias("measure_index"))


def week_meter(day: Column) -> tuple[Column, Column]:
    turn = F.pmod(week_of(day), F.lit(3))
    num = F.when(turn == 0, 4).when(turn == 1, 3).otherwise(6)
    den = F.when(turn == 2, 8).otherwise(4)
    return num, den


def calendar_columns(sec: Column) -> list[Column]:
    """Day and lattice position of a second since the epoch."""
    day = day_of(sec)
    num, den = week_meter(day)
    full = F.call_function("div", num * 4 * TPQ, den)
    return [day.alias("measure_index"), F.call_function("div", F.pmod(sec, F.lit(86400)) * full, F.lit(86400)).cast("bigint").alias("offset")]


def event_attacks(events: DataFrame) -> DataFrame:
    """Events as attacks inside their day; onsets come from the measure table."""
    sec = seconds_since_epoch()
    day = day_of(sec)
    num, den = week_meter(F.col("measure_index"))
    return (
        events.select(
            F.col("user_id").alias("score_id"), day.alias("measure_index"), F.pmod(sec, F.lit(86400)).alias("_sec"),
            F.ceil("value").cast("bigint").alias("duration"), F.col("event_type").alias("pitch"), F.col("event_id").alias("doc_rank"),
        )
        .withColumn("full", F.call_function("div", num * 4 * TPQ, den).cast("bigint"))
        .withColumn("offset", F.call_function("div", F.col("_sec") * F.col("full"), F.lit(86400)).cast("bigint"))
        .drop("_sec")
    )


def event_measures(events: DataFrame) -> DataFrame:
    """Calendar of every user: one measure per day."""
    num, den = week_meter(F.col("measure_index"))
    measures = calendar(events).select(
        "score_id", "measure_index", num.cast("int").alias("num"), den.cast("int").alias("den"),
        F.call_function("div", num * 4 * TPQ, den).cast("bigint").alias("full"), F.lit(TPQ).alias("tpq"),
    )
    return measure_starts(measures)


def event_hits(events: DataFrame) -> DataFrame:
    """Attacks merged per (user, day, offset), then moved onto the user's timeline.

    The merge comes first: it shrinks the data to at most one row per tick before the measure starts are joined in.
    """
    attacks = event_attacks(events).withColumn("onset", F.col("offset"))
    keyed = attacks.withColumn("score_id", F.struct("score_id", "measure_index"))
    merged = merge_hits(keyed.select("score_id", "onset", "duration", "pitch", "doc_rank"))
    local = merged.select(
        F.col("score_id.score_id").alias("score_id"), F.col("score_id.measure_index").alias("measure_index"),
        F.col("onset").alias("offset"), "duration", "source_count", "pitches",
    )
    starts = event_measures(events).select("score_id", "measure_index", "start")
    return local.join(starts, ["score_id", "measure_index"]).withColumn("onset", F.col("start") + F.col("offset")).drop("start")


def event_segments(events: DataFrame) -> DataFrame:
    return meter_segments(event_measures(events))


def event_levels(events: DataFrame) -> DataFrame:
    return refine(segment_hits(event_hits(events), event_segments(events)))

"""Measure timeline and meter segments (running starts, gaps and islands, range membership)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.meter import meter_columns
from pulsegrid.operators.ranges import range_lookup
from pulsegrid.operators.scan import Scan, carried_scan


def measure_scan(measures: DataFrame) -> Scan:
    """Measures of one score in order, chunked if the frame carries chunks."""
    return carried_scan(measures, ["score_id"], ["measure_index"])


def measure_starts(measures: DataFrame) -> DataFrame:
    """Start of each measure = sum of the full durations before it."""
    return measure_scan(measures).running(measures, exclusive=True, start=("sum", F.col("full")))


def meter_segments(measures: DataFrame) -> DataFrame:
    """Maximal runs of measures with equal meter.

    Needs score_id, measure_index, num, den, start, full, tpq (and opening_anacrusis if there is one).
    """
    scan = measure_scan(measures)
    has_opening = "opening_anacrusis" in measures.columns
    marked = scan.neighbour(measures, -1, _num=F.col("num"), _den=F.col("den"))
    marked = marked.withColumn("_new", (F.col("_num").isNotNull() & ((F.col("_num") != F.col("num")) | (F.col("_den") != F.col("den")))).cast("int"))
    runs = scan.running(marked, segment_index=("sum", F.col("_new")))
    at_start = F.struct("measure_index", F.col("opening_anacrusis") if has_opening else F.lit(False).alias("opening_anacrusis"))
    return (
        runs.groupBy("score_id", "segment_index")
        .agg(
            F.min("start").alias("start"),
            F.max(F.col("start") + F.col("full")).alias("end"),
            F.min("measure_index").alias("start_measure_index"),
            F.max("measure_index").alias("end_measure_index"),
            F.first("num").alias("num"),
            F.first("den").alias("den"),
            F.max("tpq").alias("tpq"),
            F.min(at_start)["opening_anacrusis"].alias("_opening"),
        )
        .withColumn("segment_index", F.col("segment_index").cast("int"))
        .withColumns(meter_columns(F.col("num"), F.col("den"), F.col("tpq")))
        .withColumn("opening_anacrusis", F.col("_opening") & (F.col("segment_index") == 0))
        .drop("_opening")
    )


def segment_hits(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Attach each hit to the segment whose [start, end) holds its onset."""
    ranges = segments.select(
        "score_id", "segment_index", F.col("start").alias("segment_start"), F.col("end").alias("segment_end"), "num", "den",
        "beat_ticks", "beat_count", "top_base", "compound",
    )
    return range_lookup(hits, ranges, ["score_id"], "onset", "segment_start", "segment_end")

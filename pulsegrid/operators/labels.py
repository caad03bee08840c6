"""Readable labels of Level-1 positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.rational import int_div, rational_text
from pulsegrid.operators.ranges import range_lookup


def level1_labels(events: DataFrame, measures: DataFrame, tpq: Column) -> DataFrame:
    """``m.N bK`` where the position is a whole number of beats into its measure, else ``m.N +offset`` (in quarters)."""
    firsts = events.filter(F.array_contains("levels", 1)).select("score_id", "segment_index", "onset", "beat_ticks")
    spans = measures.select("score_id", F.col("measure_number").alias("_number"), F.col("start").alias("_start"), (F.col("start") + F.col("full")).alias("_end"))
    inside = range_lookup(firsts, spans, ["score_id"], "onset", "_start", "_end")
    since = F.col("onset") - F.col("_start")
    whole = F.concat(F.lit("m."), F.col("_number"), F.lit(" b"), (int_div(since, F.col("beat_ticks")) + 1).cast("string"))
    part = F.concat(F.lit("m."), F.col("_number"), F.lit(" +"), rational_text(since, tpq))
    return inside.withColumn("label", F.when(since % F.col("beat_ticks") == 0, whole).otherwise(part)).drop("_number", "_start", "_end")

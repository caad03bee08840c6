"""One report for the warnings of all stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.functions.rational import int_div

_BLOCK_TICKS = 1 << 16

SCHEMA = "score_id string, stage string, code string, measure_index int, detail map<string,string>"


def note_rows(stage: str, code: str, rows: DataFrame, measure: str | None = None, **detail: str) -> DataFrame:
    """Turn rows into report rows of one code; ``detail`` maps report keys to columns."""
    pairs = [x for key, column in detail.items() for x in (F.lit(key), F.col(column).cast("string"))]
    return rows.select(
        F.col("score_id"), F.lit(stage).alias("stage"), F.lit(code).alias("code"),
        (F.col(measure) if measure else F.lit(None)).cast("int").alias("measure_index"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("detail"))


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def part_length_mismatches(part_measures: DataFrame) -> DataFrame:
    """Parts whose number of measures differs from the first part's."""
    counts = part_measures.groupBy("score_id", "part_ord").agg(F.count(F.lit(1)).alias("n"), F.first("part_id").alias("part_id"))
    first = counts.filter("part_ord = 0").select("score_id", F.col("n").alias("first_n"))
    return note_rows("timeline", "part-length-differs", counts.join(first, "score_id").filter("n <> first_n"), None, part="part_id", measures="n", canonical="first_n")


def unmatched_ties(unmatched: DataFrame) -> DataFrame:
    return note_rows("timeline", "unmatched-tie-stop", unmatched, "measure_index", pitch="pitch", number="measure_number")


def fallback_meters(segments: DataFrame) -> DataFrame:
    return note_rows("segments", "meter-base-fallback", segments.filter("base_is_fallback"), "start_measure_index", num="num", den="den")


def refinement_notes(events: DataFrame) -> DataFrame:
    """Depth, conflict, ternary and composite notes, each once per segment."""
    notes = events.select("score_id", "segment_index", F.explode("notes").alias("note")).distinct()
    return note_rows("levels", "refinement", notes, None, segment="segment_index", note="note")


def unreachable_attacks(events: DataFrame, shown: int = 8) -> DataFrame:
    """Per segment the number of attacks without Levels and the first few onsets."""
    lost = events.filter(F.size("levels") == 0).select("score_id", "segment_index", "onset")
    segment = ["score_id", "segment_index"]
    # Ranked inside fixed stretches of time first, so that no task ranks all lost attacks of a long segment.
    near = F.row_number().over(Window.partitionBy(*segment, int_div(F.col("onset"), _BLOCK_TICKS)).orderBy("onset"))
    nth = F.row_number().over(Window.partitionBy(*segment).orderBy("onset"))
    lost_first = lost.withColumn("_near", near).filter(F.col("_near") <= shown)
    counts = lost.groupBy("score_id", "segment_index").agg(F.count(F.lit(1)).alias("n"))
    first = lost_first.withColumn("_nth", nth).filter(F.col("_nth") <= shown).groupBy("score_id", "segment_index").agg(
        F.array_join(F.array_sort(F.collect_list("onset")).cast("array<string>"), ", ").alias("first"))
    return note_rows("levels", "unreachable-attacks", counts.join(first, ["score_id", "segment_index"]), None, segment="segment_index", attacks="n", first="first")

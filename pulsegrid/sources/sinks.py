"""Result tables and nested documents, written per score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.meter import beat_unit_name
from pulsegrid.functions.rational import int_div, parse_rational, rational_text
from pulsegrid.operators.columns import stack_measures
from pulsegrid.operators.scan import sized_scan

BUCKET = "score_bucket"


def write_by_score(df: DataFrame, path: str, buckets: int = 256, mode: str = "overwrite", form: str = "parquet") -> None:
    """Write under a fixed number of hash folders of the score, so that one score is found without listing the corpus."""
    df.withColumn(BUCKET, F.pmod(F.hash("score_id"), F.lit(buckets))).write.mode(mode).partitionBy(BUCKET).format(form).save(path)


def slot_rows(stacks: DataFrame, slots: DataFrame) -> DataFrame:
    """Timed positions of every measure stack: absolute x, quarter time, counters through the score."""
    place = ["score_id", "page_index", "system_index", "stack_ord"]
    numbered = stacks.join(stack_measures(stacks).withColumnRenamed("measure_index", "global_measure_index"), place)
    joined = numbered.filter("left IS NOT NULL AND right IS NOT NULL").join(slots, place)
    t = joined.withColumn("_t", parse_rational(F.col("time_offset"))).filter("_t IS NOT NULL AND x_offset IS NOT NULL")
    return t.select(
        "score_id", "global_measure_index", (F.col("global_measure_index") + 1).alias("measure_ordinal"), "page_index", "system_index",
        F.col("stack_ord").alias("stack_index_in_system"), F.coalesce("stack_id", (F.col("global_measure_index") + 1).cast("string")).alias("stack_id"),
        F.col("slot_id").try_cast("int").alias("slot_id"), "slot_ord", rational_text(F.col("_t.num"), F.col("_t.den")).alias("time_offset_whole"),
        rational_text(F.col("_t.num") * 4, F.col("_t.den")).alias("time_offset_quarter"), "left", "right", "x_offset", (F.col("left") + F.col("x_offset")).alias("x_abs"), "suspicious",
    )


def segment_rows(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Segments as they are reported: text times, beat name, deepest Level, arity policy, tuplet ratios."""
    quarter = lambda c: rational_text(F.col(c), F.col("tpq"))
    deepest = events.groupBy("score_id", "segment_index").agg(F.max("height").alias("max_level"), F.count(F.lit(1)).alias("event_count"))
    ratios = _tuplet_ratios(events)
    joined = segments.join(deepest, ["score_id", "segment_index"], "left").join(ratios, ["score_id", "segment_index"], "left")
    top = F.coalesce("max_level", F.lit(0))
    return joined.select(
        "score_id", "segment_index", F.concat_ws("/", "num", "den").alias("meter"), quarter("start").alias("segment_start_quarter"), quarter("end").alias("segment_end_quarter"),
        quarter("beat_ticks").alias("beat_unit_quarter"), beat_unit_name(F.col("beat_ticks"), F.col("tpq")).alias("beat_unit_name"), "beat_count", F.col("top_base").alias("top_sequence_base"), "compound",
        "opening_anacrusis", top.alias("max_level"), F.when(top > 0, F.sequence(F.lit(1), F.greatest(top, F.lit(1)))).otherwise(F.array().cast("array<int>")).alias("levels_enabled"),
        F.when(F.col("compound"), 3).otherwise(2).alias("within_tactus_initial_arity"), F.lit(2).alias("finer_continuation_arity"),
        F.coalesce("explicit_tuplet_ratios", F.array().cast("array<string>")).alias("explicit_tuplet_ratios"),
        "start_measure_index", "end_measure_index", F.coalesce("event_count", F.lit(0)).alias("event_count"),
    )


def _tuplet_ratios(events: DataFrame) -> DataFrame:
    keys = ["score_id", "segment_index"]
    if "tuplets" not in events.columns:
        return events.groupBy(*keys).agg(F.array().cast("array<string>").alias("explicit_tuplet_ratios"))
    marks = events.select(*keys, F.explode("tuplets").alias("t")).select(*keys, F.concat_ws(":", F.col("t.actual"), F.col("t.normal")).alias("r")).distinct()
    return marks.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("explicit_tuplet_ratios"))


def event_rows(events: DataFrame) -> DataFrame:
    """Events with their times as text; one row per event, so that no score has to fit into one document."""
    quarter = lambda c: rational_text(F.col(c), F.col("tpq"))
    return events.select(
        "score_id", "segment_index", "measure_index", "measure_number", quarter("onset").alias("onset_quarter"), quarter("duration").alias("duration_quarter"),
        quarter("offset").alias("offset_in_measure_quarter"), F.concat_ws(":", F.col("measure_index").cast("string"), quarter("offset")).alias("attack_key"),
        "source_count", "pitches", "levels", "height", "density", "lowest_level",
    )


def measure_rows(measures: DataFrame) -> DataFrame:
    quarter = lambda c: rational_text(c, F.col("tpq"))
    return measures.select(
        "score_id", F.col("measure_index").alias("index"), F.col("measure_number").alias("number"), quarter(F.col("start")).alias("start_quarter"),
        quarter(F.col("start") + F.col("full")).alias("end_quarter"), quarter(F.col("full")).alias("full_duration_quarter"), quarter(F.col("actual")).alias("actual_duration_quarter"),
        quarter(F.col("pickup_shift")).alias("pickup_shift_quarter"), "opening_anacrusis", F.concat_ws("/", "num", "den").alias("meter"),
    )


def score_summary(measures: DataFrame, events: DataFrame) -> DataFrame:
    """One row per score: measures, hits, Levels in use, hit source."""
    counts = measures.groupBy("score_id").agg(F.count(F.lit(1)).alias("measure_count"))
    recovered = F.bool_or("canonical_recovered") if "canonical_recovered" in events.columns else F.lit(False)
    found = events.groupBy("score_id").agg(F.count(F.lit(1)).alias("hit_count"), F.max("height").alias("max_level"), recovered.alias("_recovered"))
    used = events.select("score_id", F.explode("levels").alias("level")).distinct().groupBy("score_id").agg(F.array_sort(F.collect_list("level")).alias("levels_enabled"))
    joined = counts.join(found, "score_id", "left").join(used, "score_id", "left")
    return joined.select(
        "score_id", "measure_count", F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("max_level", F.lit(0)).alias("max_level"),
        F.coalesce("levels_enabled", F.array().cast("array<int>")).alias("levels_enabled"),
        F.when(F.col("_recovered"), "canonical-score-time").otherwise("musicxml-symbolic").alias("analysis_hit_source"))


def structural_points(events: DataFrame) -> DataFrame:
    """Events that reached a Level, in the shape older consumers read."""
    return events.filter(F.size("levels") > 0).select(
        "score_id", "segment_index", rational_text(F.col("onset"), F.col("tpq")).alias("time_quarter"), "levels", "height", "density", "lowest_level", F.lit(True).alias("attack"))


# Nested documents hold at most this many events; longer scores are split into numbered pages, none is dropped.
DOCUMENT_EVENTS = 10_000


def score_documents(segments: DataFrame, events: DataFrame) -> DataFrame:
    """Nested documents: a segment with its events, in numbered pages of bounded size."""
    keys = ["score_id", "segment_index"]
    rows, scan = sized_scan(events, keys, ["onset"])
    numbered = scan.number(rows, "_nth").withColumn("document_page", int_div(F.col("_nth"), DOCUMENT_EVENTS))
    event = F.struct("onset", "measure_index", "offset", "duration", "levels", "height", "density", "lowest_level")
    body = numbered.groupBy(*keys, "document_page").agg(F.array_sort(F.collect_list(event)).alias("events"))
    header = segment_rows(segments, events)
    packed = header.select(*keys, F.struct(*[c for c in header.columns if c not in keys]).alias("segment"))
    return packed.join(body, keys, "left")


def summary_documents(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Summary rows as JSON: events with Levels and their Level-1 labels."""
    kept = events.filter(F.size("levels") > 0).select("score_id", "segment_index", "onset", "measure_index", "offset", "duration", "levels", "height", "density", "lowest_level", "pitches")
    named = labels.select("score_id", "segment_index", "onset", "label")
    return kept.join(named, ["score_id", "segment_index", "onset"], "left").select("score_id", F.to_json(F.struct(*[c for c in kept.columns if c != "score_id"], "label")).alias("document"))


def placement_documents(**placed: DataFrame) -> DataFrame:
    """Placed pieces of every kind as JSON rows under (score, page, kind); pieces without a position are left to the missing report."""
    def rows(kind: str, df: DataFrame) -> DataFrame:
        found = df.filter("page_index IS NOT NULL AND reason IS NULL")
        return found.select("score_id", "page_index", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in found.columns if c not in ("score_id", "page_index", "reason")])).alias("document"))

    return reduce(DataFrame.unionByName, (rows(kind, df) for kind, df in placed.items()))


def audit_documents(audit: DataFrame) -> DataFrame:
    """Measure audits as JSON rows under (score, measure)."""
    return audit.select("score_id", "measure_index", F.to_json(F.struct(*[c for c in audit.columns if c not in ("score_id", "measure_index")])).alias("document"))


def column_audit(columns: DataFrame) -> DataFrame:
    """Recovered columns as JSON rows for review."""
    quarter = lambda c: rational_text(F.col(c), F.col("tpq"))
    shown = columns.withColumns({"onset_quarter": quarter("onset"), "duration_quarter": quarter("duration")})
    return shown.select("score_id", "measure_index", F.to_json(F.struct(*[c for c in shown.columns if c not in ("score_id", "measure_index")])).alias("document"))

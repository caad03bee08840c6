"""Sparse measure lists completed to the recognised stack order, or refused with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.notation import measure_number
from pulsegrid.functions.rational import int_div
from pulsegrid.operators.joins import sorted_join
from pulsegrid.operators.segments import measure_scan

NOT_NUMERIC = "numbering-not-numeric"
NOT_INCREASING = "numbering-not-increasing"
NOT_COVERING = "numbering-does-not-cover-stacks"
CONFLICTING_METERS = "conflicting-neighbour-meters"
UNKNOWN_MEASURE = "hit-in-unknown-measure"


def framework_gaps(measures: DataFrame, stack_counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return (measures in stack order, verdict per score).

    Needs measures(score_id, measure_index, measure_number, num, den, full, tpq, ...) and stack_counts(score_id, stacks).  A score whose
    stacks outnumber its measures is expanded only if its numbers rise strictly and cover the stacks exactly; a missing measure takes the
    meter of its two neighbours, which must agree.  Refused scores keep a verdict row and no measures; scores without stacks keep their measures.
    """
    scan = measure_scan(measures)
    numbered = measures.withColumn("_no", measure_number(F.col("measure_number")))
    linked = scan.neighbour(numbered, +1, _next_no=F.col("_no"), _next_num=F.col("num"), _next_den=F.col("den"), _next_index=F.col("measure_index"))
    step = F.col("_next_no") - F.col("_no")
    last = F.col("_next_index").isNull()
    checks = linked.groupBy("score_id").agg(
        F.count(F.lit(1)).alias("measures"),
        F.bool_or(F.col("_no").isNull()).alias("_text"),
        F.bool_or(F.coalesce(step <= 0, F.lit(False))).alias("_falls"),
        F.min_by("_no", "measure_index").alias("base_number"), F.max_by("_no", "measure_index").alias("_last_no"),
        F.bool_or(F.coalesce((step > 1) & ((F.col("num") != F.col("_next_num")) | (F.col("den") != F.col("_next_den"))), F.lit(False))).alias("_clash"),
    )
    joined = stack_counts.join(checks, "score_id", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("stacks", "measures")})
    sparse = F.col("stacks") > F.col("measures")
    reason = (
        F.when(~sparse, F.lit(None))
        .when((F.col("measures") == 0) | F.col("_text"), NOT_NUMERIC)
        .when(F.col("_falls"), NOT_INCREASING)
        .when(F.col("_last_no") - F.col("base_number") != F.col("stacks") - 1, NOT_COVERING)
        .when(F.col("_clash"), CONFLICTING_METERS)
    )
    verdicts = joined.select(
        "score_id", "stacks", "measures", "base_number", reason.alias("rejection"),
        (sparse & reason.isNull()).alias("reconciled"), F.when(sparse & reason.isNull(), F.col("stacks") - F.col("measures")).otherwise(F.lit(0)).alias("synthesized"),
    )
    accepted = verdicts.filter("rejection IS NULL").select("score_id", "reconciled", "base_number")
    inside = linked.join(accepted, "score_id")
    here = F.when(F.col("reconciled"), F.col("_no") - F.col("base_number")).otherwise(F.col("measure_index")).cast("int")
    end = F.when(F.col("reconciled") & ~last, F.col("_next_no") - F.col("base_number") - 1).otherwise(here).cast("int")
    expanded = inside.withColumn("_here", here).withColumn("_index", F.explode(F.sequence(here, end)))
    added = F.col("_index") > F.col("_here")
    plain = int_div(F.col("num") * 4 * F.col("tpq"), F.col("den")).cast("bigint")
    columns = {
        "old_index": F.when(~added, F.col("measure_index")),
        "synthesized": added,
        "measure_number": F.when(added, (F.col("base_number") + F.col("_index")).cast("string")).otherwise(F.col("measure_number")),
        "full": F.when(added, plain).otherwise(F.col("full")),
        "actual": F.when(added, plain).otherwise(F.col("actual")),
        "pickup_shift": F.when(added, F.lit(0)).otherwise(F.col("pickup_shift")).cast("bigint"),
        "implicit": F.coalesce(F.col("implicit") & ~added, F.lit(False)),
        "opening_anacrusis": F.coalesce(F.col("opening_anacrusis") & ~added, F.lit(False)),
        "measure_index": F.col("_index"),
    }
    present = {c: e for c, e in columns.items() if c in (*measures.columns, "old_index", "synthesized")}
    rest = [c for c in measures.columns if c not in present and c != "start"]
    framework = expanded.select(*rest, *[e.alias(c) for c, e in present.items()])
    return scan.running(framework, exclusive=True, start=("sum", F.col("full"))), verdicts


def remap_hits(hits: DataFrame, framework: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Move hits to their measure's new index and recompute onsets; hits of unknown measures are returned separately."""
    place = framework.filter("old_index IS NOT NULL").select("score_id", F.col("old_index").alias("measure_index"), F.col("measure_index").alias("_new"), F.col("start").alias("_start"))
    kept = sorted_join(hits, place, ["score_id", "measure_index"])
    rest = [c for c in hits.columns if c not in ("measure_index", "onset")]
    moved = kept.select(*rest, F.col("_new").alias("measure_index"), (F.col("_start") + F.col("offset")).alias("onset"))
    return moved, sorted_join(hits, place, ["score_id", "measure_index"], "left_anti")


def framework_warnings(verdicts: DataFrame) -> DataFrame:
    code = (
        F.when(F.col("rejection").isNotNull(), F.col("rejection"))
        .when(F.col("reconciled"), "measures-restored")
        .when(F.col("stacks") < F.col("measures"), "fewer-stacks-than-measures")
    )
    return verdicts.withColumn("code", code).filter("code IS NOT NULL").select(
        "score_id", F.lit("framework").alias("stage"), "code", F.lit(None).cast("int").alias("measure_index"),
        F.create_map(F.lit("stacks"), F.col("stacks").cast("string"), F.lit("measures"), F.col("measures").cast("string"), F.lit("restored"), F.col("synthesized").cast("string")).alias("detail"),
    )

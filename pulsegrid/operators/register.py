"""Registration: events to notation columns, wave, pivots and tree to existing anchors, with full accounting of what did not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Reasons for a missing registration and sources of a position.
NO_COLUMN = "canonical-attack-column-not-found"
NO_GEOMETRY = "exact-attacking-notehead-geometry-not-found"
NO_PAGE = "page-dimensions-unavailable"
NO_ATTACK_ANCHOR = "validated-attack-anchor-not-found"
NO_WAVE_ANCHOR = "existing-wave-anchor-not-found"
NO_NODE_ANCHOR = "existing-actual-wave-anchor-not-found"
NO_ENDPOINT = "registered-tree-node-endpoint-missing"
EXACT_HEAD = "canonical-score-exact-attacking-notehead-center"

KEY = ["score_id", "measure_index", "offset"]


def nearest(points: Column, target: Column, x: str = "x") -> Column:
    """Element of an array of structs whose ``x`` is closest to the target; ties by the remaining fields in order."""
    ranked = F.transform(points, lambda p: F.struct(F.abs(p[x] - target).alias("d"), p.alias("p")))
    return F.array_min(ranked)["p"]


def closest_rows(rows: DataFrame, keys: list[str], distance: Column, ties: list[str]) -> DataFrame:
    """Row of each key with the least distance, ties in the given order; combines on the map side."""
    kept = [c for c in rows.columns if c not in keys]
    return rows.withColumn("_d", distance).groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct("_d", *ties)).alias("_r")).select(*keys, "_r.*")


def head_position(columns: DataFrame) -> Column:
    """Exact attacking notehead closest to the column's own x (ties: x, y, chord id); null when no head has exact geometry."""
    exact = F.filter("notation_events", lambda e: (e["kind"] == "head") & e["attack"] & e["head_geometry_exact"] & e["visual_x_abs"].isNotNull() & e["visual_y_abs"].isNotNull())
    points = F.transform(exact, lambda e: F.struct(e["visual_x_abs"].alias("x"), e["visual_y_abs"].alias("y"), e["chord_id"].alias("id")))
    return nearest(points, F.col("x_abs"))


def last_column(columns: DataFrame) -> DataFrame:
    """One attack column per (measure, offset); of several the last one counts."""
    kept = [c for c in columns.columns if c not in KEY]
    return columns.filter("attack").groupBy(*KEY).agg(F.max_by(F.struct(*kept), "column_index").alias("_c")).select(*KEY, "_c.*")


def register_anchors(events: DataFrame, columns: DataFrame, pages: DataFrame) -> DataFrame:
    """Every event with Levels, with its page position or the reason why there is none.

    Needs events(KEY, segment_index, onset, levels), columns(KEY, column_index, attack, page_index, system_index, x_abs,
    notation_events, timing_source, confidence) and pages(score_id, page_index, width, height).
    """
    targets = events.filter(F.size("levels") > 0)
    taken = last_column(columns).withColumn("_pos", head_position(columns)).select(
        *KEY, "page_index", "system_index", "timing_source", "confidence", "_pos", F.lit(True).alias("_column"))
    sized = pages.select("score_id", "page_index", F.col("width").cast("double").alias("_pw"), F.col("height").cast("double").alias("_ph"))
    joined = targets.join(taken, KEY, "left").join(sized, ["score_id", "page_index"], "left")
    reason = (
        F.when(F.col("_column").isNull(), NO_COLUMN).when(F.col("_pos").isNull(), NO_GEOMETRY)
        .when(F.coalesce(F.col("_pw"), F.lit(0.0)) <= 0, NO_PAGE)
    )
    mapped = reason.isNull()
    return joined.select(
        *targets.columns, "page_index", "system_index", "timing_source", "confidence", reason.alias("reason"),
        F.when(mapped, F.col("_pos.x")).alias("recovered_x_abs"), F.when(mapped, F.col("_pos.x") / F.col("_pw")).alias("cx_norm"),
        F.when(mapped, F.when(F.col("_ph") > 0, F.col("_pos.y") / F.col("_ph")).otherwise(F.lit(0.0))).alias("cy_norm"),
        F.when(mapped, F.lit(EXACT_HEAD)).alias("registration_source"),
    )


def register_stats(anchors: DataFrame) -> DataFrame:
    """Expected, mapped and missing labels per Level, with a total row per score (level 0)."""
    per_level = anchors.select("score_id", F.explode("levels").alias("level"), "reason")
    counted = per_level.groupBy("score_id", "level", F.col("reason").alias("_r")).agg(F.count(F.lit(1)).alias("n"))
    rolled = counted.rollup("score_id", "level").agg(
        F.sum("n").alias("expected"), F.sum(F.when(F.col("_r").isNull(), F.col("n")).otherwise(0)).alias("mapped"),
        F.sum(F.when(F.col("_r").isNotNull(), F.col("n")).otherwise(0)).alias("missing"))
    return rolled.filter("score_id IS NOT NULL").withColumn("level", F.coalesce("level", F.lit(0)))


def reason_stats(anchors: DataFrame) -> DataFrame:
    """Events per outcome: mapped ones and one row per reason."""
    return anchors.groupBy("score_id", F.coalesce("reason", F.lit("mapped")).alias("outcome")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.size("levels")).alias("labels"))


def missing_targets(anchors: DataFrame) -> DataFrame:
    """Unregistered events, one row per Level with the reason."""
    return anchors.filter("reason IS NOT NULL").select("score_id", F.explode("levels").alias("level"), "measure_index", "offset", "reason")


def first_anchor(anchors: DataFrame, *kept: str) -> DataFrame:
    """One anchor per (measure, offset), the first in page and reading order, and how many repeats were left out."""
    return anchors.groupBy(*KEY).agg(
        F.min_by(F.struct(*kept), F.struct("page_index", "system_index", *([] if "onset" not in anchors.columns else ["onset"]))).alias("_a"),
        (F.count(F.lit(1)) - 1).alias("duplicates"))


_PLACE = ("page_index", "system_index", "cx_norm", "cy_norm", "recovered_x_abs", "registration_source")


def register_points(points: DataFrame, anchors: DataFrame, reason: str, on: list[str] | None = None) -> DataFrame:
    """Wave points, pivots or tree nodes at existing anchors only; unmatched ones carry ``reason`` and no position."""
    placed = anchors.filter("reason IS NULL") if "reason" in anchors.columns else anchors
    lookup = first_anchor(placed, *[c for c in _PLACE if c in anchors.columns])
    renamed = lookup.select(F.col("score_id"), *[F.col(k).alias(o) for k, o in zip(KEY[1:], on or KEY[1:])], "_a")
    keys = ["score_id", *(on or KEY[1:])]
    base = points.drop(*[c for c in (*_PLACE, "reason") if c in points.columns])
    return base.join(renamed, keys, "left").select(
        *base.columns, *[F.col(f"_a.{c}").alias(c) for c in _PLACE if c in anchors.columns], F.when(F.col("_a").isNull(), F.lit(reason)).alias("reason"))


def register_wave(wave: DataFrame, anchors: DataFrame) -> DataFrame:
    return register_points(wave, anchors, NO_ATTACK_ANCHOR)


def register_pivots(found: DataFrame, wave_anchors: DataFrame) -> DataFrame:
    return register_points(found, wave_anchors, NO_WAVE_ANCHOR, ["pivot_measure_index", "pivot_offset"])


def register_nodes(nodes: DataFrame, wave_anchors: DataFrame) -> DataFrame:
    return register_points(nodes, wave_anchors, NO_NODE_ANCHOR)


def duplicate_anchors(anchors: DataFrame) -> DataFrame:
    placed = anchors.filter("reason IS NULL") if "reason" in anchors.columns else anchors
    return first_anchor(placed, "page_index").filter("duplicates > 0").select(*KEY, "duplicates")


def register_branches(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Branches with both ends placed: one complete piece inside a system, else one piece per end; the rest carry a reason."""
    ends = nodes.filter("reason IS NULL").select("score_id", "node_index", F.struct("page_index", "system_index", "cx_norm", "recovered_x_abs").alias("end"))
    source = ends.select("score_id", F.col("node_index").alias("source_node_index"), F.col("end").alias("_s"))
    target = ends.select("score_id", F.col("node_index").alias("target_node_index"), F.col("end").alias("_t"))
    joined = edges.join(source, ["score_id", "source_node_index"], "left").join(target, ["score_id", "target_node_index"], "left")
    together = (F.col("_s.page_index") == F.col("_t.page_index")) & (F.col("_s.system_index") == F.col("_t.system_index"))

    def piece(role: str, end: str | None, level: str | None) -> Column:
        side = end or "_s"
        return F.struct(
            F.lit(role).alias("span_role"), F.col(f"{side}.page_index").alias("page_index"), F.col(f"{side}.system_index").alias("system_index"),
            (F.col(f"{side}.cx_norm") if end else F.lit(None).cast("double")).alias("cx_norm"),
            (F.col(level) if level else F.lit(None)).cast("int").alias("endpoint_level"))

    lost = F.col("_s").isNull() | F.col("_t").isNull()
    nowhere = F.struct(F.lit("missing").alias("span_role"), F.lit(None).cast("int").alias("page_index"), F.lit(None).cast("int").alias("system_index"),
                       F.lit(None).cast("double").alias("cx_norm"), F.lit(None).cast("int").alias("endpoint_level"))
    pieces = F.when(lost, F.array(nowhere)).when(together, F.array(piece("complete", None, None))).otherwise(
        F.array(piece("source-endpoint", "_s", "source_level"), piece("target-endpoint", "_t", "target_level")))
    return joined.withColumn("_p", F.explode(pieces)).select(
        *edges.columns, "_p.*", F.col("_s.cx_norm").alias("source_cx_norm"), F.col("_s.recovered_x_abs").alias("source_x_abs"),
        F.col("_t.cx_norm").alias("target_cx_norm"), F.col("_t.recovered_x_abs").alias("target_x_abs"),
        F.when(lost, F.lit(NO_ENDPOINT)).alias("reason"), F.col("_s").isNull().alias("missing_source"), F.col("_t").isNull().alias("missing_target"))


def point_stats(points: DataFrame, name: str) -> DataFrame:
    """Expected, mapped and missing points per score."""
    aggregates = [F.count(F.lit(1)).alias(f"{name}_expected"), F.count_if(F.col("reason").isNull()).alias(f"{name}_mapped"),
                  F.count_if(F.col("reason").isNotNull()).alias(f"{name}_missing")]
    if "height" in points.columns:
        aggregates.append(F.max("height").alias(f"{name}_max_height"))
    return points.groupBy("score_id").agg(*aggregates)


def branch_stats(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("score_id").agg(
        F.count_if(F.col("span_role") == "complete").alias("complete_branches"), F.count_if(F.col("span_role") == "source-endpoint").alias("cross_system_branches"),
        F.count_if(F.col("span_role") == "missing").alias("missing_branches"), F.count_if(F.col("span_role") != "missing").alias("visual_pieces"))


def unregistered_stats(events: DataFrame) -> DataFrame:
    """The same accounting when there is no notation to register to: everything expected is missing."""
    return register_stats(events.filter(F.size("levels") > 0).withColumn("reason", F.lit(NO_COLUMN)))

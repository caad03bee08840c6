"""Derivatives of the Levels: height wave, turning points, nearest-predecessor tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators.scan import Scan, sized_scan

POINT_ORDER = ("segment_index", "onset", "measure_index", "offset")


def wave_profile(events: DataFrame) -> DataFrame:
    """Events that reached a Level, one per (measure, offset); the earliest segment wins."""
    kept = ["segment_index", "onset"] + [
        c for c in events.columns if c not in ("score_id", "measure_index", "offset", "segment_index", "onset", "notes")
    ]
    return (
        events.filter(F.size("levels") > 0)
        .groupBy("score_id", "measure_index", "offset")
        .agg(F.min_by(F.struct(*kept), F.struct("segment_index", "onset")).alias("_p"))
        .select("score_id", "measure_index", "offset", "_p.*")
    )


def profile_scan(wave: DataFrame, probe: DataFrame | None = None) -> tuple[DataFrame, Scan]:
    """Score-wide order of the wave; ``within("segment_index")`` gives the same order inside each meter segment."""
    return sized_scan(wave, ["score_id"], list(POINT_ORDER), probe)


def pivots(wave: DataFrame, scan: Scan) -> DataFrame:
    """Last crest point before each descent that is later followed by an ascent.

    Strict ascents cut a segment into non-increasing runs.  Inside a run the crest is the latest point of greatest height, the point
    after it is the first lower one, the run's last point is the trough, and the point after the run is the recovery.
    """
    inside = scan.within("segment_index")
    has_number = "measure_number" in wave.columns
    place = ["onset", "measure_index", "offset"] + (["measure_number"] if has_number else [])
    slim = wave.select("score_id", "segment_index", *place, "height", *([scan.chunk] if scan.chunk else []))
    linked = inside.neighbour(slim, -1, _before=F.col("height"))
    linked = inside.neighbour(linked, +1, _next=F.struct(*place, "height"))
    runs = inside.running(linked, _run=("sum", F.coalesce((F.col("height") > F.col("_before")).cast("int"), F.lit(0))))
    chunk = [scan.chunk] if scan.chunk else []
    grouped = runs.groupBy("score_id", "segment_index", "_run").agg(
        F.max(F.struct("height", *place, "_next", *chunk)).alias("c"),
        F.max(F.struct(*place, "height", "_next")).alias("t"),
    ).filter("c.height > t.height AND t._next IS NOT NULL")
    named = lambda source, prefix: [F.col(f"{source}.{p}").alias(f"{prefix}_{p}") for p in place]
    depth = F.col("c.height") - F.col("t.height")
    found = grouped.select(
        "score_id", "segment_index",
        F.when(depth == 1, "simple").otherwise("compound").alias("kind"),
        depth.alias("drop_depth"),
        (F.col("c.height") - F.col("c._next.height")).alias("immediate_drop_depth"),
        F.col("c.height").alias("crest_height"),
        F.col("c._next.height").alias("after_drop_height"),
        F.col("t.height").alias("trough_height"),
        F.col("t._next.height").alias("recovery_height"),
        *named("c", "pivot"), *named("c._next", "after_drop"), *named("t", "trough"), *named("t._next", "recovery"),
        *[F.col(f"c.{x}").alias(x) for x in chunk],
    )
    by_pivot = Scan(scan.keys, ("segment_index", "pivot_onset", "pivot_measure_index", "pivot_offset"), scan.chunk)
    return by_pivot.number(found, "pivot_index").drop(*chunk)


def deepest_level(wave: DataFrame) -> int:
    return int(wave.agg(F.max("lowest_level")).first()[0] or 1)


def tree(wave: DataFrame, scan: Scan) -> DataFrame:
    """Nodes with their parent: the nearest earlier point of the segment whose lowest Level is not above the node's own.

    For each Level the latest point at or below it is carried along the order; a node reads the entry of its own Level.  Levels are
    few, so this is one window with one running maximum per Level.
    """
    inside = scan.within("segment_index")
    place = ["onset", "measure_index", "offset"] + (["measure_number"] if "measure_number" in wave.columns else [])
    chunk = [scan.chunk] if scan.chunk else []
    slim = wave.select("score_id", "segment_index", *place, "levels", "lowest_level", F.col("height").alias("highest_level"), *chunk)
    nodes = scan.number(slim, "node_index")
    point = F.struct(*place, "node_index", "lowest_level")
    latest = {f"_at{lv}": ("max", F.when(F.col("lowest_level") <= lv, point)) for lv in range(1, deepest_level(wave) + 1)}
    carried = inside.running(nodes, exclusive=True, **latest)
    return carried.withColumn("parent", F.get(F.array(*latest), F.col("lowest_level") - 1)).drop(*latest)


def branches(nodes: DataFrame, scan: Scan) -> DataFrame:
    """Edge table of the tree, source = parent, numbered in target order."""
    place = ["onset", "measure_index", "offset"] + (["measure_number"] if "measure_number" in nodes.columns else [])
    chunk = [scan.chunk] if scan.chunk else []
    edges = nodes.filter("parent IS NOT NULL").select(
        "score_id", "segment_index",
        F.col("parent.node_index").alias("source_node_index"), F.col("node_index").alias("target_node_index"),
        *[F.col(f"parent.{p}").alias(f"source_{p}") for p in place], F.col("parent.lowest_level").alias("source_level"),
        *[F.col(p).alias(f"target_{p}") for p in place], F.col("lowest_level").alias("target_level"),
        (F.col("onset") - F.col("parent.onset")).alias("distance"),
        (F.col("parent.lowest_level") == F.col("lowest_level")).alias("same_level"),
        (F.col("parent.lowest_level") < F.col("lowest_level")).alias("ascending_level"),
        *chunk,
    )
    order = ("segment_index", "target_onset", "target_measure_index", "target_offset")
    return Scan(scan.keys, order, scan.chunk).number(edges, "branch_index").drop(*chunk)


def tree_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with incoming and outgoing branch counts and the root flag."""
    leaving = (
        nodes.filter("parent IS NOT NULL").groupBy("score_id", F.col("parent.node_index").alias("node_index"))
        .agg(F.count(F.lit(1)).alias("outgoing_branches"))
    )
    return nodes.join(leaving, ["score_id", "node_index"], "left").withColumns({
        "incoming_branches": F.col("parent").isNotNull().cast("int"),
        "outgoing_branches": F.coalesce("outgoing_branches", F.lit(0)),
        "root": F.col("parent").isNull(),
    })


def pivot_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("score_id").agg(
        F.count(F.lit(1)).alias("pivots"),
        F.count_if(F.col("kind") == "simple").alias("simple_pivots"),
        F.count_if(F.col("kind") == "compound").alias("compound_pivots"),
        F.max("drop_depth").alias("deepest_drop"),
    )


def tree_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("score_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("parent").isNotNull()).alias("branches"),
        F.count_if(F.col("parent").isNull()).alias("roots"),
    )

"""Levels of every hit: recursive beat grid plus data-driven refinement of the beats that hold interior hits.

Refinement splits a span only where hits lie strictly inside it, and what it adds at a span's end points depends on the hits of
that span alone.  Each hit is therefore followed twice: as the start side of what lies to its right (``rel`` in [0, W)) and as the end
side of what lies to its left (``rel`` in (0, W]).  With f parts, ``rel`` becomes ``rel*f mod W`` and the denominator never grows.

* Beats whose arities are the defaults (no tuplet marks, no recovered off-dyadic hits) need no rounds: a hit strictly inside a span
  always splits it, and a span that starts or ends at a hit is split exactly when the neighbour hit is nearer than its width.  That is
  one sort per beat for the neighbours and integer arithmetic per row.
* Other beats let the hits of a span vote on its arity.  Their rows carry the span as (s, q), the q-th of s equal parts; all rounds of a beat run in one
  task on Arrow columns, many whole beats at a time (``votes``), without the hits' payload.

Either way a beat holds at most 2*W rows because hits are unique per tick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.grid import child_level, grid_position, grid_top, point_levels
from pulsegrid.functions.rational import ceil_log2_ratio, int_div, power_of_two, trailing_zeros
from pulsegrid.operators import votes
from pulsegrid.session import write_table

# Fixed value: refinement rounds allowed beyond the number a beat's smallest gap asks for.
DEPTH_SLACK = 6

_BEAT = ("score_id", "segment_index", "_beat")


def place_in_beats(hits: DataFrame) -> DataFrame:
    """Beat number inside the segment (counted from the segment start) and tick inside the beat."""
    since = F.col("onset") - F.col("segment_start")
    beats = int_div(F.col("segment_end") - F.col("segment_start") + F.col("beat_ticks") - 1, F.col("beat_ticks"))
    return hits.withColumns({"_beat": int_div(since, F.col("beat_ticks")), "_rel": since % F.col("beat_ticks"), "_beats": beats})


def two_sided(hits: DataFrame, payload: list[str]) -> DataFrame:
    """Start-side and end-side row of each hit; a hit on a beat is the end side of the beat before."""
    marks = [c for c in ("tuplets", "canonical_recovered") if c in hits.columns]
    fixed = [c for c in payload if c not in ("score_id", "segment_index", "onset")]
    at_boundary = F.col("_rel") == 0
    sides = F.array(
        F.struct(F.lit("S").alias("side"), F.col("_beat").alias("beat"), F.col("_rel").alias("rel")),
        F.struct(
            F.lit("E").alias("side"), F.when(at_boundary, F.col("_beat") - 1).otherwise(F.col("_beat")).alias("beat"),
            F.when(at_boundary, F.col("beat_ticks")).otherwise(F.col("_rel")).alias("rel"),
        ),
    )
    opened = hits.withColumn("_two", F.explode(sides)).filter("_two.beat >= 0").select(
        "score_id", "segment_index", "onset", "beat_ticks", "top_base", "compound", "_beats",
        F.col("_two.side").alias("_side"), F.col("_two.beat").alias("_beat"), F.col("_two.rel").alias("_rel"),
        F.when(F.col("_two.side") == "S", F.struct(*fixed)).alias("_payload"),
        *[F.when(F.col("_two.side") == "S", F.col(c)).alias(c) for c in marks],
    )
    return opened


def beat_rows(hits: DataFrame) -> DataFrame:
    """Two-sided rows with neighbour gaps, depth allowance, grid Levels and the Level of the beat's own span."""
    rows = two_sided(place_in_beats(hits), hits.columns)
    ordered = Window.partitionBy(*_BEAT).orderBy("_rel", "_side")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts, width = F.col("_side") == "S", F.col("beat_ticks")
    inner = starts & (F.col("_rel") > 0)
    before = F.last(F.when(inner, F.col("_rel")), ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(starts, F.col("_rel")), ignorenulls=True).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.select("*", before.alias("_before"), after.alias("_after"), F.row_number().over(ordered).alias("_nth"))

    on_beat = starts & (F.col("_rel") == 0)
    to_left = F.col("_rel") - F.coalesce("_before", F.lit(0))
    to_right = F.coalesce("_after", width) - F.col("_rel")
    smallest = F.when(inner, F.least(to_left, to_right))
    top = grid_top(F.col("top_base"), F.col("_beats"))
    rows = rows.select(
        "*",
        F.coalesce(F.min(smallest).over(whole), width).alias("_smallest"),
        # The grid fold runs once per beat (first row) and for hits on a beat.
        F.when((F.col("_nth") == 1) | on_beat, grid_position(F.col("_beat"), top, F.col("top_base"))).alias("_grid"),
    )
    none = F.array().cast("array<int>")
    return rows.select(
        *[c for c in rows.columns if c not in ("_before", "_after", "_nth", "_smallest", "_grid")],
        F.when(starts, F.col("_after") - F.col("_rel")).otherwise(F.col("_rel") - F.col("_before")).alias("_gap"),
        (ceil_log2_ratio(width, F.col("_smallest")) + DEPTH_SLACK).cast("int").alias("_cap"),
        F.first("_grid").over(whole)["span"].alias("_parent"),
        F.coalesce(F.when(on_beat, F.col("_grid.levels")), none).alias("_levels"),
    )


def is_irregular(rows: DataFrame) -> Column | None:
    """True for every row of a beat whose arities the hits decide; None when the hits carry nothing that could."""
    starts = F.col("_side") == "S"
    reasons: list[Column] = []
    if "tuplets" in rows.columns:
        reasons.append(starts & (F.size("tuplets") > 0))
    if "canonical_recovered" in rows.columns:
        first = F.when(F.col("compound"), F.lit(3)).otherwise(F.lit(1))
        reasons.append(starts & F.col("canonical_recovered") & ((F.col("_rel") * first) % power_of_three(F.col("beat_ticks")) != 0))
    if not reasons:
        return None
    anyone = reasons[0] if len(reasons) == 1 else reasons[0] | reasons[1]
    return F.coalesce(F.max(anyone).over(Window.partitionBy(*_BEAT)), F.lit(False))


def power_of_three(width: Column) -> Column:
    """Largest power of three that divides ``width``."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(26)), F.lit(1).cast("bigint"), lambda acc, _: F.when(width % (acc * 3) == 0, acc * 3).otherwise(acc)
    )


def refine(hits: DataFrame) -> DataFrame:
    """Add levels, height, density, lowest_level and refinement notes to segmented hits."""
    rows = beat_rows(hits)
    irregular = is_irregular(rows)
    kept = ["score_id", "segment_index", "onset", "_payload", "_levels", "_note"]
    if irregular is None:
        settled = by_default_arities(rows).select(*kept)
    else:
        # Both branches and every voting block read these rows, so they are written once.
        rows = write_table(rows.withColumn("_irregular", irregular), "beat-rows")
        settled = by_default_arities(rows.filter("NOT _irregular")).select(*kept)
        voting = rows.filter("_irregular")
        if not voting.isEmpty():
            # The payload does not go to the workers: its rows bear the grid Levels only, and meet the others by hit below.
            hits_of = voting.filter("_side = 'S'").withColumn("_note", F.array().cast("array<string>")).select(*kept)
            settled = settled.unionByName(hits_of).unionByName(by_votes(voting).withColumn("_payload", F.lit(None)).select(*kept))

    collected = settled.groupBy("score_id", "segment_index", "onset").agg(
        F.first("_payload", ignorenulls=True).alias("_payload"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_levels")))).alias("levels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_note")))).alias("notes"),
    )
    rest = [c for c in hits.columns if c not in ("score_id", "segment_index", "onset")]
    return with_profile(collected.select(
        "score_id", "segment_index", "onset", *[F.col(f"_payload.{c}").alias(c) for c in rest], "levels", "notes",
    ))


def by_default_arities(rows: DataFrame) -> DataFrame:
    """Levels of hits in beats that split by the defaults: a third first in compound meters, then halves.

    Halving a span of width W puts a hit at ``rel`` on a boundary after n = log2(W / gcd(rel, W)) steps (never if an odd factor of W is
    missing in ``rel``); it takes the Level of that step.  From there on the span beside it keeps splitting while the neighbour hit is
    nearer than its width, which is ceil(log2(W / gap)) steps from the start, one Level each.
    """
    width, is_end, rel, parent = F.col("beat_ticks"), F.col("_side") == "E", F.col("_rel"), F.col("_parent").cast("int")
    # The third of a compound beat.
    three = F.lit(3)
    k = F.when(is_end, int_div(rel * 3 - 1, width)).otherwise(int_div(rel * 3, width)).cast("int")
    on_third = (rel * 3) % width == 0
    opened = ((rel > 0) & (rel < width)) | F.coalesce(F.col("_gap") < width, F.lit(False))
    thirds = F.transform(point_levels(three, F.when(is_end, F.col("_k") + 1).otherwise(F.col("_k"))), lambda level: level + F.col("_parent"))
    compound = F.col("compound")
    rows = rows.withColumn("_k", k)
    rows = rows.withColumns({
        "_open": ~compound | opened,
        "_third": F.when(compound & opened & on_third, thirds),
        "_from": F.when(compound, parent + child_level(three, F.col("_k"))).otherwise(parent),
        "_at": F.when(compound, rel * 3 - F.col("_k") * width).otherwise(rel),
        "_parts": F.when(compound, 3).otherwise(1),
    })
    # The halves after it.
    at, parts = F.col("_at"), F.col("_parts")
    twos = trailing_zeros(width)
    odd = F.call_function("shiftright", width, twos.cast("int"))
    edge = F.when(is_end, at == width).otherwise(at == 0)
    n = F.when(edge, 0).otherwise(twos - trailing_zeros(at)).cast("int")
    lands = edge | ((at % odd == 0) & (n + compound.cast("int") <= F.col("_cap")))
    beside = F.coalesce(ceil_log2_ratio(width, F.col("_gap") * parts), F.lit(0))
    rows = rows.withColumns({
        "_low": F.col("_from") + F.greatest(n, F.lit(1)), "_high": F.when(F.col("_open") & lands, F.col("_from") + F.greatest(n, beside)),
        "_lost": ~is_end & F.col("_open") & ~lands,
    })
    none = F.array().cast("array<int>")
    gained = F.when(F.col("_high") >= F.col("_low"), F.sequence(F.col("_low"), F.greatest(F.col("_low"), F.col("_high")))).otherwise(none)
    s = parts * power_of_two(F.col("_cap") - compound.cast("int"))
    place = F.concat_ws(":", F.lit("depth"), F.col("_beat").cast("string"), int_div(rel * s, width).cast("string"), s.cast("string"))
    return rows.withColumns({
        "_levels": F.concat(F.col("_levels"), F.coalesce("_third", none), gained),
        "_note": F.when(F.col("_lost"), F.array(place)).otherwise(F.array().cast("array<string>")),
    })


def by_votes(rows: DataFrame) -> DataFrame:
    """Arities voted by the hits of each span: explicit tuplets, recovered ternary positions, else the default (``votes``)."""
    kept = ("score_id", "segment_index", "onset")
    marks = [c for c in ("tuplets", "canonical_recovered") if c in rows.columns]
    needed = rows.select(*kept, "beat_ticks", "compound", "_side", "_beat", "_rel", "_cap", "_parent", *marks)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", _levels array<int>, _note array<string>"
    in_order = needed.repartition(*_BEAT).sortWithinPartitions(*_BEAT, "_rel", "_side")
    return in_order.mapInArrow(lambda batches: votes.voted(batches, _BEAT, kept), schema)


def with_profile(events: DataFrame) -> DataFrame:
    """height = highest Level, density = how many, lowest_level = lowest; zero where no Level was reached."""
    return events.withColumns({
        "height": F.coalesce(F.array_max("levels"), F.lit(0)),
        "density": F.size("levels"),
        "lowest_level": F.coalesce(F.array_min("levels"), F.lit(0)),
    })

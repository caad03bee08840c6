"""Whole score jobs on events: every user's events as the elements of a two-part score, as notation graph, and as noteheads on pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.functions.rational import int_div
from pulsegrid.operators import columns as C
from pulsegrid.operators import layout
from pulsegrid.operators.joins import sorted_join
from pulsegrid.plans import scores
from pulsegrid.plans.events import calendar, day_of, read_events, seconds_since_epoch, week_meter, week_of
from pulsegrid.plans.generic import LONG, as_text, longs
from pulsegrid.session import freeze, write_table

PARTS = 2
UNIT = 24


def score_tables(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(elements, raw measures, layout) of a two-part score per user; a day is a measure."""
    kind, size, day = F.col("event_type"), F.ceil("value").cast(LONG), day_of(seconds_since_epoch())
    part = (F.col("event_id") % PARTS).cast("int")
    tie = F.array_compact(F.array(F.when((size % 6).isin(1, 2), "start"), F.when((size % 6).isin(2, 3), "stop")))
    elements = events.select(
        F.col("user_id").alias("score_id"), part.alias("part_ord"), F.concat(F.lit("P"), part + 1).alias("part_id"), day.alias("measure_index"), F.col("event_id").alias("doc_order"),
        F.when(kind == "error", "backup").when(kind == "signup", "forward").otherwise("note").alias("tag"), (size % 8).alias("duration_div"),
        (kind == "click").alias("is_chord"), ((kind == "purchase") & (size % 5 == 0)).alias("is_grace"), ((kind == "view") & (size % 4 == 0)).alias("is_rest"),
        F.lit(None).cast("string").alias("voice"), F.lit(None).cast("string").alias("staff"), F.upper(F.substring(kind, 1, 1)).alias("step"), F.lit(0).alias("alter"),
        (size % 3 + 3).cast("string").alias("octave"), F.lit(False).alias("unpitched"), tie.alias("tie_types"),
        F.lit(None).cast("int").alias("tuplet_actual"), F.lit(None).cast("int").alias("tuplet_normal"), (size % 90).cast("double").alias("default_x"), F.lit(None).cast("double").alias("default_y"))
    index = F.col("measure_index")
    num, den = week_meter(index)
    weekly = index % 7 == 0
    measures = calendar(events).withColumn("part_ord", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).select(
        "score_id", "part_ord", F.concat(F.lit("P"), F.col("part_ord") + 1).alias("part_id"), "measure_index", (index + 1).cast("string").alias("number"), F.lit(False).alias("implicit"),
        F.when(index == 0, F.col("part_ord") + 2).when(index == 5, 4).cast("int").alias("divisions"), F.when(weekly, num).cast("int").alias("beats"), F.when(weekly, den).cast("int").alias("beat_type"),
        F.lit(None).cast("string").alias("time_symbol"), F.lit(1).alias("staves"), F.lit(100.0).alias("width"), weekly.alias("new_page"), (index % 7 == 3).alias("new_system"), F.lit(True).alias("has_print"),
        *[F.lit(None).cast("double").alias(c) for c in ("system_left", "system_distance", "top_system_distance")], F.lit(None).cast("string").alias("right_bar_style"), F.lit(False).alias("right_bar_repeat"))
    empty = [F.lit(None).cast("double").alias(c) for c in ("page_width", "page_height", "left_margin", "right_margin", "top_margin", "bottom_margin", "system_left", "top_system_distance", "system_distance", "staff_distance")]
    return elements, measures, measures.select("score_id").distinct().select("score_id", *empty)


def score_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole parse: cursor, chords, grace notes, rests, ties, pickups, meters, merge. Times in 24ths of a quarter."""
    parsed = scores.parse_scores(*score_tables(read_events(spark, sf_dir)))
    bases = parsed.measures.groupBy("score_id").agg(F.max("tpq").alias("_tpq"))
    up = int_div(F.lit(UNIT), F.col("_tpq"))
    rows = parsed.hits.join(bases, "score_id").withColumns({c: F.col(c) * up for c in ("onset", "duration", "offset")})
    return rows.select(*longs("score_id", "onset", "duration", "offset", "measure_index", "source_count"), as_text("pitches").alias("pitches"))


def score_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the parse: meter carried forward, start, actual duration, pickup shift (24ths), page and system."""
    parsed = scores.parse_scores(*score_tables(read_events(spark, sf_dir)))
    up = int_div(F.lit(UNIT), F.col("tpq"))
    rows = parsed.measures.join(parsed.layouts.select("score_id", "measure_index", "page_index", "system_index", "x_start"), ["score_id", "measure_index"])
    return rows.withColumns({c: F.col(c) * up for c in ("start", "full", "actual", "pickup_shift")}).select(
        *longs("score_id", "measure_index", "num", "den", "start", "full", "actual", "pickup_shift", "page_index", "system_index", "x_start"))


# Rest shapes of the graph by size: every listed length, a numbered one and an unknown one.
REST_SHAPES = ("WHOLE_REST", "HALF_REST", "QUARTER_REST", "EIGHTH_REST", "ONE_16TH_REST", "REST_SIGN")
# Texts of slot times by hour, in whole notes: decimals, an exponent, a malformed one; all other hours are fractions.
SLOT_TEXTS = {3: ".125", 6: "25e-2", 12: "0.5", 18: " 3/4 ", 21: "+0.875", 23: "n/a"}
# Further slots of a stack: (slot_ord, slot_id, time). The later slot of an id wins unless its time is malformed.
MORE_SLOTS = ((30, "7", "1/4"), (31, "9", "bad"))
PIXEL_MINUTES = 4


def _chords(events: DataFrame) -> DataFrame:
    """Chords are distinct (user, day, minute, type), so a stack holds at most 7,200 of them however many events there are."""
    sec = seconds_since_epoch()
    base = events.select(F.col("user_id").alias("score_id"), day_of(sec).alias("day"), int_div(F.pmod(sec, F.lit(86400)), 60).cast("int").alias("minute"),
                         F.col("event_type").alias("kind_name"), F.ceil("value").cast("int").alias("size"))
    # Every table of the graph is a view of the chords, so the chords are written once.
    return write_table(base.groupBy("score_id", "day", "minute", "kind_name").agg(F.max("size").alias("size")), "chords").select(
        "*", F.concat_ws(".", "day", "minute", "kind_name").alias("chord_id"), week_of(F.col("day")).alias("page_index"), F.lit(0).alias("system_index"),
        F.pmod("day", F.lit(7)).cast("int").alias("stack_ord"))


def notation_graph(events: DataFrame) -> dict[str, DataFrame]:
    """Events as a notation graph: one head or rest chord per user, minute and type; stacks are days, slots are hours.

    Heads, dots, ties, stems, beams, flags and rest shapes follow from type and size, with the odd cases of recognised graphs among them: chords without heads, stems
    without an object, stems and beams stated twice, ties on one of two heads, unknown rests.
    """
    chords = _chords(events)
    key = ["score_id", "page_index", "system_index"]
    size, kind = F.col("size"), F.col("kind_name")
    rest, two = kind == "error", kind == "purchase"
    sounding = chords.filter(~rest)
    headed = sounding.filter(~((kind == "signup") & (size % 10 == 0)))
    x, y = int_div(F.col("minute"), PIXEL_MINUTES).cast("double"), F.length("kind_name") * 10.0
    none = F.lit(None).cast("double")
    part = lambda prefix: F.concat(F.lit(prefix), F.col("chord_id"))

    def obj(rows: DataFrame, obj_id: Column, tag: Column | str, shape: Column | str | None, box: tuple = (none, none, none, none), ends: tuple = (none, none), tie: Column | bool = False) -> DataFrame:
        text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
        named = zip(("x", "y", "w", "h", "p1x", "p1y", "p2x", "p2y"), (*box, none, ends[0], none, ends[1]))
        return rows.select(*key, obj_id.alias("obj_id"), text(tag).alias("tag"), text(shape).alias("shape"), F.when(kind.isin("view", "click"), 1).otherwise(2).alias("staff"),
                           *[c.cast("double").alias(n) for n, c in named], (tie if isinstance(tie, Column) else F.lit(tie)).alias("tie"))

    def rel(rows: DataFrame, source: Column, target: Column, kind_: str, order: int = 0, side: Column | None = None) -> DataFrame:
        return rows.select(*key, F.lit(order).alias("rel_ord"), source.alias("source"), target.alias("target"), F.lit(kind_).alias("type"),
                           (F.lit(None) if side is None else side).cast("string").alias("side"))

    every = lambda parts: reduce(DataFrame.unionByName, parts)
    box = (x, y, F.lit(6.0), F.lit(8.0))
    shape = F.when(size % 11 == 0, "WHOLE_NOTE").when(size % 4 == 0, "NOTEHEAD_VOID").otherwise("NOTEHEAD_BLACK")
    rest_shape = F.element_at(F.array(*[F.lit(s) for s in REST_SHAPES]), (size % len(REST_SHAPES) + 1).cast("int"))
    stemmed = sounding.filter(size % 3 != 0)
    beamed, flagged = stemmed.filter(kind.isin("view", "click")), stemmed.filter(~kind.isin("view", "click") & (size % 4 != 0))
    flag = F.when(size % 4 == 1, "FLAG_1").when(size % 4 == 2, "FLAG_2_UP").otherwise("FLAG")
    slurred = headed.filter((size % 6).isin(2, 3, 4))
    dotted, twice = headed.filter(size % 7 == 0), headed.filter(size % 14 == 0)
    side = F.when(size % 5 == 0, "LEFT").otherwise("right")
    # Recovery reads objects and relations many times by tag and type, so both are written as tables.
    objects = write_table(every([
        obj(chords, F.col("chord_id"), F.when(rest, "rest-chord").otherwise("head-chord"), None, box),
        obj(chords.filter(rest), part("m"), "rest", rest_shape, box),
        obj(headed, part("m"), "head", shape, (x, y, F.lit(4.0), F.lit(8.0))),
        obj(headed.filter(two), part("n"), "head", F.when(size % 9 == 0, "NOTEHEAD_VOID").otherwise("NOTEHEAD_BLACK"), (x + 4, y + 12, F.lit(4.0), F.lit(8.0))),
        obj(stemmed.filter(size % 13 != 0), part("s"), "stem", None, ends=(y - 21 + (size % 5) * 10, y + 14)),
        obj(flagged, part("f"), "flag", flag),
        obj(slurred, part("t"), "slur", None, tie=size % 6 != 4),
        obj(dotted, part("d"), "augmentation-dot", "DOT"), obj(twice, part("e"), "augmentation-dot", "DOT")]), "objects")
    relations = write_table(every([
        rel(headed, F.col("chord_id"), part("m"), "containment"), rel(headed.filter(two), F.col("chord_id"), part("n"), "containment", 1),
        rel(chords.filter(rest), F.col("chord_id"), part("m"), "containment"),
        rel(stemmed, F.col("chord_id"), part("s"), "chord-stem"), rel(stemmed.filter(size % 17 == 0), F.col("chord_id"), part("u"), "chord-stem", 1),
        rel(beamed, part("b"), part("s"), "beam-stem"), rel(beamed.filter(size % 3 == 2), part("c"), part("s"), "beam-stem"), rel(beamed.filter(size % 19 == 0), part("b"), part("s"), "beam-stem", 1),
        rel(flagged, part("f"), part("s"), "flag-stem"),
        rel(slurred, part("t"), part("m"), "slur-head", side=side), rel(slurred.filter(two & (size % 6 == 3)), part("t"), part("n"), "slur-head", 1, side),
        rel(dotted, part("d"), part("m"), "augmentation"), rel(twice, part("m"), part("e"), "augmentation")]), "relations")
    # A stack for every day up to the user's last one, so that stacks and measures agree.
    days = calendar(events).select("score_id", week_of(F.col("measure_index")).alias("page_index"), F.lit(0).alias("system_index"), F.pmod("measure_index", F.lit(7)).cast("int").alias("stack_ord"))
    stacks = days.withColumns({"stack_id": F.col("stack_ord").cast("string"), "left": F.lit(0), "right": F.lit(1440 // PIXEL_MINUTES)})
    listed_slots = [(k, str(k), SLOT_TEXTS.get(k, f"{k}/24")) for k in range(24)] + list(MORE_SLOTS)
    slot = F.explode(F.array(*[F.struct(F.lit(o).alias("slot_ord"), F.lit(i).alias("slot_id"), F.lit(t).alias("time_offset")) for o, i, t in listed_slots]))
    slots = days.withColumn("_s", slot).select(*days.columns, "_s.*", (F.col("_s.slot_ord") * (60 // PIXEL_MINUTES)).alias("x_offset"), F.lit(False).alias("suspicious"))
    at = [*key, "stack_ord", F.lit(0).alias("part_ord")]
    listed = chords.select(*at, F.col("minute").alias("chord_ord"), F.when(rest, "rest").otherwise("head").alias("kind"), "chord_id")
    hour = int_div(F.col("minute"), 60)
    status = F.when(kind == "error", "begin").when(kind.isin("view", "purchase"), "BEGIN").otherwise("CONTINUE")
    entries = chords.select(*at, F.col("minute").alias("entry_ord"), hour.cast("string").alias("slot_id"), "chord_id", status.alias("status")).unionByName(
        chords.filter(two & (size % 10 == 1)).select(*at, (F.col("minute") + 1440).alias("entry_ord"), (hour - 1).cast("string").alias("slot_id"), "chord_id", F.lit("BEGIN").alias("status")))
    return {"objects": objects, "relations": relations, "stacks": stacks, "slots": slots, "chords": listed, "entries": entries}


GRAPH_TPQ = 6


def graph_measures(events: DataFrame) -> DataFrame:
    """Days as measures of 4/4, 6/4 and 6/8 by week, numbered like the graph's stacks."""
    order = Window.partitionBy("score_id").orderBy("day")
    turn = F.pmod(week_of(F.col("day")), F.lit(3))
    days = calendar(events).withColumnRenamed("measure_index", "day").withColumns({
        "num": F.when(turn == 0, 4).otherwise(6), "den": F.when(turn == 2, 8).otherwise(4), "tpq": F.lit(GRAPH_TPQ).cast(LONG), "pickup_shift": F.lit(0).cast(LONG)})
    sized = days.withColumn("full", int_div(F.col("num") * 4 * GRAPH_TPQ, F.col("den")).cast(LONG))
    return sized.withColumns({
        "measure_index": (F.row_number().over(order) - 1).cast("int"), "measure_number": F.row_number().over(order).cast("string"), "actual": F.col("full"),
        "start": F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(LONG)})


def graph_symbolic(events: DataFrame, measures: DataFrame) -> DataFrame:
    """Hits read from the events themselves, on the measures' ticks."""
    sec = seconds_since_epoch()
    timed = events.select(F.col("user_id").alias("score_id"), day_of(sec).alias("day"), F.pmod(sec, F.lit(86400)).alias("_sec"), "event_type")
    placed = sorted_join(timed, measures.select("score_id", "day", "measure_index", "start", "full"), ["score_id", "day"])
    at = int_div(F.col("_sec") * F.col("full"), 86400).cast(LONG)
    merged = placed.withColumn("offset", at).groupBy("score_id", "measure_index", "offset").agg(
        F.first("start").alias("_start"), F.count(F.lit(1)).alias("source_count"), F.array_sort(F.collect_set("event_type")).alias("pitches"))
    return merged.withColumn("onset", F.col("_start") + F.col("offset")).drop("_start")


def _columns(events: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    return C.recover_columns(graph["objects"], graph["relations"], graph["stacks"], graph["slots"], graph["chords"], graph["entries"], graph_measures(events).drop("day"))


def canonical_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column recovery of every user's notation graph: lattice, anchors, filled onsets, timing sources, and the chords of each column with length, dots, stem and ties."""
    events = read_events(spark, sf_dir)
    out = _columns(events, notation_graph(events))
    flag = lambda c: c.cast("int").cast("string")
    chord = lambda e: F.concat_ws(":", e["chord_id"], e["duration_ticks"].cast("string"), e["dot_count"].cast("string"), e["direction"], flag(e["attack"]), flag(e["tie_continuation"]))
    shown = out.withColumn("confidence_milli", F.rint(F.col("confidence") * 1000))
    return shown.select(
        *longs("score_id", "measure_index", "page_index", "column_index", "tpq", "onset", "duration", "grid_index", "units", "exact_support", "confidence_milli"), "x_abs", "y_abs", "timing_source",
        *[F.col(c).cast("int").cast(LONG).alias(c) for c in ("attack", "rest", "tie_continuation_only")], as_text(F.transform("notation_events", chord)).alias("chords"))


def recovery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per measure with columns: lattice, anchors and columns by timing source."""
    events = read_events(spark, sf_dir)
    graph = notation_graph(events)
    audit = C.measure_audit(_columns(events, graph), graph["stacks"])
    pairs = lambda c: as_text(F.transform(c, lambda a: F.concat_ws(":", a["column"].cast("string"), a["grid_index"].cast("string"))))
    return audit.select(
        *longs("score_id", "measure_index", "page_index", "stack_ord", "stack_left", "stack_right", "units", "physical_column_count", "attack_column_count", "semantic_anchor_count", "begin_columns",
               "chain_columns", "interpolated_columns"), "full_duration_quarter", "quantum_quarter", pairs("semantic_anchors").alias("semantic_anchors"), pairs("timing_anchors").alias("timing_anchors"),
        F.rint(F.col("px_per_unit") * 1000).cast(LONG).alias("px_per_unit_milli"))


def _canonical(spark: SparkSession, sf_dir: str) -> scores.CanonicalScores:
    events = read_events(spark, sf_dir)
    measures = freeze(graph_measures(events))
    return scores.canonical_scores(notation_graph(events), measures.drop("day"), graph_symbolic(events, measures))


def canonical_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the recovered columns, with the details of the events' own hits where both fall on one tick."""
    hits = _canonical(spark, sf_dir).hits
    return hits.select(*longs("score_id", "measure_index", "offset", "onset", "duration", "tpq", "source_count"), as_text("pitches").alias("pitches"))


def canonical_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: columns by flag, exact head geometry, augmentation dots and hits."""
    stats = _canonical(spark, sf_dir).stats.na.fill(0)
    return stats.select(*longs("score_id", "column_count", "attack_column_count", "tie_continuation_column_count", "rest_column_count", "exact_attack_geometry_column_count",
                               "augmentation_dot_count", "canonical_hit_count"))


def page_symbols(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(noteheads, pages, expected systems): a week is a page, a day a system, minutes run across; equal boxes are one."""
    kind, sec = F.col("event_type"), seconds_since_epoch()
    day = day_of(sec)
    page = int_div(day, 7).cast("int")
    boxes = write_table(events.select(F.col("user_id").alias("score_id"), page.alias("page_index"), F.concat(F.lit("notehead_"), kind).alias("shape"), (int_div(F.pmod(sec, F.lit(86400)), 60) * 2).cast("double").alias("x"),
                          ((day % 7) * 300 + F.length(kind) * 12).cast("double").alias("y")).distinct().withColumns({
        "w": F.lit(12.0), "h": F.lit(10.0), "interline": F.lit(10.0), "symbol_id": F.concat_ws(".", "x", "y")}), "boxes")
    pages = boxes.select("score_id", "page_index").distinct().withColumns({"width": F.lit(2880.0), "height": F.lit(2200.0), "annotation_width": F.lit(2880.0), "annotation_height": F.lit(2200.0)})
    expected = events.select(F.col("user_id").alias("score_id"), page.alias("page_index"), day.alias("d")).distinct().groupBy("score_id", "page_index").agg(F.count(F.lit(1)).cast("int").alias("expected_systems"))
    return boxes, pages, expected


def physical_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attack columns and their systems on every page."""
    groups = layout.physical_groups(*page_symbols(read_events(spark, sf_dir)))
    return groups.select(*longs("score_id", "page_index", "system_index", "group_index", "heads", "system_top", "system_bottom", "system_left", "system_right"))


def system_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and guard lines of every system, in image pixels times 2."""
    boxes, pages, expected = page_symbols(read_events(spark, sf_dir))
    bounds = layout.system_bounds(layout.physical_groups(boxes, pages, expected), pages)
    return bounds.select(*longs("score_id", "page_index", "system_index"), *[F.rint(F.col(f"{c}_norm") * 4400).cast(LONG).alias(c) for c in ("top", "bottom", "guard_bottom")])

"""From document-ordered score elements to attacks: cursor, chords, divisions, meters, pickups, layout, ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.meter import normalized_meter, parse_meter
from pulsegrid.functions.notation import clamp_unit, pitch_text, tie_flag, tuplet_ratio
from pulsegrid.functions.rational import int_div, lcm_of
from pulsegrid.operators.scan import Scan, carried_scan
from pulsegrid.operators.segments import measure_scan

MEASURE_KEYS = ("score_id", "part_ord", "measure_index")

# Layout used where a score states none.
LAYOUT_DEFAULTS = {
    "page_width": 1190.0, "page_height": 1684.0, "left_margin": 80.0, "right_margin": 80.0, "top_margin": 80.0, "bottom_margin": 80.0,
    "system_left": 0.0, "top_system_distance": 100.0, "system_distance": 220.0, "staff_distance": 80.0,
}
DEFAULT_MEASURE_WIDTH = 100.0
MAX_TPQ = 1 << 40


# -- cursor ---------------------------------------------------------------------------------------------------------------------


def cursor(elements: DataFrame, scan: Scan) -> DataFrame:
    """Add ``cursor`` (time before the element), ``onset_local`` (chord notes reuse the last onset) and ``reach``.

    Needs tag, dur (ticks), is_chord, is_grace.  ``reach`` is the running maximum of the cursor after notes and forwards; its
    maximum over the measure is the measure's actual duration.
    """
    note, forward, backup = F.col("tag") == "note", F.col("tag") == "forward", F.col("tag") == "backup"
    chord, grace = F.coalesce("is_chord", F.lit(False)), F.coalesce("is_grace", F.lit(False))
    moves = note & ~chord & ~grace
    delta = F.when(moves | forward, F.col("dur")).when(backup, -F.col("dur")).otherwise(F.lit(0))
    timed = scan.running(elements.withColumn("_delta", delta.cast("bigint")), exclusive=True, cursor=("sum", F.col("_delta")))
    opener = F.when(note & ~chord, F.col("cursor"))
    after = F.when(moves | forward, F.col("cursor") + F.col("_delta"))
    timed = scan.running(timed, _onset=("last", opener), reach=("max", after))
    return timed.withColumns({
        "onset_local": F.when(note, F.coalesce(F.col("_onset"), F.lit(0).cast("bigint"))),
        "reach": F.greatest(F.coalesce("reach", F.lit(0)), F.lit(0)).cast("bigint"),
    }).drop("_delta", "_onset")


def actual_durations(timed: DataFrame) -> DataFrame:
    return timed.groupBy(*MEASURE_KEYS).agg(F.max("reach").alias("actual"))


# -- measures -------------------------------------------------------------------------------------------------------------------


def with_divisions(raw_measures: DataFrame) -> DataFrame:
    """Divisions carried forward inside each part (1 until stated)."""
    scan = carried_scan(raw_measures, ["score_id", "part_ord"], ["measure_index"])
    filled = scan.running(raw_measures, _div=("last", F.col("divisions")))
    return filled.withColumn("divisions", F.coalesce("_div", F.lit(1))).drop("_div")


def tick_base(part_measures: DataFrame) -> DataFrame:
    """Ticks per quarter of each score: lcm of all divisions and meter denominators; null where it leaves no room for exact times."""
    each = part_measures.select("score_id", F.explode(F.array(F.col("divisions").cast("bigint"), F.coalesce("beat_type", F.lit(4)).cast("bigint"))).alias("v"))
    distinct = each.filter("v > 0").distinct()
    bases = distinct.groupBy("score_id").agg(F.collect_list("v").alias("_v")).select("score_id", lcm_of(F.array_append("_v", F.lit(4).cast("bigint"))).alias("_base"))
    return bases.select("score_id", F.when(F.col("_base") < MAX_TPQ, F.col("_base")).alias("tpq"))


def measure_templates(part_measures: DataFrame, actual: DataFrame, tpq: DataFrame, override: str | None = None) -> DataFrame:
    """Measures of the first part: meter carried forward, start, actual duration, pickup shift, opening anacrusis."""
    first = part_measures.filter("part_ord = 0")
    scan = measure_scan(part_measures)
    chunk = [scan.chunk] if scan.chunk else []
    stated = F.col("beats").isNotNull() | F.col("beat_type").isNotNull() | (F.coalesce("time_symbol", F.lit("")) != "")
    complete = F.col("beats").isNotNull() & F.col("beat_type").isNotNull()
    num, den = F.when(complete, F.col("beats")), F.when(complete, F.col("beat_type"))
    printed = normalized_meter(F.col("time_symbol"), num, den)
    parsed = parse_meter(F.lit(override)) if override else F.lit(None).cast("struct<num:int,den:int>")
    chosen = F.when(parsed.isNotNull() & (F.col("measure_index") == 0), parsed).when(stated & printed["num"].isNotNull(), printed)
    meters = scan.running(first.withColumn("_meter", chosen), _now=("last", F.col("_meter")))
    initial = F.coalesce(parsed, F.struct(F.lit(4).alias("num"), F.lit(4).alias("den")))
    with_meter = meters.withColumn("_now", F.coalesce("_now", initial)).join(tpq, "score_id")
    sized = with_meter.join(actual.filter("part_ord = 0").drop("part_ord"), ["score_id", "measure_index"], "left").select(
        "score_id", "measure_index", *chunk,
        F.coalesce("number", (F.col("measure_index") + 1).cast("string")).alias("measure_number"),
        F.col("_now.num").cast("int").alias("num"), F.col("_now.den").cast("int").alias("den"), "tpq",
        int_div(F.col("_now.num") * 4 * F.col("tpq"), F.col("_now.den")).cast("bigint").alias("full"),
        F.coalesce("actual", F.lit(0)).cast("bigint").alias("actual"),
        F.coalesce("implicit", F.lit(False)).alias("implicit"),
        F.lower(F.trim(F.coalesce("right_bar_style", F.lit("")))).alias("_bar"), F.coalesce("right_bar_repeat", F.lit(False)).alias("_repeat"),
        printed.alias("_printed"), (stated & complete).alias("_complete"), num.alias("_num"), den.alias("_den"), F.lit(override is not None).alias("_forced"),
    )
    opening = F.col("measure_index") == 0
    shifted = sized.withColumn(
        "pickup_shift", F.when((F.col("implicit") | opening) & (F.col("actual") < F.col("full")), F.col("full") - F.col("actual")).otherwise(F.lit(0)).cast("bigint")
    ).withColumn(
        "opening_anacrusis", opening & (F.col("pickup_shift") == 0) & (F.col("_bar") == "heavy-light") & ~F.col("_repeat")
    )
    return scan.running(shifted, exclusive=True, start=("sum", F.col("full"))).drop("_bar", "_repeat")


def meter_warnings(templates: DataFrame, override: str | None = None) -> DataFrame:
    """Symbol normalisations and an override that replaced a different printed meter."""
    differs = (F.col("_printed.num") != F.col("_num")) | (F.col("_printed.den") != F.col("_den"))
    forced = parse_meter(F.lit(override)) if override else F.lit(None).cast("struct<num:int,den:int>")
    replaced = (F.col("measure_index") == 0) & F.col("_printed.num").isNotNull() & (
        (F.col("_printed.num") != forced["num"]) | (F.col("_printed.den") != forced["den"]))
    code = F.when(F.coalesce(replaced, F.lit(False)), "meter-override").when(F.col("_complete") & differs, "meter-symbol-normalised")
    return templates.withColumn("code", code).filter("code IS NOT NULL").select(
        "score_id", F.lit("timeline").alias("stage"), "code", "measure_index",
        F.create_map(F.lit("printed"), F.concat_ws("/", "_num", "_den"), F.lit("used"), F.concat_ws("/", "num", "den")).alias("detail"),
    )


# -- layout ---------------------------------------------------------------------------------------------------------------------


def layout_config(layout: DataFrame) -> DataFrame:
    """Layout of each score with the fixed fallbacks."""
    return layout.select("score_id", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in LAYOUT_DEFAULTS.items()])


def layout_counters(rows: DataFrame, scan: Scan) -> DataFrame:
    """Page, system and offset counters in order.

    Needs new_page, new_system (booleans), width, and the distances in force: system_left, system_distance, top_system_distance.
    The page counts page breaks; the system counts system breaks since the page break; ``x_offset`` is the width since the last
    break; ``top_offset`` is the page's top distance plus the system distances since the page break.
    """
    page = F.coalesce("new_page", F.lit(False))
    system = F.coalesce("new_system", F.lit(False)) & ~page
    flagged = rows.withColumns({"_page": page.cast("int"), "_system": system.cast("int")})
    counted = scan.running(flagged, page_index=("sum", F.col("_page")), _systems=("sum", F.col("_system")),
                           _down=("sum", F.when(F.col("_system") == 1, F.col("system_distance")).otherwise(F.lit(0.0))))
    counted = scan.running(counted, exclusive=True, _across=("sum", F.col("width")))
    anchored = scan.running(
        counted,
        _page_at=("last", F.when(F.col("_page") == 1, F.struct("_systems", "_down", "top_system_distance"))),
        _break_at=("last", F.when((F.col("_page") + F.col("_system")) > 0, F.struct("_across", "system_left"))),
    )
    return anchored.withColumns({
        "page_index": F.col("page_index").cast("int"),
        "system_index": (F.col("_systems") - F.coalesce("_page_at._systems", F.lit(0))).cast("int"),
        "x_offset": F.col("_across") - F.coalesce("_break_at._across", F.lit(0)),
        "system_left": F.col("_break_at.system_left"),
        "top_distance": F.col("_page_at.top_system_distance"),
        "down": F.col("_down") - F.coalesce("_page_at._down", F.lit(0.0)),
    }).drop("_page", "_system", "_systems", "_down", "_across", "_page_at", "_break_at")


def measure_layouts(part_measures: DataFrame, config: DataFrame) -> DataFrame:
    """Page, system, x start and system top of each measure of the first part."""
    scan = measure_scan(part_measures)
    first = part_measures.filter("part_ord = 0").select(
        "score_id", "measure_index", *([scan.chunk] if scan.chunk else []), F.coalesce("width", F.lit(DEFAULT_MEASURE_WIDTH)).alias("width"), "new_page", "new_system",
        F.col("system_left").alias("_left"), F.col("system_distance").alias("_dist"), F.col("top_system_distance").alias("_top"),
    )
    joined = scan.running(first, _l=("last", F.col("_left")), _d=("last", F.col("_dist")), _t=("last", F.col("_top"))).join(config, "score_id")
    active = joined.withColumns({
        "_sl": F.coalesce("_l", "system_left"), "_sd": F.coalesce("_d", "system_distance"), "_st": F.coalesce("_t", "top_system_distance"),
        "_first_left": F.col("system_left"), "_first_top": F.col("top_system_distance"),
    }).withColumns({"system_left": F.col("_sl"), "system_distance": F.col("_sd"), "top_system_distance": F.col("_st")})
    counted = layout_counters(active, scan)
    return counted.select(
        "score_id", "measure_index", "page_index", "system_index", "width",
        (F.col("left_margin") + F.coalesce("system_left", "_first_left") + F.col("x_offset")).alias("x_start"),
        (F.col("top_margin") + F.coalesce("top_distance", "_first_top") + F.col("down")).alias("system_top"),
        "page_width", "page_height", "staff_distance",
    )


def staff_offsets(part_measures: DataFrame, config: DataFrame) -> DataFrame:
    """Vertical offset of each part: staves of the parts above, plus half a staff distance each."""
    staves = part_measures.groupBy("score_id", "part_ord").agg(F.greatest(F.lit(1), F.max(F.coalesce("staves", F.lit(1)))).alias("staves"))
    height = F.col("staves") * F.col("staff_distance") + F.col("staff_distance") * 0.5
    sized = staves.join(config.select("score_id", "staff_distance"), "score_id").withColumn("_height", height)
    return Scan(("score_id",), ("part_ord",)).running(sized, exclusive=True, part_offset=("sum", F.col("_height"))).select(
        "score_id", "part_ord", F.col("part_offset").cast("double").alias("part_offset"))


# -- notes ----------------------------------------------------------------------------------------------------------------------


def tick_elements(elements: DataFrame, part_measures: DataFrame, tpq: DataFrame) -> DataFrame:
    """Element durations in ticks, by the divisions in force in the element's part."""
    divisions = part_measures.select(*MEASURE_KEYS, "divisions").join(tpq, "score_id")
    ticks = F.when(F.col("divisions") > 0, int_div(F.coalesce("duration_div", F.lit(0)) * F.col("tpq"), F.col("divisions"))).otherwise(F.lit(0))
    return elements.join(divisions, list(MEASURE_KEYS)).withColumn("dur", ticks.cast("bigint"))


def sounding_notes(timed: DataFrame, templates: DataFrame, layouts: DataFrame, offsets: DataFrame) -> DataFrame:
    """Notes that are neither rests nor grace notes, with pitch, ties, tuplets, global onset and page coordinates."""
    notes = timed.filter("tag = 'note' AND NOT coalesce(is_rest, false) AND NOT coalesce(is_grace, false)")
    placed = (
        notes.drop("tpq").join(templates.select("score_id", "measure_index", "measure_number", "start", "pickup_shift", "tpq"), ["score_id", "measure_index"])
        .join(layouts.drop("width"), ["score_id", "measure_index"], "left")
        .join(offsets, ["score_id", "part_ord"], "left")
    )
    staff_no = F.greatest(F.lit(1), F.coalesce("staff", F.lit("1")).try_cast("int"))
    staff_bad = F.coalesce("staff", F.lit("1")).try_cast("int").isNull() & F.col("default_y").isNotNull()
    staff_top = F.col("system_top") + F.coalesce("part_offset", F.lit(0.0)) + (staff_no - 1) * F.col("staff_distance")
    ratio = tuplet_ratio(F.col("tuplet_actual"), F.col("tuplet_normal"))
    return placed.select(
        "score_id", "tpq",
        F.struct("part_ord", "measure_index", "doc_order").alias("doc_rank"),
        (F.col("start") + F.col("pickup_shift") + F.col("onset_local")).alias("onset"), F.col("dur").alias("duration"),
        "measure_index", "measure_number", (F.col("pickup_shift") + F.col("onset_local")).alias("offset"),
        F.coalesce("part_id", F.lit("P?")).alias("part_id"), F.coalesce("voice", F.lit("1")).alias("voice"), F.coalesce("staff", F.lit("1")).alias("staff"),
        pitch_text(F.col("step"), F.col("alter"), F.col("octave"), F.col("unpitched")).alias("pitch"),
        tie_flag(F.col("tie_types"), "start").alias("tie_start"), tie_flag(F.col("tie_types"), "stop").alias("tie_stop"),
        ratio["actual"].alias("tuplet_actual"), ratio["normal"].alias("tuplet_normal"),
        F.when(~staff_bad, F.col("page_index")).alias("page_index"),
        clamp_unit((F.col("x_start") + F.col("default_x")) / F.greatest(F.col("page_width"), F.lit(1.0))).alias("x_norm"),
        clamp_unit((staff_top - F.col("default_y")) / F.greatest(F.col("page_height"), F.lit(1.0))).alias("y_norm"),
    ).withColumn("part_ord", F.col("doc_rank.part_ord"))


def tie_chains(notes: DataFrame, scan: Scan) -> tuple[DataFrame, DataFrame]:
    """Fold tied continuations into the attack that opened them.

    Needs tie_start, tie_stop, duration.  An attack with a tie start opens an island; a stop inside the island is live until a stop
    that does not start again has closed it.  Live stops add their duration to the opener; other stops are returned as unmatched.
    """
    starts, stops = F.col("tie_start"), F.col("tie_stop")
    opens, closes = starts & ~stops, stops & ~starts
    counted = scan.running(notes, _island=("sum", opens.cast("bigint")))
    counted = scan.running(counted, exclusive=True, _closed=("sum", closes.cast("bigint")))
    based = scan.running(counted, _base=("last", F.when(opens, F.col("_closed"))))
    live = stops & (F.col("_island") > 0) & (F.col("_closed") == F.col("_base"))
    marked = based.withColumn("_live", F.coalesce(live, F.lit(False)))
    keys = list(scan.keys)
    rest = [c for c in notes.columns if c not in keys and c != "duration" and c != scan.chunk]
    # Island members fold by (key, island); attacks that open nothing are islands of their own rank.
    attack = ~stops
    folded = marked.filter(attack | F.col("_live")).withColumn("_own", F.when(attack & ~opens, F.struct(*scan.order)))
    merged = folded.groupBy(*keys, F.when(F.col("_own").isNull(), F.col("_island")).alias("_g"), "_own").agg(
        F.sum("duration").alias("duration"),
        F.max_by(F.struct(*rest), F.when(attack, F.lit(1))).alias("_opener"),
    )
    attacks = merged.select(*keys, "duration", "_opener.*")
    unmatched = marked.filter(stops & ~F.col("_live")).drop("_island", "_closed", "_base", "_live", *([scan.chunk] if scan.chunk else []))
    return attacks, unmatched


# -- visual columns -------------------------------------------------------------------------------------------------------------


def visual_groups(timed: DataFrame, templates: DataFrame, layouts: DataFrame) -> DataFrame:
    """Columns of noteheads in reading order: grace and tied notes included, one row per (measure, page, system, x or onset, kind).

    Pitches are kept as distinct pitch with count, in order of first appearance, so that a column is bounded by its pitch range.
    """
    notes = timed.filter("tag = 'note' AND NOT coalesce(is_rest, false)").drop("tpq", "width")
    placed = notes.join(templates.select("score_id", "measure_index", "measure_number", "start", "pickup_shift", "full", "tpq"), ["score_id", "measure_index"]).join(
        layouts, ["score_id", "measure_index"], "left")
    grace = F.coalesce("is_grace", F.lit(False))
    rows = placed.select(
        "score_id", "measure_index", "measure_number", "tpq",
        F.coalesce("page_index", F.lit(0)).alias("layout_page"), F.coalesce("system_index", F.lit(0)).alias("layout_system"),
        F.bround("default_x", 2).alias("layout_default_x"),
        F.when(grace, "grace").otherwise("main").alias("visual_kind"),
        (F.col("start") + F.col("pickup_shift") + F.col("onset_local")).alias("onset"),
        (F.col("pickup_shift") + F.col("onset_local")).alias("offset"), F.col("dur").alias("duration"),
        F.col("start").alias("measure_start"), F.col("full").alias("measure_full"), F.col("pickup_shift").alias("measure_shift"),
        "x_start", F.col("width").alias("measure_width"), "page_width", "page_height",
        F.struct("part_ord", "measure_index", "doc_order").alias("doc_rank"),
        pitch_text(F.col("step"), F.col("alter"), F.col("octave"), F.col("unpitched")).alias("pitch"),
        tuplet_ratio(F.col("tuplet_actual"), F.col("tuplet_normal")).alias("tuplet"),
        (~grace & ~tie_flag(F.col("tie_types"), "stop")).alias("_sounds"),
    )
    return group_visual(rows)


VISUAL_KEYS = ("score_id", "measure_index", "layout_page", "layout_system", "layout_default_x", "onset_key", "visual_kind")


def group_visual(rows: DataFrame) -> DataFrame:
    """Group placed notes into visual columns (needs the columns produced above)."""
    keyed = rows.withColumn("onset_key", F.when(F.col("layout_default_x").isNull(), F.col("onset")))
    first = [c for c in keyed.columns if c not in (*VISUAL_KEYS, "pitch", "tuplet", "_sounds", "doc_rank")]
    keys = [F.col(k) for k in VISUAL_KEYS]
    per_pitch = keyed.groupBy(*keys, "pitch").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_rank").alias("rank"), F.min_by(F.struct(*first), "doc_rank").alias("_first"),
        F.max_by("tuplet", F.when(F.col("tuplet").isNotNull(), F.col("doc_rank"))).alias("tuplet"),
        F.max(F.when(F.col("tuplet").isNotNull(), F.col("doc_rank"))).alias("_tuplet_rank"),
        F.bool_or("_sounds").alias("_sounds"),
    )
    grouped = per_pitch.groupBy(*keys).agg(
        F.min_by("_first", "rank").alias("_first"), F.min("rank").alias("serial_rank"), F.sum("n").alias("notes"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "pitch", "n"))), lambda p: F.struct(p["pitch"].alias("pitch"), p["n"].alias("n"))).alias("pitches"),
        F.bool_or("_sounds").alias("analyzed"), F.max_by("tuplet", "_tuplet_rank").alias("tuplet"),
    )
    return grouped.select(
        *[k for k in VISUAL_KEYS if k != "onset_key"], "_first.*",
        (F.col("_first.x_start") + F.col("layout_default_x")).alias("layout_x_abs"),
        "notes", "pitches", "analyzed", F.col("tuplet.actual").alias("tuplet_actual"), F.col("tuplet.normal").alias("tuplet_normal"), "serial_rank",
    )


def expected_systems(groups: DataFrame) -> DataFrame:
    """Systems per page among the visual columns."""
    return groups.select("score_id", F.col("layout_page").alias("page_index"), "layout_system").distinct().groupBy("score_id", "page_index").agg(
        F.count(F.lit(1)).alias("expected_systems"))

"""Jobs on score corpora: files to attacks, hits, Levels, profiles, registrations and page overlays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pulsegrid.operators import columns as C
from pulsegrid.operators import layout, pages, profiles, quality, reconcile, register, timeline
from pulsegrid.operators.hits import merge_hits
from pulsegrid.operators.levels import refine
from pulsegrid.operators.scan import CHUNK, Scan, chunked, hot_row_limit, largest_key
from pulsegrid.operators.segments import meter_segments, segment_hits
from pulsegrid.session import freeze


@dataclass
class ParsedScores:
    attacks: DataFrame
    hits: DataFrame
    measures: DataFrame
    part_measures: DataFrame
    timed: DataFrame
    layouts: DataFrame
    quality: DataFrame


def parse_scores(elements: DataFrame, raw_measures: DataFrame, layout_table: DataFrame, meter_override: str | None = None) -> ParsedScores:
    """Attacks, merged hits and measures of every score, with the warnings on the way."""
    hot = largest_key(elements, "score_id") > hot_row_limit(elements)

    def scan(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, Scan]:
        # Keys finer than a score cannot be hot unless a score is.
        return chunked(df, keys, order, hot_row_limit(df)) if hot else (df, Scan(tuple(keys), tuple(order)))

    if largest_key(raw_measures, "score_id") > hot_row_limit(raw_measures):
        raw_measures, _ = chunked(raw_measures, ["score_id", "part_ord"], ["measure_index"], hot_row_limit(raw_measures))
    part_measures = timeline.with_divisions(raw_measures)
    bases = timeline.tick_base(part_measures)
    tpq, without = bases.filter("tpq IS NOT NULL"), bases.filter("tpq IS NULL").select("score_id")
    part_measures = part_measures.join(tpq.select("score_id"), "score_id", "left_semi")
    ticked, by_measure = scan(timeline.tick_elements(elements, part_measures, tpq), list(timeline.MEASURE_KEYS), ["doc_order"])
    timed = timeline.cursor(ticked, by_measure).drop(CHUNK)
    templates = timeline.measure_templates(part_measures, timeline.actual_durations(timed), tpq, meter_override)
    config = timeline.layout_config(layout_table)
    layouts = timeline.measure_layouts(part_measures, config)
    notes = timeline.sounding_notes(timed, templates, layouts, timeline.staff_offsets(part_measures, config))
    notes, by_pitch = scan(notes, ["score_id", "part_ord", "staff", "voice", "pitch"], ["doc_rank"])
    attacks, unmatched = timeline.tie_chains(notes, by_pitch)
    hits = merge_hits(attacks)
    measures = templates.drop("_printed", "_complete", "_num", "_den", "_forced")
    placed = notes.filter("x_norm IS NOT NULL AND y_norm IS NOT NULL").select("score_id").distinct()
    no_layout = tpq.select("score_id").join(placed, "score_id", "left_anti")
    report = quality.union_reports(
        timeline.meter_warnings(templates, meter_override), quality.part_length_mismatches(part_measures), quality.unmatched_ties(unmatched),
        quality.note_rows("timeline", "no-note-coordinates", no_layout), quality.note_rows("timeline", "tick-base-too-large", without),
    )
    return ParsedScores(attacks, hits, measures, part_measures, timed, layouts, report)


def visual_groups(parsed: ParsedScores) -> DataFrame:
    """Notehead columns in reading order; ``layout_known`` says whether the score states any layout."""
    groups = timeline.visual_groups(parsed.timed, parsed.measures, parsed.layouts)
    first = parsed.part_measures.filter("part_ord = 0")
    known = first.groupBy("score_id").agg(F.bool_or(F.col("width").isNotNull() | F.col("has_print")).alias("layout_known"))
    return groups.join(known, "score_id", "left")


def analyze_levels(hits: DataFrame, measures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with Levels, meter segments) of every score."""
    segments = meter_segments(measures)
    bases = measures.groupBy("score_id").agg(F.max("tpq").alias("tpq"))
    placed = segment_hits(hits.drop("tpq"), segments)
    return refine(placed).join(bases, "score_id"), segments


def analysis_quality(events: DataFrame, segments: DataFrame) -> DataFrame:
    return quality.union_reports(quality.fallback_meters(segments), quality.refinement_notes(events), quality.unreachable_attacks(events))


@dataclass
class Profiles:
    wave: DataFrame
    pivots: DataFrame
    nodes: DataFrame
    branches: DataFrame


def profile(events: DataFrame, probe: DataFrame | None = None) -> Profiles:
    """Wave, turning points and tree of every segment."""
    wave, scan = profiles.profile_scan(profiles.wave_profile(events), probe)
    rooted = profiles.tree(wave, scan)
    return Profiles(wave, profiles.pivots(wave, scan), rooted, profiles.branches(rooted, scan))


@dataclass
class CanonicalScores:
    measures: DataFrame
    columns: DataFrame
    hits: DataFrame
    stats: DataFrame
    quality: DataFrame


def canonical_scores(project: dict[str, DataFrame], measures: DataFrame, symbolic: DataFrame) -> CanonicalScores:
    """Measures in stack order, recovered columns and the hits they give; refused scores only appear in the report."""
    stacks = project["stacks"]
    framework, verdicts = reconcile.framework_gaps(measures, C.stack_counts(stacks))
    moved, unknown = reconcile.remap_hits(symbolic, framework)
    refused = unknown.join(framework.select("score_id").distinct(), "score_id", "left_semi").select("score_id").distinct()
    framework = freeze(framework.join(refused, "score_id", "left_anti"))
    columns = freeze(C.recover_columns(project["objects"], project["relations"], stacks, project["slots"], project["chords"], project["entries"], framework))
    hits = C.canonical_hits(columns, framework, moved)
    stats = C.column_stats(columns).join(C.augmentation_dots(project["objects"], project["relations"]), "score_id", "left").join(
        hits.groupBy("score_id").agg(F.count(F.lit(1)).alias("canonical_hit_count")), "score_id", "left")
    kept = framework.select("score_id").distinct()
    empty = kept.join(hits.select("score_id").distinct(), "score_id", "left_anti")
    bare = kept.join(columns.select("score_id").distinct(), "score_id", "left_anti")
    report = quality.union_reports(
        reconcile.framework_warnings(verdicts), quality.note_rows("framework", reconcile.UNKNOWN_MEASURE, refused), quality.note_rows("columns", "no-usable-attacks", empty),
        quality.note_rows("columns", "no-recovered-columns", bare), quality.note_rows("columns", "begin-time-unreadable", C.unreadable_times(project["slots"]), None, time="time_offset"))
    return CanonicalScores(rescaled(framework, columns), columns, hits, stats, report)


def rescaled(measures: DataFrame, columns: DataFrame) -> DataFrame:
    """Measures on the tick base of the recovered columns; scores without columns keep their own base."""
    bases = columns.groupBy("score_id").agg(F.max("tpq").alias("_base"))
    joined = measures.join(bases, "score_id", "left").withColumn("_new", F.coalesce("_base", "tpq")).drop("_base")
    up = F.call_function("div", F.col("_new"), F.col("tpq"))
    return joined.withColumns({**{c: F.col(c) * up for c in ("start", "full", "actual", "pickup_shift")}, "tpq": F.col("_new")}).drop("_new")


@dataclass
class Overlay:
    anchors: DataFrame
    wave: DataFrame
    pivots: DataFrame
    nodes: DataFrame
    branches: DataFrame
    bounds: DataFrame
    stats: DataFrame


def overlay(events: DataFrame, derived: Profiles, canonical: CanonicalScores, annotations: dict[str, DataFrame], expected: DataFrame,
            sizes: DataFrame, projection: DataFrame | None = None) -> Overlay:
    """Everything placed on pages: attacks, then wave, pivots, tree and branches at the attacks' positions, and the systems' bounds.

    ``sizes`` gives score_id, page_index, width, height of the page images; ``projection`` the optional row darkness per page.
    """
    sheets = annotations["pages"].join(sizes, ["score_id", "page_index"])
    shift = canonical.measures.select("score_id", "measure_index", "pickup_shift")
    keyed = canonical.columns.join(shift, ["score_id", "measure_index"]).withColumn("offset", F.col("pickup_shift") + F.col("onset")).drop("onset", "pickup_shift")
    anchors = register.register_anchors(events, keyed, sizes)
    wave = register.register_wave(derived.wave, anchors)
    found = register.register_pivots(derived.pivots, wave)
    nodes = register.register_nodes(profiles.tree_nodes(derived.nodes).drop("parent"), wave)
    branches = register.register_branches(derived.branches, nodes)
    bands = layout.frame_bands(layout.staff_frames(projection), sheets, expected) if projection is not None else None
    groups = layout.physical_groups(annotations["symbols"], sheets, expected, bands)
    stats = register.register_stats(anchors)
    return Overlay(anchors, wave, found, nodes, branches, layout.system_bounds(groups, sheets), stats)


def page_documents(placed: Overlay, size: int = pages.DOCUMENT_PIECES) -> DataFrame:
    """Every page's pieces in order (bounds, attacks, wave, pivots, nodes, branches), as documents of at most ``size`` pieces."""
    return pages.page_documents(pages.page_pieces({
        "bounds": placed.bounds, "layer": placed.anchors, "wave": placed.wave, "pivot": placed.pivots, "node": placed.nodes, "branch": placed.branches}), size)


def page_assembly(placed: Overlay) -> DataFrame:
    """How many pieces of each kind every page carries."""
    count = lambda df, kind: df.filter("page_index IS NOT NULL AND reason IS NULL").groupBy("score_id", "page_index").agg(F.count(F.lit(1)).alias(kind))
    kinds = {"layer_anchors": placed.anchors, "wave_anchors": placed.wave, "pivot_anchors": placed.pivots, "tree_nodes": placed.nodes, "tree_branches": placed.branches}
    out = placed.bounds.groupBy("score_id", "page_index").agg(F.count(F.lit(1)).alias("system_bounds"))
    for kind, df in kinds.items():
        out = out.join(count(df, kind), ["score_id", "page_index"], "full")
    return out.na.fill(0)

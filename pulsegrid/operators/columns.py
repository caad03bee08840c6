"""Recovered notation columns: graph objects and relations to timed columns of a measure's lattice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.notation import chord_quarters, flag_count, head_kind, rest_quarters
from pulsegrid.functions.rational import int_div, lcm_of, parse_rational, rational_text
from pulsegrid.operators.anchors import anchor_chain, monotone_fill
from pulsegrid.operators.clusters import gap_clusters, medoids
from pulsegrid.operators.graph import typed_edges
from pulsegrid.operators.joins import sorted_join
from pulsegrid.operators.quantum import gcd_by, quantum_columns
from pulsegrid.operators.scan import Scan, sized_scan
from pulsegrid.operators.timeline import MAX_TPQ
from pulsegrid.session import freeze, write_table

SYSTEM = ["score_id", "page_index", "system_index"]
STACK = [*SYSTEM, "stack_ord"]
MEASURE = ["score_id", "measure_index"]

# Fixed value: horizontal step (pixels) that separates two columns.
COLUMN_TOLERANCE = 12.0

# Timing sources and their confidence.
BEGIN_ANCHOR, BEGIN_CONFIDENCE, SUPPORT_BONUS = "semantic-begin-anchor", 0.90, 0.02
CHAIN_ANCHOR, CHAIN_CONFIDENCE = "semantic-monotonic-anchor", 0.90
INTERPOLATED, INTERPOLATED_CONFIDENCE = "canonical-grid-interpolation", 0.72

_RATIO = "struct<num:bigint,den:bigint>"


def stack_measures(stacks: DataFrame) -> DataFrame:
    """Stacks numbered through the score in page, system, stack order: the measure they stand for."""
    rows, scan = sized_scan(stacks.select(*STACK), ["score_id"], STACK[1:])
    return scan.number(rows, "measure_index").select(*STACK, F.col("measure_index").cast("int").alias("measure_index"))


def stack_counts(stacks: DataFrame) -> DataFrame:
    return stacks.groupBy("score_id").agg(F.count(F.lit(1)).cast("int").alias("stacks"))


def begin_times(slots: DataFrame, entries: DataFrame) -> DataFrame:
    """Times (in quarters) at which a chord is said to begin, in reading order; later slots of the same id win.

    Only the slots that entries name are parsed.
    """
    begins = entries.filter("upper(status) = 'BEGIN' AND chord_id IS NOT NULL").select(*STACK, "slot_id", "chord_id", "part_ord", "entry_ord")
    named = sorted_join(begins, slots.select(*STACK, "slot_id", "slot_ord", "time_offset"), [*STACK, "slot_id"])
    # Malformed times drop out after the aggregate: a filter on the parsed time would be pushed to all slots and parse them twice.
    timed = named.withColumn("_t", parse_rational(F.col("time_offset")))
    last = F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("slot_ord"))).alias("_t")
    return timed.groupBy(*STACK, "chord_id", F.struct("part_ord", "entry_ord").alias("seen")).agg(last).filter("_t IS NOT NULL").select(
        *STACK, "chord_id", "seen", (F.col("_t.num") * 4).alias("num"), F.col("_t.den").alias("den"))


def unreadable_times(slots: DataFrame) -> DataFrame:
    """Stated slot times that are no exact rational: score_id, time_offset."""
    stated = slots.filter("trim(coalesce(time_offset, '')) <> ''")
    return stated.withColumn("_t", parse_rational(F.col("time_offset"))).filter("_t IS NULL").select("score_id", "time_offset")


def measure_chords(chords: DataFrame) -> DataFrame:
    """Chord ids of each stack, each once per kind, at its first place."""
    return chords.groupBy(*STACK, "kind", "chord_id").agg(F.min(F.struct("part_ord", "chord_ord")).alias("place"))


# What recovery takes from the relations of a graph.
_RELATIONS = ("containment", "augmentation", "slur-head", "chord-stem", "beam-stem", "flag-stem")


def related(objects: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that recovery reads, each with the facts of both ends; an end that names no object is not ``known``."""
    facts = {"source": ("tag", "shape", "tie"), "target": ("tag", "shape", "x", "y", "w", "h", "p1y", "p2y")}
    out = relations.filter(F.col("type").isin(*_RELATIONS)).select(*SYSTEM, "type", "side", "rel_ord", "source", "target")
    for end, names in facts.items():
        known = objects.select(*SYSTEM, F.col("obj_id").alias(end), F.lit(True).alias(f"{end}_known"), *[F.col(c).alias(f"{end}_{c}") for c in names])
        out = sorted_join(out, known, [*SYSTEM, end], "left")
    return out


def _joins(kind: str, source: str | None = None, target: str | None = None) -> Column:
    """Relation of a type whose ends are objects with the given tags."""
    found = F.col("type") == kind
    for end, tag in (("source", source), ("target", target)):
        found = found & ((F.col(f"{end}_tag") == tag) if tag else F.col(f"{end}_known"))
    return F.coalesce(found, F.lit(False))


def head_facts(edges: DataFrame) -> DataFrame:
    """Per head of a chord: centre, shape, dots, whether a tie ends on it. One window over the relations that touch a head."""
    dotted = F.when(F.col("source_tag") == "head", F.col("source")).when(F.col("target_tag") == "head", F.col("target"))
    tie = _joins("slur-head", "slur") & F.coalesce((F.upper("side") == "RIGHT") & F.col("source_tie"), F.lit(False))
    role = F.when(_joins("containment", "head-chord", "head"), "member").when(_joins("augmentation"), "dot").when(tie, "tie")
    touching = edges.withColumns({"_role": role, "_head": F.when(role == "dot", dotted).otherwise(F.col("target"))}).filter("_role IS NOT NULL AND _head IS NOT NULL")
    head = Window.partitionBy(*SYSTEM, "_head")
    counted = touching.withColumns({"dots": F.count_if(F.col("_role") == "dot").over(head), "tied": F.bool_or(F.col("_role") == "tie").over(head)})
    return counted.filter("_role = 'member'").select(
        *SYSTEM, F.col("source").alias("chord_id"), F.col("target_shape").alias("shape"), (F.col("target_x") + F.col("target_w") / 2).alias("cx"),
        (F.col("target_y") + F.col("target_h") / 2).alias("cy"), "dots", "tied")


def chord_facts(edges: DataFrame) -> DataFrame:
    """Per chord: the ends of its stem (the last one stated), beams and flags on that stem; for a rest chord its first rest shape."""
    kind = F.col("type")
    is_stem = F.coalesce(F.col("target_tag") == "stem", F.lit(False))
    stem = F.struct(F.col("target").alias("stem_id"), F.when(is_stem, F.col("target_p1y")).alias("p1y"), F.when(is_stem, F.col("target_p2y")).alias("p2y"))
    rest = _joins("containment", "rest-chord", "rest")
    stated = edges.filter((kind == "chord-stem") | rest).groupBy(*SYSTEM, F.col("source").alias("chord_id")).agg(
        F.max_by(stem, F.when(kind == "chord-stem", F.struct("rel_ord", is_stem.alias("stem")))).alias("_stem"),
        F.min_by("target_shape", F.when(rest, F.col("rel_ord"))).alias("rest_shape")).select(*SYSTEM, "chord_id", "rest_shape", "_stem.*")
    borne = edges.filter(kind.isin("beam-stem", "flag-stem")).groupBy(*SYSTEM, F.col("target").alias("stem_id")).agg(
        F.count_distinct(F.when(kind == "beam-stem", F.col("source"))).alias("beams"), F.max(F.when(kind == "flag-stem", flag_count(F.col("source_shape")))).alias("flags"))
    return sorted_join(stated, borne, [*SYSTEM, "stem_id"], "left").drop("stem_id")


def stem_direction(centre_y: Column) -> Column:
    """up, down or none: the stem end farther from the head decides."""
    distal = F.when(F.abs(F.col("p1y") - centre_y) >= F.abs(F.col("p2y") - centre_y), F.col("p1y")).otherwise(F.col("p2y"))
    return F.when(distal.isNull(), "none").when(distal < centre_y, "up").otherwise("down")


def notation_events(objects: DataFrame, relations: DataFrame, chords: DataFrame, stacks: DataFrame, measures: DataFrame) -> DataFrame:
    """Head and rest chords of every measure with geometry, exact length and attack flags."""
    numbered = sorted_join(measure_chords(chords), stack_measures(stacks).select(*STACK, "measure_index"), STACK)
    placed = sorted_join(numbered, measures.select("score_id", "measure_index", "full", F.col("tpq").alias("_mtpq")), MEASURE)
    boxes = objects.filter("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL AND h IS NOT NULL").select(
        *SYSTEM, F.col("obj_id").alias("chord_id"), F.coalesce("staff", F.lit(0)).alias("staff"), "x", "y", "w", "h")
    boxed = sorted_join(placed, boxes, [*SYSTEM, "chord_id"])

    # Heads, stems and rests all come from the relations with their ends, which are therefore written once.
    edges = write_table(related(objects, relations), "edges")
    heads = head_facts(edges).groupBy(*SYSTEM, "chord_id").agg(
        F.avg("cx").alias("hx"), F.avg("cy").alias("hy"), F.max("dots").alias("dots"), F.bool_and("tied").alias("all_tied"),
        head_kind(F.array_sort(F.collect_set(F.coalesce("shape", F.lit(""))))).alias("head_kind"))
    is_head = F.col("kind") == "head"
    rows = sorted_join(sorted_join(boxed.filter("kind IN ('head', 'rest')"), heads, [*SYSTEM, "chord_id"], "left"), chord_facts(edges), [*SYSTEM, "chord_id"], "left")
    middle = F.col("y") + F.col("h") / 2
    one = F.struct(F.lit(1).cast("bigint").alias("num"), F.lit(1).cast("bigint").alias("den"))
    sounding = chord_quarters(F.coalesce("head_kind", F.lit("black")), F.coalesce("beams", F.lit(0)), F.coalesce("flags", F.lit(0)), F.coalesce("dots", F.lit(0)))
    silent = F.coalesce(rest_quarters(F.col("rest_shape")), one)
    rows = rows.withColumns({"cy": F.when(is_head, F.coalesce("hy", middle)).otherwise(middle), "tied": is_head & F.coalesce("all_tied", F.lit(False)),
                             "length": F.when(is_head, sounding.cast(_RATIO)).otherwise(silent.cast(_RATIO))})
    whole_measure = ~is_head & F.upper(F.coalesce("rest_shape", F.lit(""))).contains("WHOLE_REST") & (F.col("length.num") * F.col("_mtpq") >= F.col("full") * F.col("length.den"))
    return rows.filter(~whole_measure).select(
        *STACK, "measure_index", "full", "_mtpq", "chord_id", "kind", "staff", (F.col("x") + F.col("w") / 2).alias("x_abs"), F.col("cy").alias("y_abs"),
        F.when(is_head, F.col("hx")).alias("visual_x_abs"), F.when(is_head, F.col("hy")).alias("visual_y_abs"), (is_head & F.col("hx").isNotNull() & F.col("hy").isNotNull()).alias("head_geometry_exact"),
        "length", F.when(is_head, F.coalesce("dots", F.lit(0))).otherwise(F.lit(0)).cast("int").alias("dot_count"), F.when(is_head, stem_direction(F.col("cy"))).otherwise(F.lit("none")).alias("direction"),
        (is_head & ~F.col("tied")).alias("attack"), F.col("tied").alias("tie_continuation"), (~is_head).alias("rest"))


def recover_columns(
    objects: DataFrame, relations: DataFrame, stacks: DataFrame, slots: DataFrame, chords: DataFrame, entries: DataFrame, measures: DataFrame,
) -> DataFrame:
    """Columns of every measure with recovered onset and length (ticks of the score's own base ``tpq``), flags and timing source."""
    # Events, begin times, members and columns are each read by several of the steps below, so each is written once.
    events = freeze(notation_events(objects, relations, chords, stacks, measures))
    begins = freeze(begin_times(slots, entries))

    # One tick base per score for lengths, begin times and meters.
    dens = events.select("score_id", F.col("length.den").alias("v")).unionByName(begins.select("score_id", F.col("den").alias("v"))).unionByName(
        measures.select("score_id", F.col("tpq").cast("bigint").alias("v"))).distinct()
    # A score whose base leaves BIGINT has no columns; the caller reports it.
    base = dens.groupBy("score_id").agg(lcm_of(F.collect_list("v")).alias("base")).filter(F.col("base") < MAX_TPQ)
    events = events.join(base, "score_id").withColumns({
        "duration": int_div(F.col("length.num") * F.col("base"), F.col("length.den")),
        "full": int_div(F.col("full") * F.col("base"), F.col("_mtpq")),
    })
    begins = begins.join(base, "score_id").withColumn("t", int_div(F.col("num") * F.col("base"), F.col("den"))).drop("num", "den", "base")

    in_order = Scan(tuple(MEASURE), ("x_abs", "staff", "chord_id"))
    clustered = freeze(gap_clusters(events, in_order, "x_abs", F.lit(COLUMN_TOLERANCE), "i").withColumn("i", F.col("i").cast("int")))
    column = [*MEASURE, "i"]
    representative = medoids(clustered, Scan(tuple(column), ("x_abs", "chord_id")), "x_abs", "chord_id").select(*column, F.col("medoid").alias("chord_id"))
    heads = F.col("kind") == "head"
    event = F.struct("x_abs", "staff", "chord_id", "kind", "y_abs", "visual_x_abs", "visual_y_abs", "head_geometry_exact",
                     F.col("duration").alias("duration_ticks"), "dot_count", "direction", "attack", "tie_continuation", "rest")
    columns = clustered.groupBy(*column).agg(
        F.first("page_index").alias("page_index"), F.first("system_index").alias("system_index"), F.first("stack_ord").alias("stack_ord"),
        F.first("full").alias("full"), F.first("base").alias("base"),
        F.bool_or(heads & F.col("attack")).alias("attack"), F.bool_or("rest").alias("rest"),
        F.coalesce(F.bool_and(F.when(heads, F.col("tie_continuation"))), F.lit(False)).alias("tie_continuation_only"),
        F.coalesce(F.max(F.when(F.col("duration") > 0, F.col("duration"))), F.first("base")).alias("duration"),
        F.array_sort(F.collect_list(event)).alias("notation_events"), F.count_if(heads).alias("head_chords"),
    )
    x_of = sorted_join(clustered.select(*column, "chord_id", "x_abs", "y_abs"), representative, [*column, "chord_id"]).groupBy(*column).agg(
        F.first("x_abs").alias("x_abs"), F.first("y_abs").alias("y_abs"))
    columns = sorted_join(columns, x_of, column).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*MEASURE)))

    # Begin times by column, in event order then reading order.
    begun = sorted_join(clustered.select(*STACK, *[c for c in column if c not in STACK], "chord_id", "x_abs", "staff", "full"), begins, [*STACK, "chord_id"])
    seen = F.struct("x_abs", "staff", "chord_id", F.col("seen").alias("entry"))
    support = freeze(begun.groupBy(*column, "t").agg(F.count(F.lit(1)).alias("support"), F.min(seen).alias("seen"), F.first("full").alias("full")))

    gaps = support.filter("t >= 0 AND t < full").select(*MEASURE, "t").distinct()
    before = F.lag("t").over(Window.partitionBy(*MEASURE).orderBy("t"))
    lengths = gaps.withColumn("v", F.col("t") - before).filter("v IS NOT NULL").select(*MEASURE, "v").unionByName(
        clustered.select(*MEASURE, F.col("duration").alias("v")))
    sized = clustered.groupBy(*MEASURE).agg(F.first("full").alias("_full"), F.first("base").alias("_base"), (F.max("i") + 1).alias("_n"))
    lattice = sorted_join(sized, gcd_by(lengths, MEASURE, "v", "_gcd"), MEASURE, "left").withColumn("_q", quantum_columns(F.col("_gcd"), F.col("_full"), F.col("_base"), F.col("_n")))
    lattice = lattice.select(*MEASURE, F.col("_q.quantum").alias("quantum"), F.col("_q.base").alias("quantum_base"), int_div(F.col("_q.base"), F.col("_base")).alias("_scale"))
    columns = freeze(sorted_join(columns, lattice, MEASURE).withColumn("units", int_div(F.col("full") * F.col("_scale"), F.col("quantum"))))

    facts = columns.select(*column, "n", "units", "quantum", "_scale", F.col("full").alias("_full"))
    proposed = sorted_join(support, facts, column).withColumn("_ticks", F.col("t") * F.col("_scale"))
    usable = proposed.filter("t >= 0 AND t < _full AND _ticks % quantum = 0").withColumn("j", int_div(F.col("_ticks"), F.col("quantum")))
    ranked = usable.withColumn("_rank", F.row_number().over(Window.partitionBy(*column).orderBy("seen")))
    chosen = anchor_chain(ranked.select(*column, "j", "support", F.col("_rank").alias("seen"), "n", "units"), MEASURE)
    chosen = chosen.unionByName(columns.select(*MEASURE).distinct().select(*MEASURE, F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("j"))).distinct()

    anchored = sorted_join(columns, chosen.select(*column, F.col("j").alias("anchor_j")), column, "left")
    filled = monotone_fill(anchored, MEASURE, x="x_abs")
    timed = filled.withColumn("_onset", F.col("j") * F.col("quantum"))
    exact = proposed.select(*column, F.col("_ticks").alias("_onset"), F.col("support").alias("exact_support"))
    out = sorted_join(timed, exact, [*column, "_onset"], "left").withColumn("exact_support", F.coalesce("exact_support", F.lit(0)))
    source = F.when(F.col("exact_support") > 0, BEGIN_ANCHOR).when(F.col("anchor_j").isNotNull(), CHAIN_ANCHOR).otherwise(INTERPOLATED)
    sure = F.when(F.col("exact_support") > 0, F.least(F.lit(1.0), F.lit(BEGIN_CONFIDENCE) + F.lit(SUPPORT_BONUS) * F.col("exact_support"))).when(
        F.col("anchor_j").isNotNull(), F.lit(CHAIN_CONFIDENCE)).otherwise(F.lit(INTERPOLATED_CONFIDENCE))
    bases = columns.select("score_id", F.col("quantum_base").alias("v")).distinct().groupBy("score_id").agg(lcm_of(F.collect_list("v")).alias("tpq")).filter(F.col("tpq") < MAX_TPQ)
    based = out.withColumns({"timing_source": source, "confidence": sure}).join(bases, "score_id").withColumns({
        "quantum": F.col("quantum") * int_div(F.col("tpq"), F.col("quantum_base")), "semantic_anchor": F.col("anchor_j").isNotNull(), "full": int_div(F.col("full") * F.col("tpq"), F.col("base")),
        "onset": F.col("_onset") * int_div(F.col("tpq"), F.col("quantum_base")), "duration": F.col("duration") * int_div(F.col("tpq"), F.col("base"))})
    return based.select(
        "score_id", "measure_index", "page_index", "system_index", "stack_ord", F.col("i").alias("column_index"), "x_abs", "y_abs", "tpq",
        "onset", "duration", "attack", "rest", "tie_continuation_only", "timing_source", "confidence", "exact_support", "px_per_unit",
        "units", F.col("j").alias("grid_index"), "full", "quantum", "semantic_anchor", F.col("is_tail_anchor").alias("tail_anchor"), "notation_events",
        F.transform(F.filter("notation_events", lambda e: e["kind"] == "head"), lambda e: e["chord_id"]).alias("chord_ids"),
    )


def measure_audit(columns: DataFrame, stacks: DataFrame) -> DataFrame:
    """How every measure's times came about: lattice step and size, semantic and all anchors (column to grid index), columns by source.

    The columns carry their provenance, so nothing is recovered twice; a measure holds at most one column per ``COLUMN_TOLERANCE`` pixels, which bounds the lists.
    """
    at = F.struct(F.col("column_index").cast("int").alias("column"), F.col("grid_index").cast("bigint").alias("grid_index"))
    listed = lambda which: F.array_sort(F.collect_list(F.when(which, at)))
    by_source = lambda name: F.count_if(F.col("timing_source") == name)
    semantic = F.col("semantic_anchor")
    place = ["page_index", "system_index", "stack_ord"]
    audit = columns.groupBy(*MEASURE, *place).agg(
        F.first("tpq").alias("tpq"), F.first("full").alias("full"), F.first("quantum").alias("quantum"), F.first("units").alias("units"), F.first("px_per_unit").alias("px_per_unit"),
        F.count(F.lit(1)).alias("physical_column_count"), F.count_if("attack").alias("attack_column_count"), F.count_if(semantic).alias("semantic_anchor_count"),
        listed(semantic).alias("semantic_anchors"), listed(semantic | F.col("tail_anchor")).alias("timing_anchors"),
        by_source(BEGIN_ANCHOR).alias("begin_columns"), by_source(CHAIN_ANCHOR).alias("chain_columns"), by_source(INTERPOLATED).alias("interpolated_columns"))
    edges = stacks.select(*STACK, F.col("left").alias("stack_left"), F.col("right").alias("stack_right"))
    quarter = lambda c: rational_text(F.col(c), F.col("tpq"))
    return sorted_join(audit, edges, STACK, "left").withColumns({"full_duration_quarter": quarter("full"), "quantum_quarter": quarter("quantum")}).drop("tpq", "full", "quantum")


def column_stats(columns: DataFrame) -> DataFrame:
    """Counts of columns by flag, as the recovery report gives them."""
    exact = F.exists("notation_events", lambda e: (e["kind"] == "head") & e["attack"] & e["head_geometry_exact"])
    return columns.groupBy("score_id").agg(
        F.count(F.lit(1)).alias("column_count"), F.count_if("attack").alias("attack_column_count"),
        F.count_if("tie_continuation_only").alias("tie_continuation_column_count"), F.count_if("rest").alias("rest_column_count"),
        F.count_if(F.col("attack") & exact).alias("exact_attack_geometry_column_count"),
    )


def augmentation_dots(objects: DataFrame, relations: DataFrame) -> DataFrame:
    return typed_edges(objects, relations, SYSTEM, "augmentation").groupBy("score_id").agg(F.count(F.lit(1)).alias("augmentation_dot_count"))


def canonical_hits(columns: DataFrame, measures: DataFrame, symbolic: DataFrame | None = None) -> DataFrame:
    """Attack columns grouped by (measure, offset); symbolic details are attached only on an exact match."""
    bases = columns.select("score_id", F.col("tpq").alias("_ctpq")).distinct()
    frame = measures.select("score_id", "measure_index", "measure_number", "start", "full", "pickup_shift", F.col("tpq").alias("_mtpq")).join(bases, "score_id")
    up = int_div(F.col("_ctpq"), F.col("_mtpq"))
    scaled = frame.select("score_id", "measure_index", "measure_number", *[(F.col(c) * up).alias(c) for c in ("start", "full", "pickup_shift")], F.col("_ctpq").alias("tpq"))
    attacks = sorted_join(columns.filter("attack").select("score_id", "measure_index", "onset", "duration"), scaled, MEASURE)
    attacks = attacks.withColumn("offset", F.col("pickup_shift") + F.col("onset")).filter("offset >= 0 AND offset < full")
    grouped = attacks.groupBy("score_id", "measure_index", "offset").agg(
        F.coalesce(F.max(F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0)).alias("duration"),
        F.first("measure_number").alias("measure_number"), F.first("start").alias("_start"), F.first("tpq").alias("tpq"))
    hits = grouped.withColumn("onset", F.col("_start") + F.col("offset")).drop("_start").withColumn("canonical_recovered", F.lit(True))
    if symbolic is None:
        return hits
    detail = [c for c in ("source_count", "pitches", "tuplets") if c in symbolic.columns]
    known = symbolic.join(bases, "score_id").join(measures.select("score_id", F.col("tpq").alias("_mtpq")).distinct(), "score_id")
    factor = int_div(F.col("_ctpq"), F.col("_mtpq"))
    if "tuplets" in detail:
        known = known.withColumn("tuplets", F.transform("tuplets", lambda t: F.struct(t["actual"].alias("actual"), t["normal"].alias("normal"), (t["duration"] * int_div(F.col("_ctpq"), F.col("_mtpq"))).alias("duration"))))
    known = known.select("score_id", "measure_index", (F.col("offset") * factor).alias("offset"), "onset", *detail)
    last = known.groupBy("score_id", "measure_index", "offset").agg(F.max_by(F.struct(*detail), "onset").alias("_s"))
    joined = sorted_join(hits, last, ["score_id", "measure_index", "offset"], "left")
    empty = {"source_count": F.lit(0).cast("bigint"), "pitches": F.array().cast("array<string>"),
             "tuplets": F.array().cast("array<struct<actual:int,normal:int,duration:bigint>>")}
    return joined.withColumns({c: F.coalesce(F.col(f"_s.{c}"), empty[c]) for c in detail}).drop("_s")

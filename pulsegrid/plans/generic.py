"""The operators on the event, order and part tables: every frame below derives from the whole given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.functions.grid import grid_position, grid_top
from pulsegrid.functions.rational import int_div, rational_text
from pulsegrid.operators import clusters, level_index, profiles, timeline
from pulsegrid.operators.anchors import anchor_chain, monotone_fill
from pulsegrid.operators.hits import attack_key
from pulsegrid.operators.labels import level1_labels as label_level1
from pulsegrid.operators.quantum import gcd_by, quantum_columns
from pulsegrid.operators.scan import Scan, sized_scan
from pulsegrid.operators.segments import segment_hits
from pulsegrid.plans.events import (
    TPQ, day_of, event_hits, event_levels, event_measures, event_segments, read_events, seconds_since_epoch,
)
from pulsegrid.session import write_table

LONG = "bigint"


def as_text(array: Column | str) -> Column:
    col = F.col(array) if isinstance(array, str) else array
    return F.array_join(col.cast("array<string>"), ",")


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast(LONG).alias(n) for n in names]


def users(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("score_id"))


def ordered_events(events: DataFrame) -> tuple[DataFrame, Scan]:
    """Raw events per user in (ts, event_id) order; chunked when one user is too large for a task."""
    rows = events.select(F.col("user_id").alias("score_id"), "ts", "event_id", "event_type", F.ceil("value").cast(LONG).alias("dur"),
                         seconds_since_epoch().alias("sec"))
    return sized_scan(rows, ["score_id"], ["ts", "event_id"])


# -- hits, segments, levels -----------------------------------------------------------------------------------------------------


def hit_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = event_hits(read_events(spark, sf_dir))
    return hits.select(*longs("score_id", "onset", "measure_index", "offset", "duration", "source_count"), as_text("pitches").alias("pitches"),
                       attack_key(F.col("measure_index"), F.col("offset"), F.lit(TPQ)).alias("attack_key"))


def meter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_segments(read_events(spark, sf_dir))
    return s.select(*longs("score_id", "segment_index", "start", "end", "start_measure_index", "end_measure_index", "num", "den",
                           "beat_ticks", "beat_count", "top_base"), F.col("compound").cast(LONG).alias("compound"))


def placed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    return segment_hits(event_hits(events), event_segments(events))


def segment_hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_hits(spark, sf_dir).select(*longs("score_id", "onset", "segment_index", "segment_start", "segment_end", "num", "den"))


def grid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of every beat position of every segment of the calendar."""
    segments = event_segments(read_events(spark, sf_dir))
    beats = int_div(F.col("end") - F.col("start"), F.col("beat_ticks"))
    positions = segments.select("score_id", "segment_index", "top_base", beats.alias("beats")).select("*", F.explode(F.sequence(F.lit(0).cast(LONG), F.col("beats"))).alias("position"))
    g = positions.withColumn("_g", grid_position(F.col("position"), grid_top(F.col("top_base"), F.col("beats")), F.col("top_base")))
    return g.select(*longs("score_id", "segment_index", "position"), as_text("_g.levels").alias("levels"),
                    F.when(F.col("position") < F.col("beats"), F.col("_g.span")).cast(LONG).alias("span_level"))


def level_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_levels(read_events(spark, sf_dir)).select(
        *longs("score_id", "segment_index", "onset", "height", "density", "lowest_level"), as_text("levels").alias("levels"))


def level_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by Level: how many attacks each Level holds in each segment, from where to where."""
    rows = event_levels(read_events(spark, sf_dir)).select("score_id", "segment_index", "onset", F.explode("levels").alias("level"))
    return rows.groupBy("score_id", "segment_index", "level").agg(
        F.count(F.lit(1)).alias("positions"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset"), F.sum("onset").alias("onset_sum"),
    ).select(*longs("score_id", "segment_index", "level", "positions", "first_onset", "last_onset", "onset_sum"))


def level_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists Level -> onsets, delta-coded in blocks of ticks."""
    index = level_index.build(event_levels(read_events(spark, sf_dir)))
    return index.select(*longs("score_id", "segment_index", "level", "block", "positions"), as_text("deltas").alias("deltas"))


def level_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Levels of a segment as the result reports them: positions restored from the lists, and the label of its first Level-1 position."""
    events = read_events(spark, sf_dir)
    levels = write_table(event_levels(events), "levels")
    measures = event_measures(events).withColumn("measure_number", (F.col("measure_index") + 1).cast("string"))
    found = level_index.marks(levels, write_table(level_index.build(levels), "level-index"), label_level1(levels, measures, F.lit(TPQ)))
    return found.select(*longs("score_id", "segment_index", "level", "positions", "blocks", "first_onset", "last_onset", "events"), F.coalesce("first_label", F.lit("none")).alias("first_label"))


def level1_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    measures = event_measures(events).withColumn("measure_number", (F.col("measure_index") + 1).cast("string"))
    return label_level1(event_levels(events), measures, F.lit(TPQ)).select(*longs("score_id", "segment_index", "onset"), "label")


# -- profiles -------------------------------------------------------------------------------------------------------------------


def banded_events(events: DataFrame) -> DataFrame:
    """Merged hits with Levels read off their size: lowest 1 + duration mod 8, highest at least that, from duration in eights."""
    hits = segment_hits(event_hits(events), event_segments(events))
    low = (F.col("duration") % 8 + 1).cast("int")
    high = F.greatest(low, (F.least(F.lit(7).cast(LONG), int_div(F.col("duration"), 8)) + 1).cast("int"))
    return hits.withColumn("levels", F.array_distinct(F.array(low, high))).withColumns({
        "height": F.array_max("levels"), "density": F.size("levels"), "lowest_level": F.array_min("levels")})


def banded_wave(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scan]:
    events = read_events(spark, sf_dir)
    return profiles.profile_scan(profiles.wave_profile(banded_events(events)), users(events))


def wave_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave, _ = banded_wave(spark, sf_dir)
    return wave.select(*longs("score_id", "segment_index", "onset", "measure_index", "offset", "height", "density", "lowest_level"))


def pivot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave, scan = banded_wave(spark, sf_dir)
    return profiles.pivots(wave, scan).select(
        *longs("score_id", "pivot_index", "segment_index", "drop_depth", "immediate_drop_depth", "crest_height", "trough_height", "recovery_height",
               "pivot_onset", "after_drop_onset", "trough_onset", "recovery_onset"), "kind")


def pivot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave, scan = banded_wave(spark, sf_dir)
    return profiles.pivot_stats(profiles.pivots(wave, scan)).select(*longs("score_id", "pivots", "simple_pivots", "compound_pivots", "deepest_drop"))


def level_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: events -> hits -> segments -> Levels -> wave -> turning points."""
    events = read_events(spark, sf_dir)
    wave, scan = profiles.profile_scan(profiles.wave_profile(event_levels(events)), users(events))
    return profiles.pivots(wave, scan).select(
        *longs("score_id", "pivot_index", "segment_index", "drop_depth", "immediate_drop_depth", "crest_height", "trough_height",
               "pivot_measure_index", "pivot_offset", "pivot_onset", "trough_onset", "recovery_onset"), "kind")


def banded_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scan]:
    wave, scan = banded_wave(spark, sf_dir)
    return profiles.tree(wave, scan), scan


def tree_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, scan = banded_tree(spark, sf_dir)
    return profiles.branches(nodes, scan).select(
        *longs("score_id", "branch_index", "segment_index", "source_node_index", "target_node_index", "source_onset", "target_onset",
               "source_level", "target_level", "distance"), F.col("same_level").cast(LONG).alias("same_level"))


def tree_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = banded_tree(spark, sf_dir)
    return profiles.tree_nodes(nodes).select(*longs("score_id", "node_index", "onset", "lowest_level", "incoming_branches", "outgoing_branches"),
                                             F.col("root").cast(LONG).alias("root"))


# -- timeline -------------------------------------------------------------------------------------------------------------------


def cursor_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a measure: views and purchases are notes, clicks chord notes, errors go back, signups go forward."""
    rows, scan = ordered_events(read_events(spark, sf_dir))
    kind = F.col("event_type")
    elements = rows.select(
        "*", int_div(F.col("sec"), 86400).alias("measure_index"),
        F.when(kind == "error", "backup").when(kind == "signup", "forward").otherwise("note").alias("tag"),
        (kind == "click").alias("is_chord"), ((kind == "purchase") & (F.col("dur") % 5 == 0)).alias("is_grace"),
    )
    timed = timeline.cursor(elements, scan.within("measure_index"))
    return timed.select(*longs("score_id", "measure_index", "event_id", "cursor", "onset_local", "reach"), "tag")


def ffill_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups set the divisions in force until the next signup."""
    rows, scan = ordered_events(read_events(spark, sf_dir))
    filled = scan.running(rows, _d=("last", F.when(F.col("event_type") == "signup", F.col("dur"))))
    return filled.select(*longs("score_id", "event_id"), F.coalesce("_d", F.lit(1)).cast(LONG).alias("divisions"))


def measure_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_measures(read_events(spark, sf_dir)).select(*longs("score_id", "measure_index", "num", "den", "full", "start"))


def tie_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks open a tie, views continue it, purchases end it, others are plain attacks."""
    rows, scan = ordered_events(read_events(spark, sf_dir))
    kind = F.col("event_type")
    notes = rows.select("*", F.col("dur").alias("duration"), kind.isin("click", "view").alias("tie_start"), kind.isin("view", "purchase").alias("tie_stop")).drop("dur", "sec")
    attacks, unmatched = timeline.tie_chains(notes, scan)
    both = attacks.select("score_id", "event_id", "duration", F.lit("attack").alias("outcome")).unionByName(
        unmatched.select("score_id", "event_id", "duration", F.lit("unmatched-stop").alias("outcome")))
    return both.select(*longs("score_id", "event_id", "duration"), "outcome")


def layout_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups start a page, errors start a system; every event is as wide as its duration."""
    rows, scan = ordered_events(read_events(spark, sf_dir))
    laid = rows.select("*", (F.col("event_type") == "signup").alias("new_page"), (F.col("event_type") == "error").alias("new_system"),
                       F.col("dur").alias("width"), F.lit(0.0).alias("system_left"), F.lit(220.0).alias("system_distance"), F.lit(100.0).alias("top_system_distance"))
    return timeline.layout_counters(laid, scan).select(
        *longs("score_id", "event_id", "page_index", "system_index", "x_offset", "down"))


def visual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as noteheads: page = week, system = day, x = hour; errors are grace notes, purchases tied continuations."""
    events = read_events(spark, sf_dir)
    sec, kind = seconds_since_epoch(), F.col("event_type")
    day = day_of(sec)
    rows = events.select(
        F.col("user_id").alias("score_id"), day.cast("int").alias("measure_index"), int_div(day, 7).cast("int").alias("layout_page"),
        (day % 7).cast("int").alias("layout_system"),
        F.when(kind != "signup", int_div(F.pmod(sec, F.lit(86400)), 3600).cast("double")).alias("layout_default_x"),
        F.when(kind == "error", "grace").otherwise("main").alias("visual_kind"), int_div(sec, 60).alias("onset"),
        F.ceil("value").cast(LONG).alias("duration"), F.lit(0.0).alias("x_start"), F.col("event_id").alias("doc_rank"), kind.alias("pitch"),
        F.when(kind == "view", F.struct(F.lit(3).alias("actual"), F.lit(2).alias("normal"))).alias("tuplet"),
        (~kind.isin("error", "purchase")).alias("_sounds"),
    )
    pitches = F.transform("pitches", lambda p: F.concat_ws("*", p["pitch"], p["n"].cast("string")))
    return timeline.group_visual(rows).select(
        *longs("score_id", "measure_index", "layout_page", "layout_system", "layout_default_x", "onset", "duration", "notes", "tuplet_actual", "tuplet_normal"),
        "visual_kind", as_text(pitches).alias("pitches"), F.col("analyzed").cast(LONG).alias("analyzed"))


# -- clusters and lattices ------------------------------------------------------------------------------------------------------

GAP_MINUTES = 240


def _minutes(events: DataFrame) -> tuple[DataFrame, Scan]:
    rows, scan = ordered_events(events)
    return rows.withColumn("minute", int_div(F.col("sec"), 60)), scan


def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scan = _minutes(read_events(spark, sf_dir))
    return clusters.gap_clusters(rows, scan, "minute", F.lit(GAP_MINUTES)).select(*longs("score_id", "event_id", "minute", "cluster"))


def cluster_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scan = _minutes(read_events(spark, sf_dir))
    grouped = clusters.gap_clusters(rows, scan, "minute", F.lit(GAP_MINUTES))
    return clusters.medoids(grouped, scan.within("cluster"), "minute", "event_id").select(
        *longs("score_id", "cluster", "medoid", "medoid_value", "total_distance", "members"))


def day_columns(events: DataFrame) -> DataFrame:
    """Events of a user's day merged per minute: at most 1,440 columns per day whatever the number of events."""
    sec = seconds_since_epoch()
    return events.select(F.col("user_id").alias("score_id"), day_of(sec).alias("measure_index"), int_div(F.pmod(sec, F.lit(86400)), 60).alias("x"),
                         F.ceil("value").cast(LONG).alias("duration")).groupBy("score_id", "measure_index", "x").agg(
        F.count(F.lit(1)).alias("members"), F.max("duration").alias("duration"))


def centroid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = day_columns(read_events(spark, sf_dir))
    scan = Scan(("score_id", "measure_index"), ("x",))
    out = clusters.centroid_columns(columns.select("score_id", "measure_index", "x", "members"), scan, "x", "members", F.lit(90.0))
    return out.select(*longs("score_id", "measure_index", "column_index", "first_value", "last_value", "members"))


def gcd_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice step of each order: gcd of its quantities (as 32nds of a quarter), with room for one column per line number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_quantity").cast(LONG).alias("ticks"), "l_linenumber")
    steps = gcd_by(lines, ["l_orderkey"], "ticks")
    sized = lines.groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("columns"), F.max("ticks").alias("longest"))
    joined = steps.join(sized, "l_orderkey").withColumn("_q", quantum_columns(F.col("gcd"), F.col("longest"), F.lit(32), F.col("columns")))
    return joined.select(*longs("l_orderkey", "gcd", "columns", "longest"), rational_text(F.col("_q.quantum"), F.col("_q.base")).alias("quantum"))


UNITS_PER_DAY = 1440


def _indexed_columns(events: DataFrame) -> DataFrame:
    keys = ("score_id", "measure_index")
    numbered = Scan(keys, ("x",)).number(day_columns(events), "i")
    return numbered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def anchor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a user's day with a candidate position each: the minute, bent by the duration so that candidates contradict."""
    columns = _indexed_columns(read_events(spark, sf_dir))
    candidates = columns.select("score_id", "measure_index", "i", "n", ((F.col("x") + F.col("duration") * 7) % UNITS_PER_DAY).alias("j"),
                                F.col("members").alias("support"), F.lit(0).alias("seen"), F.lit(UNITS_PER_DAY).alias("units"))
    return anchor_chain(candidates, ["score_id", "measure_index"]).select(*longs("score_id", "measure_index", "i", "j"))


def fill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third column of a day is anchored near its minute on a lattice of 15-minute units; the rest is filled."""
    columns = _indexed_columns(read_events(spark, sf_dir))
    anchored = columns.withColumns({
        "anchor_j": F.when(F.col("i") % 3 == 0, F.col("i") + int_div(F.col("x"), 20)),
        "units": F.lit(UNITS_PER_DAY).cast(LONG)})
    return monotone_fill(anchored, ["score_id", "measure_index"]).select(*longs("score_id", "measure_index", "i", "x", "j"))

"""Reconciliation, registration, layout, relation and word queries on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions import combinatorics as C
from pulsegrid.functions.rational import int_div
from pulsegrid.operators import clusters, graph, profiles, quality, reconcile, register, residues, timeline, words
from pulsegrid.operators.scan import Scan
from pulsegrid.plans.events import TPQ, calendar_columns, day_of, read_events, seconds_since_epoch, week_meter, week_of
from pulsegrid.plans.generic import (
    LONG, as_text, banded_events, banded_wave, longs, ordered_events,
)
from pulsegrid.session import write_table


# -- reconciliation -------------------------------------------------------------------------------------------------------------


def _active_days(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Days with events as sparse measures numbered by day; every seventh user claims one stack more than its days span."""
    days = events.select(F.col("user_id").alias("score_id"), day_of(seconds_since_epoch()).alias("day")).distinct()
    numbered = Scan(("score_id",), ("day",)).number(days, "measure_index").withColumn("measure_index", F.col("measure_index").cast("int"))
    num, den = week_meter(F.col("day"))
    text = F.when(F.col("score_id") % 13 == 5, F.concat(F.lit("x"), F.col("day"))).otherwise(F.col("day").cast("string"))
    measures = numbered.select("score_id", "measure_index", text.alias("measure_number"), num.cast("int").alias("num"), den.cast("int").alias("den"),
                               int_div(num * 4 * TPQ, den).alias("full"), int_div(num * 4 * TPQ, den).alias("actual"),
                               F.lit(0).cast(LONG).alias("pickup_shift"), F.lit(False).alias("implicit"), F.lit(TPQ).alias("tpq"))
    extra = F.when(F.col("score_id") % 7 == 0, 1).otherwise(0)
    stacks = days.groupBy("score_id").agg((F.max("day") - F.min("day") + 1).alias("n")).select("score_id", (F.col("n") + extra).cast("int").alias("stacks"))
    return measures, stacks


def framework_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    framework, _ = reconcile.framework_gaps(*_active_days(read_events(spark, sf_dir)))
    return framework.select(*longs("score_id", "measure_index", "num", "den", "full", "start"), "measure_number", F.col("synthesized").cast(LONG).alias("synthesized"))


def framework_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, verdicts = reconcile.framework_gaps(*_active_days(read_events(spark, sf_dir)))
    return verdicts.select(*longs("score_id", "stacks", "measures", "synthesized"), F.coalesce("rejection", F.lit("none")).alias("rejection"))


# -- registration ---------------------------------------------------------------------------------------------------------------


def notation_columns(events: DataFrame) -> DataFrame:
    """Events of one minute at one lattice position as a column: purchases, clicks and views attack, purchases and clicks have exact heads.

    Heads are distinct (second, type) pairs, at most 300 per column.
    """
    sec, kind = seconds_since_epoch(), F.col("event_type")
    base = events.select(F.col("user_id").alias("score_id"), kind.alias("kind_name"), *calendar_columns(sec), int_div(F.pmod(sec, F.lit(86400)), 60).cast("int").alias("column_index"), F.pmod(sec, F.lit(86400)).alias("second"))
    head = F.struct(
        F.lit("head").alias("kind"), F.col("kind_name").isin("purchase", "click", "view").alias("attack"), F.col("kind_name").isin("purchase", "click").alias("head_geometry_exact"),
        F.col("second").cast("double").alias("visual_x_abs"), F.length("kind_name").cast("double").alias("visual_y_abs"), F.col("kind_name").alias("chord_id"))
    return base.groupBy("score_id", "measure_index", "offset", "column_index").agg(F.array_sort(F.collect_set(head)).alias("notation_events")).withColumns({
        "attack": F.exists("notation_events", lambda e: e["attack"]), "page_index": week_of(F.col("measure_index")),
        "system_index": F.pmod("measure_index", F.lit(7)).cast("int"), "x_abs": F.col("column_index") * 60.0 + 30.0,
        "timing_source": F.lit("lattice"), "confidence": F.lit(1.0)})


def _pages(events: DataFrame) -> DataFrame:
    """A page per user and week, except the fourth week, which has no known size."""
    week = week_of(day_of(seconds_since_epoch()))
    return events.select(F.col("user_id").alias("score_id"), week.alias("page_index")).distinct().filter("page_index <> 3").withColumns({
        "width": F.lit(86400.0), "height": F.lit(64.0)})


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    return register.register_anchors(banded_events(events), notation_columns(events), _pages(events))


def register_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _anchors(spark, sf_dir)
    return a.select(*longs("score_id", "measure_index", "offset", "page_index", "system_index", "recovered_x_abs"), "cx_norm", "cy_norm", F.coalesce("reason", F.lit("mapped")).alias("reason"))


def register_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.register_stats(_anchors(spark, sf_dir)).select(*longs("score_id", "level", "expected", "mapped", "missing"))


def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return register.missing_targets(_anchors(spark, sf_dir)).select(*longs("score_id", "level", "measure_index", "offset"), "reason")


def _wave(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scan]:
    """The wave, which the points and their anchors both read, written once."""
    wave, scan = banded_wave(spark, sf_dir)
    return write_table(wave, "wave"), scan


def _wave_anchors(wave: DataFrame) -> DataFrame:
    """Wave points at the position of their time of day; every eleventh offset has none."""
    return wave.filter("offset % 11 <> 0").select(
        "score_id", "measure_index", "offset", "onset", week_of(F.col("measure_index")).alias("page_index"), F.pmod("measure_index", F.lit(7)).cast("int").alias("system_index"),
        (F.col("offset") / 256.0).alias("cx_norm"), F.lit(0.5).alias("cy_norm"), F.col("offset").cast("double").alias("recovered_x_abs"), F.lit("wave").alias("registration_source"))


def branch_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave, scan = _wave(spark, sf_dir)
    # Branches and nodes read the tree, and both ends of a branch read the nodes.
    nodes = write_table(profiles.tree(wave, scan), "tree")
    placed = write_table(register.register_nodes(nodes.drop("parent"), _wave_anchors(wave)), "nodes")
    pieces = register.register_branches(profiles.branches(nodes, scan), placed)
    return pieces.select(*longs("score_id", "branch_index", "page_index", "system_index", "endpoint_level", "source_x_abs", "target_x_abs"), "span_role")


def pivot_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave, scan = _wave(spark, sf_dir)
    placed = register.register_pivots(profiles.pivots(wave, scan), _wave_anchors(wave))
    return placed.select(*longs("score_id", "pivot_index", "page_index", "system_index", "recovered_x_abs"), F.coalesce("reason", F.lit("mapped")).alias("reason"))


def wave_anchor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave, _ = _wave(spark, sf_dir)
    return register.point_stats(register.register_wave(wave, _wave_anchors(wave)), "wave").select(
        *longs("score_id", "wave_expected", "wave_mapped", "wave_missing", "wave_max_height"))


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the order line whose unit price is closest to the retail price."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", F.col("l_linenumber").cast(LONG).alias("l_linenumber"),
                                                                   (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    # Equal prices of a part compete only by order and line, so one row per (part, price) goes into the join.
    slim = lines.groupBy("p_partkey", "unit_price").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("line")).select("p_partkey", "unit_price", "line.*")
    closest = register.closest_rows(slim.join(parts, "p_partkey"), ["p_partkey"], F.abs(F.col("unit_price") - F.col("p_retailprice")), ["unit_price", "l_orderkey", "l_linenumber"])
    return closest.select(*longs("p_partkey", "l_orderkey", "l_linenumber"))


# -- layout and relations -------------------------------------------------------------------------------------------------------


def top_gap_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's timeline cut at its largest pauses into one to four systems."""
    rows, scan = ordered_events(read_events(spark, sf_dir))
    minute = int_div(F.col("sec"), 60)
    cut = clusters.largest_gap_systems(rows.withColumn("wanted", (F.col("score_id") % 4 + 1).cast("int")), scan, minute, minute, "wanted")
    return cut.select(*longs("score_id", "event_id", "system_index"))


def guard_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a month as a system of the year's page: day of year down, price across."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.dayofyear("o_orderdate").cast(LONG)
    boxes = orders.select(F.year("o_orderdate").cast(LONG).alias("page"), F.month("o_orderdate").cast(LONG).alias("system"), day.alias("top"), (day + 5).alias("bottom"),
                          F.col("o_totalprice").alias("left"), F.col("o_totalprice").alias("right"))
    return clusters.guard_bounds(boxes, ["page"], "system").select(*longs("page", "system", "top", "bottom"), "left", "right", F.col("guard_bottom").cast("double").alias("guard_bottom"))


#: Edges that a task of ``graph_members`` counts on average.
EDGES_OF_A_TASK = 500_000


def graph_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts as objects, order lines as relations typed by return flag: members and distinct members per order and type."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("obj_id"), F.lit("order").alias("tag"), F.col("o_orderstatus").alias("shape"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("p"), "p_partkey").alias("obj_id"), F.lit("part").alias("tag"), F.col("p_type").alias("shape"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("type"))
    edges = graph.typed_edges(orders.unionByName(parts), lines, [], None, ["order"], ["part"])
    # Nearly every edge is a group of its own until its order's edges are together, so they are dealt out by order first, a bounded number to a task.
    dealt = edges.select("source", "type", "target", "target_shape").repartition(lines.count() // EDGES_OF_A_TASK + 1, "source")
    return dealt.groupBy("source", "type").agg(F.count("target").alias("members"), F.count_distinct("target").alias("distinct_members"),
                                               F.count_if(F.col("target_shape") == "SMALL").alias("small_members")).select("source", "type", *longs("members", "distinct_members", "small_members"))


# -- words and numbers ----------------------------------------------------------------------------------------------------------


def day_words(events: DataFrame) -> DataFrame:
    """A word per user and day, one letter per hour up to the last active one: T where a purchase or click fell, else A."""
    sec = seconds_since_epoch()
    hours = events.select(F.col("user_id").alias("score_id"), day_of(sec).alias("measure_index"), int_div(F.pmod(sec, F.lit(86400)), 3600).cast("int").alias("hour"),
                          F.col("event_type").isin("purchase", "click").alias("on"))
    days = hours.groupBy("score_id", "measure_index").agg(F.max("hour").alias("last"), F.collect_set(F.when(F.col("on"), F.col("hour"))).alias("ts"))
    letters = F.transform(F.sequence(F.lit(0), F.col("last")), lambda h: F.when(F.array_contains(F.col("ts"), h), "T").otherwise("A"))
    return days.select("score_id", "measure_index", F.array_join(letters, "").alias("word"))


def metric_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    traced = words.word_profiles(day_words(read_events(spark, sf_dir)), modulus=3)
    return traced.select(*longs("score_id", "measure_index", "n", "k", "class_size", "binomial_mod", "lucas_mod"), "metric_word", as_text(F.transform("path", lambda p: p["j"])).alias("path"))


def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_classes(day_words(read_events(spark, sf_dir))).select(*longs("n", "k", "words", "distinct_words", "class_size"))


def month_words(events: DataFrame) -> DataFrame:
    """A word per user and four weeks, one letter per hour up to the last active one: T where an event fell, else A."""
    sec = seconds_since_epoch()
    month = int_div(week_of(day_of(sec)) - F.pmod(week_of(day_of(sec)), F.lit(4)), 4)
    hours = events.select(F.col("user_id").alias("score_id"), month.alias("month"), int_div(sec - month.cast(LONG) * 2419200, 3600).cast("int").alias("hour"))
    months = hours.groupBy("score_id", "month").agg(F.max("hour").alias("last"), F.collect_set("hour").alias("on"))  # at most 672 hours
    letters = F.transform(F.sequence(F.lit(0), F.col("last")), lambda h: F.when(F.array_contains(F.col("on"), h), "T").otherwise("A"))
    return months.select("score_id", "month", F.array_join(letters, "").alias("word"))


def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of words of up to 672 letters with their exact sizes, which have up to 200 digits."""
    classes = words.word_classes(month_words(read_events(spark, sf_dir)))
    return classes.select(*longs("n", "k", "words", "distinct_words"), "class_size", F.length("class_size").cast(LONG).alias("digits"))


def _order_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("o_orderkey") % 4
    p = F.when(turn == 0, 2).when(turn == 1, 3).when(turn == 2, 5).otherwise(7).cast(LONG)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("k"), p.alias("p"), (F.col("o_custkey") % 3).alias("m"))


def lucas_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C(order key, customer key) modulo a small prime, and its invariance when both are scaled by p^m."""
    rows = residues.with_tables(_order_numbers(spark, sf_dir), "p")
    n, k, p, m, parts = (F.col(c) for c in ("n", "k", "p", "m", "parts"))
    factor = C.int_power(p, m)
    both = rows.select("o_orderkey", "p", residues.residue(n, k, p, parts).alias("residue"), residues.residue(factor * n, factor * k, p, parts).alias("scaled"))
    return both.select(*longs("o_orderkey", "p", "residue"), (F.col("residue") == F.col("scaled")).cast(LONG).alias("invariant"))


def binomial_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomials of reduced order and customer keys modulo any number from 2 to 36, once more with both scaled by it, and whether the two agree."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    numbers = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (key % 61).alias("n"), (customer % 61).alias("k"), (key % 35 + 2).alias("modulus"))
    n, k, m, parts = (F.col(c) for c in ("n", "k", "modulus", "parts"))
    both = residues.with_tables(numbers, "modulus").select("o_orderkey", "modulus", residues.residue(n, k, m, parts).alias("residue"), residues.residue(m * n, m * k, m, parts).alias("scaled_residue"))
    return both.select(*longs("o_orderkey", "modulus", "residue", "scaled_residue"), (F.col("residue") == F.col("scaled_residue")).cast(LONG).alias("invariant"))


def boundary_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary sequence of base p up to the order key: number of terms, last term, and agreement of closed form and recurrence."""
    rows = _order_numbers(spark, sf_dir)
    terms = C.boundaries_up_to(F.col("p"), F.col("n") + 1)
    out = rows.select("o_orderkey", "p", terms.alias("t"))
    return out.select(*longs("o_orderkey", "p"), F.size("t").cast(LONG).alias("terms"), F.element_at("t", -1).alias("last_term"),
                      (F.col("t") == C.boundary_sequence(F.col("p"), F.size("t"))).cast(LONG).alias("closed_form_agrees"))


def scale_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of an order (plus one) as an arity schedule; only prime schedules have a scale vector."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_linenumber") + 1).cast(LONG).alias("p"))
    schedules = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p")).alias("schedule"))
    return schedules.select(*longs("l_orderkey"), as_text("schedule").alias("schedule"), C.valid_schedule(F.col("schedule")).cast(LONG).alias("valid"),
                            F.coalesce(as_text(C.scale_vector(F.col("schedule"))), F.lit("none")).alias("scales"))


# -- quality --------------------------------------------------------------------------------------------------------------------


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of tie folding, reconciliation and registration in one table, counted per user and code."""
    events = read_events(spark, sf_dir)
    rows, scan = ordered_events(events)
    kind = F.col("event_type")
    notes = rows.select("*", F.col("dur").alias("duration"), kind.isin("click", "view").alias("tie_start"), kind.isin("view", "purchase").alias("tie_stop"))
    _, unmatched = timeline.tie_chains(notes, scan)
    _, verdicts = reconcile.framework_gaps(*_active_days(events))
    missing = register.missing_targets(_anchors(spark, sf_dir))
    report = quality.union_reports(
        quality.note_rows("timeline", "unmatched-tie-stop", unmatched.withColumn("pitch", kind), None, pitch="pitch"),
        reconcile.framework_warnings(verdicts),
        quality.note_rows("registration", "missing-label", missing, "measure_index", reason="reason", level="level"),
    )
    return report.groupBy("score_id", "stage", "code").agg(F.count(F.lit(1)).alias("n")).select(*longs("score_id", "n"), "stage", "code")

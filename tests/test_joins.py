"""Sides with a row per slot, measure or graph object are never broadcast, however small Spark takes them for."""

import pyarrow as pa
from pyspark.sql import functions as F

from pulsegrid.operators import anchors, columns as C
from pulsegrid.operators import reconcile
from pulsegrid.plans import event_scores as S
from pulsegrid.plans import generic_more as H
from pulsegrid.plans.events import read_events

BROADCAST = "BroadcastHashJoin"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def day_events(spark):
    return spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, int(id), 0, 0) AS ts, id % 3 AS user_id, "
                     "element_at(array('view', 'click', 'purchase', 'signup', 'error'), int(id % 5) + 1) AS event_type, double(id % 40) AS value FROM range(200)")


def graph(spark, tmp_path):
    """The graph of events read from a file, whose size Spark knows."""
    day_events(spark).write.parquet(str(tmp_path / "events.parquet"))
    events = read_events(spark, str(tmp_path))
    return events, S.notation_graph(events)


def test_begin_times_and_events_of_columns(spark, tmp_path):
    events, g = graph(spark, tmp_path)
    assert BROADCAST not in plan(C.begin_times(g["slots"], g["entries"]))
    measures = S.graph_measures(events).drop("day")
    assert BROADCAST not in plan(C.notation_events(g["objects"], g["relations"], g["chords"], g["stacks"], measures))


def test_dots_of_stats(spark, tmp_path):
    _, g = graph(spark, tmp_path)
    assert BROADCAST not in plan(C.augmentation_dots(g["objects"], g["relations"]))


def test_audit(spark, tmp_path):
    events, g = graph(spark, tmp_path)
    columns = S._columns(events, g)
    audit = C.measure_audit(columns, g["stacks"])
    assert BROADCAST not in plan(audit) and audit.count() == columns.select("score_id", "measure_index").distinct().count()


def test_hits(spark, tmp_path):
    events, g = graph(spark, tmp_path)
    measures = S.graph_measures(events)
    symbolic = S.graph_symbolic(events, measures)
    assert BROADCAST not in plan(symbolic)
    framework = measures.select("score_id", F.col("measure_index").alias("old_index"), "measure_index", "start")
    assert not any(BROADCAST in plan(df) for df in reconcile.remap_hits(symbolic, framework))


def test_members_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """The tasks grow in number with the lines, not in size."""
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(H, "EDGES_OF_A_TASK", 500, raising=False)
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    found = H.graph_members(spark, sf)
    assert BROADCAST not in plan(found) and f"{lines // 500 + 1}), REPARTITION_BY_NUM" in plan(found)
    assert found.agg(F.sum("members")).first()[0] == lines


def test_ends_of_relations_are_looked_up_once(spark, tmp_path):
    """heads, dots, ties, stems, beams, flags and rests share one table of relations with their ends, so the plan stays small enough for the driver."""
    events, g = graph(spark, tmp_path)
    found = C.notation_events(g["objects"], g["relations"], g["chords"], g["stacks"], S.graph_measures(events).drop("day"))
    assert plan(found).count("SortMergeJoin") <= 6


def test_chains_come_from_arrow_columns():
    """the workers get and return Arrow columns and need no pandas."""
    lists = pa.array([[{"i": 1, "seen": 0, "j": 1, "w": 2}, {"i": 2, "seen": 0, "j": 4, "w": 1}], [], [{"i": 1, "seen": 0, "j": 3, "w": 1}]],
                     pa.list_(pa.struct([("i", pa.int32()), ("seen", pa.int64()), ("j", pa.int64()), ("w", pa.int64())])))
    want = [[{"i": 1, "j": 1}, {"i": 2, "j": 4}], [], [{"i": 1, "j": 3}]]
    assert anchors._chains(lists).to_pylist() == want and anchors._chains(lists[1:]).to_pylist() == want[1:]


def test_wave_of_endpoints_is_computed_once(spark, tmp_path):
    """points, anchors and both ends of a branch read written tables, none of them the events again."""
    day_events(spark).write.parquet(str(tmp_path / "events.parquet"))
    for query in (H.branch_endpoints, H.pivot_anchors, H.wave_anchor_stats):
        assert "events.parquet" not in plan(query(spark, str(tmp_path)))

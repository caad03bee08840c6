"""One bad score next to a good one: the good one is unchanged, the bad one is in the report, nothing aborts or vanishes."""

from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.rational import parse_rational
from pulsegrid.operators import profiles, reconcile
from pulsegrid.operators.scan import Scan
from pulsegrid.plans import events as E
from pulsegrid.plans import scores as J
from pulsegrid.sources import musicxml
from tests.scores import measure, note, score
from tests.test_canonical import measures, project  # noqa: F401

C4 = ("C", None, 4)


@pytest.mark.parametrize("large", [(2**39 + 1, 2**39 + 3), (2**61 - 1, 2**62 - 57)])
def test_tick_base_too_large(spark, tmp_path, large):
    good = score([measure("1", note(2, C4), note(2, C4), divisions=1, time=(4, 4))])
    (tmp_path / "good.xml").write_bytes(good)
    alone = J.parse_scores(*(musicxml.read_scores(spark, str(tmp_path))[t] for t in ("elements", "measures", "layout")))
    want = [r.asDict() for r in alone.hits.drop("score_id").orderBy("onset").collect()]
    bad = score([measure("1", note(1, C4), divisions=3, time=(4, 4)), measure("2", note(1, C4), divisions=5), measure("3", note(1, C4), time=(4, 1))])
    (tmp_path / "bad.xml").write_bytes(bad)
    tables = musicxml.read_scores(spark, str(tmp_path))
    raw = tables["measures"].withColumn("divisions", F.col("divisions").cast("long")).withColumn(
        "divisions", F.when(F.col("divisions") == 3, large[0]).when(F.col("divisions") == 5, large[1]).otherwise(F.col("divisions")))
    parsed = J.parse_scores(tables["elements"], raw, tables["layout"])
    hits = parsed.hits.orderBy("score_id", "onset").collect()
    assert [{k: v for k, v in r.asDict().items() if k != "score_id"} for r in hits] == want and all(r.score_id.endswith("good.xml") for r in hits)
    report = [(r.score_id.rsplit("/", 1)[1], r.code) for r in parsed.quality.collect()]
    assert ("bad.xml", "tick-base-too-large") in report and ("good.xml", "tick-base-too-large") not in report


def test_score_without_notes_is_reported(spark, tmp_path):
    (tmp_path / "rests.xml").write_bytes(score([measure("1", note(4, rest=True), divisions=1, time=(4, 4))]))
    tables = musicxml.read_scores(spark, str(tmp_path))
    report = J.parse_scores(tables["elements"], tables["measures"], tables["layout"]).quality.collect()
    assert "no-note-coordinates" in {r.code for r in report}


def test_scores_without_stacks_or_columns_keep_their_measures(spark, project):  # noqa: F811
    framework, verdicts = reconcile.framework_gaps(measures(spark, "z", 3), spark.createDataFrame([("a", 2)], "score_id string, stacks int"))
    assert framework.count() == 3 and {r.score_id: r.rejection for r in verdicts.collect()} == {"a": reconcile.NOT_NUMERIC, "z": None}

    both = measures(spark, "a", 2).unionByName(measures(spark, "z", 3))
    symbolic = spark.createDataFrame([("a", 1, 2, 6, 1, ["C4"]), ("z", 0, 1, 1, 1, ["D4"])], "score_id string, measure_index int, offset long, onset long, source_count long, pitches array<string>")
    out = J.canonical_scores(project, both, symbolic)
    kept = {}
    for r in out.measures.collect():
        kept.setdefault(r.score_id, []).append(Fraction(r.full, r.tpq))
    assert kept == {"a": [4, 4], "z": [4, 4, 4]}
    assert {r.score_id for r in out.hits.collect()} == {"a"}
    codes = {(r.score_id, r.code) for r in out.quality.collect()}
    assert codes == {("z", "no-recovered-columns"), ("z", "no-usable-attacks"), ("z", "fewer-stacks-than-measures"), ("a", "begin-time-unreadable")}
    assert out.stats.collect()[0].canonical_hit_count == 7


def test_events_before_the_epoch(spark):
    rows = [(1, datetime(2023, 12, 20, 5), 7, "click", 3.0), (2, datetime(2024, 1, 9, 6), 7, "view", 2.0), (3, datetime(2023, 12, 25, 12), 8, "click", 1.0), (4, datetime(2024, 1, 9, 6), 9, "view", 2.0)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    hits = {(r.score_id, r.measure_index) for r in E.event_hits(events).collect()}
    assert hits == {(7, -12), (7, 8), (8, -7), (9, 8)}
    days = {}
    for r in E.event_measures(events).collect():
        days.setdefault(r.score_id, []).append((r.measure_index, r.start, r.full, r.num, r.den))
    assert [d[0] for d in sorted(days[7])] == list(range(-12, 9)) and [d[0] for d in sorted(days[8])] == [-7] and len(days[9]) == 9
    for own in days.values():
        at = 0
        for _, start, full, num, den in sorted(own):
            assert start == at and full == num * 4 * E.TPQ // den and (num, den) in ((4, 4), (3, 4), (6, 8))
            at += full


def test_deep_levels_keep_their_parent(spark):
    rows = [(0, t, 0, t, low, low, [low], 0) for t, low in enumerate([3, 12, 11, 12])]
    wave = spark.createDataFrame(rows, "score_id long, onset long, measure_index int, offset long, height int, lowest_level int, levels array<int>, segment_index int")
    nodes = profiles.tree(wave, Scan(("score_id",), profiles.POINT_ORDER)).collect()
    assert {r.onset: r.parent.onset if r.parent else None for r in nodes} == {0: None, 1: 0, 2: 0, 3: 2}


@pytest.mark.parametrize("text, want", [("3/4", Fraction(3, 4)), ("1e2", 100), ("1.5e-2", Fraction(15, 1000)), ("-2.50E1", -25), (" .5 ", Fraction(1, 2)), ("7", 7), ("1e-18", None), ("1e30", None),
                                        ("9" * 25, None), ("1/0", None), (".", None), ("e5", None), ("abc", None), ("1e-17", Fraction(1, 10**17)), ("0.0000000000000000001e3", Fraction(1, 10**16))])
def test_rational_spellings(spark, text, want):
    got = spark.range(1).select(parse_rational(F.lit(text)).alias("r")).first().r
    assert (Fraction(got.num, got.den) if got else None) == want


def test_runs_from_another_folder(tmp_path):
    """Python stages find the package on the workers whatever the working folder; files are decoded once."""
    import os
    import subprocess
    import sys

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.XML").write_bytes(score([measure("1", note(1, C4), divisions=1, time=(4, 4))]))
    (tmp_path / "in" / "b.pdf").write_bytes(b"no score")
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from pulsegrid.session import build_session\nfrom pulsegrid.sources import musicxml\n"
            "spark = build_session('other', master='local[2]', shuffle_partitions=2)\n"
            f"t = musicxml.read_scores(spark, {str(tmp_path / 'in')!r})\n"
            "plans = [df._jdf.queryExecution().executedPlan().toString() for df in t.values()]\n"
            "print('SEEN', t['elements'].count(), t['rejected'].count(), sum('MapInPandas' in p for p in plans))\n"
            "import __spark_entry__ as E\nprint('CHAIN', E.queries()['anchor_chain'](spark, '/root/testdata/sf0.001').count() > 0)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "SEEN 1 0 0" in out.stdout and "CHAIN True" in out.stdout, out.stdout + out.stderr[-3000:]


def test_chords_before_the_epoch_meet_their_stacks(spark):
    from pulsegrid.plans.event_scores import notation_graph
    from pulsegrid.plans.events import read_events

    days = [f"2023-12-{d} 10:00:00" for d in range(22, 32)] + ["2024-01-02 10:00:00"]
    one = read_events(spark, "/root/testdata/sf0.001").limit(1)
    events = one.withColumn("ts", F.explode(F.array(*[F.lit(d).cast("timestamp_ntz") for d in days])))
    graph = notation_graph(events)
    key = ["score_id", "page_index", "system_index", "stack_ord"]
    met = graph["chords"].join(graph["stacks"].select(*key), key).select("page_index", "stack_ord").collect()
    assert sorted((r["page_index"], r["stack_ord"]) for r in met) == [(d // 7, d % 7) for d in [*range(-10, 0), 1]]

"""Recognised projects to columns, hits, registrations and page layout."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import columns as C
from pulsegrid.operators import layout, reconcile, register
from pulsegrid.operators import pages as P
from pulsegrid.plans import scores as J
from pulsegrid.sources import recognition, sinks
from tests.scores import zipped_names


def box(x, y, w=20, h=20):
    return f'<bounds x="{x}" y="{y}" w="{w}" h="{h}"/>'


def chord(cid, x, shape="NOTEHEAD_BLACK", y=100, stem=True):
    head = f'<head id="h{cid}" shape="{shape}">{box(x - 10, y)}</head>'
    body = f'<head-chord id="{cid}" staff="1">{box(x - 10, y - 60, 20, 80)}</head-chord>{head}'
    rels = rel(cid, f"h{cid}", "containment")
    if stem:
        body += f'<stem id="s{cid}"><median><p1 x="{x}" y="{y - 60}"/><p2 x="{x}" y="{y}"/></median></stem>'
        rels += rel(cid, f"s{cid}", "chord-stem")
    return body, rels


def rel(source, target, kind, **attrs):
    extra = "".join(f' {k}="{v}"' for k, v in attrs.items())
    return f'<relation source="{source}" target="{target}"><{kind}{extra}/></relation>'


def entries(pairs):
    return "".join(f'<entry><key>{slot}</key><value chord="{c}" status="{status}"/></entry>' for slot, c, status in pairs)


def sheet():
    objects, relations = "", ""
    for cid, x in (("1", 100), ("2", 200), ("3", 300), ("4", 400)):
        o, r = chord(cid, x)
        objects, relations = objects + o, relations + r
    specs = (("5", 600, "NOTEHEAD_VOID", 100), ("6", 800, "NOTEHEAD_BLACK", 100), ("7", 850, "NOTEHEAD_BLACK", 100), ("8", 604, "NOTEHEAD_VOID", 180))
    for cid, x, shape, y in specs:
        o, r = chord(cid, x, shape, y)
        objects, relations = objects + o, relations + r
    objects += '<beam id="b1"/><slur id="u1" tie="true"/><augmentation-dot id="d1"/><rest id="rr" shape="QUARTER_REST"/>' + f'<rest-chord id="r1" staff="1">{box(890, 100)}</rest-chord>'
    objects += f'<rest id="rw" shape="WHOLE_REST"/><rest-chord id="r2" staff="2">{box(700, 300)}</rest-chord>'
    relations += rel("b1", "s6", "beam-stem") + rel("b1", "s7", "beam-stem") + rel("u1", "h8", "slur-head", side="RIGHT") + rel("r1", "rr", "containment") + rel("r2", "rw", "containment")
    relations += rel("d1", "h4", "augmentation") + rel("u1", "h5", "slur-head", side="LEFT")
    slots = "".join(f'<slot id="{i + 1}" time-offset="{t}" x-offset="{100 * i}"/>' for i, t in enumerate(("0", "1/4", "1/2", "3/4")))
    stacks = f'<stack id="A" left="50" right="500">{slots}</stack><stack id="B" left="550" right="950"><slot id="1" time-offset="0" x-offset="50" suspicious="true"/><slot id="2" time-offset="oops" x-offset="9"/></stack>'
    one = f'<measure><head-chords>1 2 3 4</head-chords><voice><slots>{entries([("1", "1", "BEGIN"), ("2", "2", "BEGIN"), ("3", "3", "BEGIN"), ("2", "4", "BEGIN")])}</slots></voice></measure>'
    two = f'<measure><head-chords>5 6 7 8 6</head-chords><rest-chords>r1 r2</rest-chords><voice><slots>{entries([("1", "5", "BEGIN"), ("1", "8", "CONTINUE")])}</slots></voice></measure>'
    system = f"<system>{stacks}<part>{one}{two}</part><sig><inters>{objects}</inters><relations>{relations}</relations></sig></system>"
    return f'<sheet><interline main="20"/><page>{system}</page></sheet>'.encode()


MEASURES = "score_id string, measure_index int, measure_number string, num int, den int, tpq long, full long, actual long, pickup_shift long, implicit boolean, opening_anacrusis boolean, start long"


def measures(spark, score, count, tpq=1, numbers=None, meters=None):
    rows, start = [], 0
    for i in range(count):
        num, den = (meters or {}).get(i, (4, 4))
        full = num * 4 * tpq // den
        rows.append((score, i, (numbers or [str(n + 1) for n in range(count)])[i], num, den, tpq, full, full, 0, False, False, start))
        start += full
    return spark.createDataFrame(rows, MEASURES)


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("omr")
    (folder / "a.omr").write_bytes(zipped_names([("sheet#1/sheet#1.xml", sheet()), ("book.xml", b"<book/>")]))
    (folder / "c.omr").write_bytes(zipped_names([("sheet#1/sheet#1.xml", sheet()), ("sheet#2/sheet#2.xml", b"<broken")]))
    (folder / "b.omr").write_bytes(b"no archive")
    tables = recognition.read_projects(spark, str(folder))
    for name, df in tables.items():
        df.write.parquet(str(folder / "t" / name))
    return {name: spark.read.parquet(str(folder / "t" / name)).withColumn("score_id", F.lit("a")) for name in tables}


@pytest.fixture(scope="module")
def columns(spark, project, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("columns"))
    J.C.recover_columns(project["objects"], project["relations"], project["stacks"], project["slots"], project["chords"], project["entries"], measures(spark, "a", 2)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_project_tables(project):
    errors = sorted(r.error for r in project["rejected"].collect())
    assert len(errors) == 2 and errors[1].startswith("ValueError: sheet 2 (sheet#2/sheet#2.xml)")
    assert [(r.page_index, r.interline) for r in project["sheets"].collect()] == [(0, 20.0)]
    rows = sorted(sinks.slot_rows(project["stacks"], project["slots"]).collect(), key=lambda r: (r.global_measure_index, r.slot_ord))
    assert [(r.global_measure_index, r.time_offset_quarter, r.x_abs, r.suspicious) for r in rows] == [(0, "0", 50, False), (0, "1", 150, False), (0, "2", 250, False), (0, "3", 350, False), (1, "0", 600, True)]


def test_columns(columns):
    rows = sorted(columns.collect(), key=lambda r: (r.measure_index, r.column_index))
    q = lambda v, r: Fraction(v, r.tpq)
    # Chord 4 claims the time of chord 2: the chain keeps 1, 2, 3 and the last column is placed by its x.
    assert [(r.x_abs, q(r.onset, r), q(r.duration, r), r.timing_source) for r in rows if r.measure_index == 0] == [
        (100.0, 0, 1, C.BEGIN_ANCHOR), (200.0, 1, 1, C.BEGIN_ANCHOR), (300.0, 2, 1, C.BEGIN_ANCHOR), (400.0, 3, Fraction(3, 2), C.INTERPOLATED)]
    second = [r for r in rows if r.measure_index == 1]
    assert [(q(r.onset, r), q(r.duration, r), r.attack, r.rest, r.tie_continuation_only) for r in second] == [
        (0, 2, True, False, False), (Fraction(1, 2), Fraction(1, 2), True, False, False), (1, Fraction(1, 2), True, False, False), (Fraction(3, 2), 1, False, True, False)]
    assert [e.tie_continuation for e in second[0].notation_events] == [False, True] and second[0].chord_ids == ["5", "8"]
    assert [r.confidence for r in rows][:4] == pytest.approx([0.92, 0.92, 0.92, 0.72])
    stats = C.column_stats(columns).collect()[0]
    assert (stats.column_count, stats.attack_column_count, stats.rest_column_count, stats.exact_attack_geometry_column_count) == (8, 7, 1, 7)


def test_canonical_hits_and_levels(spark, columns):
    symbolic = spark.createDataFrame([("a", 1, 2, 1, ["C4"]), ("a", 1, 3, 2, ["D4"])], "score_id string, measure_index int, offset long, source_count long, pitches array<string>").withColumn("onset", F.col("offset"))
    hits = C.canonical_hits(columns, measures(spark, "a", 2), symbolic)
    rows = sorted(hits.collect(), key=lambda r: r.onset)
    assert [Fraction(r.onset, r.tpq) for r in rows] == [0, 1, 2, 3, 4, Fraction(9, 2), 5]
    assert [r.source_count for r in rows] == [0] * 7 and all(r.canonical_recovered for r in rows)
    framed = J.rescaled(measures(spark, "a", 2), columns)
    events, _ = J.analyze_levels(hits, framed)
    assert [r.levels for r in sorted(events.collect(), key=lambda r: r.onset)][:3] == [[1], [1], [1, 2]]


@pytest.mark.parametrize("numbers,stacks,meters,want", [
    (["1", "2", "4"], 4, None, None), (["1", "2", "4"], 5, None, reconcile.NOT_COVERING), (["1", "2", "4"], 4, {2: (3, 4)}, reconcile.CONFLICTING_METERS),
    (["1", "x", "4"], 4, None, reconcile.NOT_NUMERIC), (["1", "4", "3"], 4, None, reconcile.NOT_INCREASING), (["1", "2", "4"], 2, None, None), (["7", " 8 ", "10"], 4, None, None)])
def test_framework(spark, numbers, stacks, meters, want):
    counts = spark.createDataFrame([("a", stacks), ("empty", 2)], "score_id string, stacks int")
    framework, verdicts = reconcile.framework_gaps(measures(spark, "a", 3, numbers=numbers, meters=meters), counts)
    found = {r.score_id: r for r in verdicts.collect()}
    assert found["a"].rejection == want and found["empty"].rejection == reconcile.NOT_NUMERIC
    rows = sorted(framework.collect(), key=lambda r: r.measure_index)
    if want:
        assert rows == []
    elif stacks == 4:
        assert [(r.measure_index, r.old_index, r.synthesized, r.start) for r in rows] == [(0, 0, False, 0), (1, 1, False, 4), (2, None, True, 8), (3, 2, False, 12)]
        assert rows[2].measure_number == str(int(numbers[0]) + 2)
        hits = spark.createDataFrame([("a", 2, 1, 9), ("a", 7, 0, 0)], "score_id string, measure_index int, offset long, onset long")
        moved, unknown = reconcile.remap_hits(hits, framework)
        assert [(r.measure_index, r.onset) for r in moved.collect()] == [(3, 13)] and unknown.count() == 1
    else:
        assert len(rows) == 3 and "fewer-stacks-than-measures" in {r.code for r in reconcile.framework_warnings(verdicts).collect()}


def test_layout_and_overlay(spark, project, columns, tmp_path):
    heads = "".join(f'<Symbol id="n{i}" shape="noteheadBlack" interline="10"><Bounds x="{x}" y="{y}" w="12" h="10"/></Symbol>' for i, (x, y) in enumerate(
        [(94, 95), (95, 100), (194, 95), (294, 95), (394, 95), (594, 95), (794, 100), (100, 500), (200, 505)]))
    page = f'<Page><Image>img/Page-1.PNG</Image><Size w="1000" h="1000"/></Page>{heads}<Symbol shape="clef"><Bounds x="1" y="1" w="5" h="5"/></Symbol>'
    (tmp_path / "x.annotations.zip").write_bytes(zipped_names([("a.xml", f"<Doc>{page}</Doc>".encode()), ("bad.xml", b"<"), ("other/page-1.png", b""), ("z.png", b"")]))
    notes = {k: v.withColumn("score_id", F.lit("a")) for k, v in recognition.read_annotations(spark, str(tmp_path)).items()}
    assert notes["symbols"].count() == 9
    sizes = spark.createDataFrame([("a", 0, 2000.0, 2000.0)], "score_id string, page_index int, width double, height double")
    expected = spark.createDataFrame([("a", 0, 2)], "score_id string, page_index int, expected_systems int")
    pages = notes["pages"].join(sizes, ["score_id", "page_index"])
    assert [r.member for r in layout.page_images(notes["pages"], notes["members"]).collect()] == ["other/page-1.png"]
    groups = sorted(layout.physical_groups(notes["symbols"], pages, expected).collect(), key=lambda r: (r.system_index, r.group_index))
    assert [(g.system_index, g.heads, g.cx) for g in groups] == [(0, 2, 201.0), (0, 1, 400.0), (0, 1, 600.0), (0, 1, 800.0), (0, 1, 1200.0), (0, 1, 1600.0), (1, 1, 212.0), (1, 1, 412.0)]
    bounds = sorted(layout.system_bounds(layout.physical_groups(notes["symbols"], pages, expected), pages).collect(), key=lambda r: r.system_index)
    assert (bounds[0].top_norm, bounds[0].bottom_norm, bounds[0].guard_bottom_norm) == pytest.approx((0.095, 0.11, 0.305))

    framed = J.rescaled(measures(spark, "a", 2), columns)
    hits = C.canonical_hits(columns, framed)
    events, _ = J.analyze_levels(hits.withColumns({"source_count": F.lit(1), "pitches": F.array(F.lit("x"))}), framed)
    canonical = J.CanonicalScores(framed, columns, hits, C.column_stats(columns), None)
    placed = J.overlay(events, J.profile(events), canonical, notes, expected, sizes)
    anchors = sorted(placed.anchors.collect(), key=lambda r: r.onset)
    assert [r.recovered_x_abs for r in anchors] == [100.0, 200.0, 300.0, 400.0, 600.0, 800.0, 850.0] and all(r.reason is None for r in anchors)
    assert anchors[0].cx_norm == pytest.approx(0.05) and anchors[0].cy_norm == pytest.approx(0.055)
    stats = {r.level: r for r in placed.stats.collect()}
    assert stats[0].expected == sum(r.density for r in anchors) == stats[0].mapped and stats[0].missing == 0
    assembled = J.page_assembly(placed).collect()[0]
    assert (assembled.layer_anchors, assembled.wave_anchors, assembled.tree_nodes, assembled.system_bounds) == (7, 7, 7, 2)
    documents = sorted(J.page_documents(placed, 5).collect(), key=lambda r: r.document)
    pieces = [p for r in documents for p in r.pieces]
    assert [len(r.pieces) for r in documents[:-1]] == [5] * (len(documents) - 1) and [p.place for p in pieces] == list(range(len(pieces)))
    kinds = [p.kind for p in pieces]
    assert kinds == sorted(kinds, key=list(P.ORDERS).index) and [kinds.count(k) for k in ("bounds", "layer", "wave", "node")] == [2, 7, 7, 7]
    assert [(p.system_index, p.first, p.second) for p in pieces if p.kind == "layer"] == [(r.system_index, r.measure_index, r.offset) for r in anchors]
    assert register.unregistered_stats(events).filter("level = 0").collect()[0].missing == stats[0].expected
    assert sinks.column_audit(columns).count() == 8
    audit = {r.measure_index: r for r in C.measure_audit(columns, project["stacks"]).collect()}
    assert sum(r.physical_column_count for r in audit.values()) == 8 and all(r.full_duration_quarter == "4" for r in audit.values())
    for r in audit.values():
        assert r.begin_columns + r.chain_columns + r.interpolated_columns == r.physical_column_count and r.semantic_anchors[0].asDict() == {"column": 0, "grid_index": 0}
        assert len(r.semantic_anchors) == r.semantic_anchor_count and set(r.semantic_anchors) <= set(r.timing_anchors) and r.stack_left is not None
    assert sinks.audit_documents(C.measure_audit(columns, project["stacks"])).count() == len(audit)
    outcome = register.reason_stats(placed.anchors).collect()
    assert [(r.outcome, r.events, r.labels) for r in outcome] == [("mapped", 7, stats[0].expected)]
    documents = sinks.placement_documents(layer=placed.anchors, wave=placed.wave, branch=placed.branches)
    assert documents.filter("kind = 'layer'").count() == 7 and documents.filter("page_index IS NULL").count() == 0
    summary = sinks.score_summary(framed, events).collect()[0]
    assert (summary.measure_count, summary.hit_count, summary.analysis_hit_source) == (2, 7, "canonical-score-time") and summary.max_level == max(summary.levels_enabled)


def test_staff_frames(spark):
    lines = [100 + 10 * k for k in range(5)] + [300 + 10 * k for k in range(5)] + [700]
    rows = [("a", 0, y + d, 0.5 if d == 0 else 0.45) for y in lines for d in (0, 1)] + [("a", 0, y, 0.01) for y in range(900) if not any(y in (v, v + 1) for v in lines)]
    frames = sorted(layout.staff_frames(spark.createDataFrame(rows, "score_id string, page_index int, y int, dark_fraction double")).collect(), key=lambda r: r.center)
    assert [(f.center, f.spacing) for f in frames] == [(120.5, 10.0), (320.5, 10.0)]
    pages = spark.createDataFrame([("a", 0, 1000.0, 900.0)], "score_id string, page_index int, width double, height double")
    expected = spark.createDataFrame([("a", 0, 2)], "score_id string, page_index int, expected_systems int")
    out = spark.createDataFrame([("a", 0, f.center, f.spacing, f.line_top, f.line_bottom) for f in frames], "score_id string, page_index int, center double, spacing double, line_top double, line_bottom double")
    bands = sorted(layout.frame_bands(out, pages, expected).collect(), key=lambda r: r.system_index)
    assert [(b.top, b.bottom) for b in bands] == [(82.5, 158.5), (282.5, 358.5)]


def test_newest_exports(spark, tmp_path):
    import os

    for name, age in (("s/a.xml", 10), ("s/b.mxl", 500), ("s/c.mxl", 100), ("t/d.xml", 5), ("t/e.txt", 1)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    assert sorted(r.path.rsplit("/", 1)[1] for r in recognition.newest_exports(spark, str(tmp_path)).collect()) == ["c.mxl", "d.xml"]


def test_heads_find_their_column_in_one_pass(spark):
    """Against every (head, column) pair; equal centres, single heads and several systems; the plan holds no join."""
    at = [(s, float(x)) for s, xs in ((0, [5, 6, 6, 7.5, 20, 21, 40]), (1, [3]), (2, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])) for x in xs]
    rows = [("a", 0, s, f"n{k}", x - 2, 0.0, 4.0, 8.0, 10.0, x, 4.0) for k, (s, x) in enumerate(at)]
    heads = spark.createDataFrame(rows, "score_id string, page_index int, system_index int, symbol_id string, x double, y double, w double, h double, interline double, cx double, cy double")
    columns = layout.attack_columns(heads)
    edges = [(r.system_index, r.first_value, r.last_value, r.column_index) for r in columns.collect()]
    found = layout.column_members(heads, columns)
    got = sorted((r.system_index, r.symbol_id, r.column_index) for r in found.collect())
    assert got == sorted((s, r[3], c) for r in rows for s, a, b, c in edges if s == r[2] and a <= r[9] <= b) and len(got) == len(at)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan

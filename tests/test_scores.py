"""Score files to attacks, hits, measures and warnings."""

from fractions import Fraction

import pytest

from pulsegrid.operators.scan import CHUNK, HOT_ROWS_CONF
from pulsegrid.operators.segments import meter_segments
from pulsegrid.plans import scores as J
from pulsegrid.sources import musicxml
from tests.scores import measure, move, note, score, zipped_names

C4, D4, E4, G4 = ("C", 0, 4), ("D", 0, 4), ("E", 0, 4), ("G", 1, 4)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("scores")
    plain = score([
        measure("0", note(2, C4), divisions=2, time=(4, 4), implicit=True, width=200),
        measure("1", note(2, C4), note(2, E4, chord=True), note(0, D4, grace=True), note(2, D4, ties=["start"]), note(4, rest=True),
                move("backup", 8), note(8, G4, voice="2"), width=300),
        measure("2", note(2, D4, ties=["stop", "start"]), note(6, D4, ties=["stop"]), width=300, printed='<print new-system="yes"/>'),
        measure("3", note(4, D4, ties=["stop"]), note(4, E4), time=(3, 4), width=250, printed='<print new-page="yes"/>'),
    ], [
        measure("0", note(3, C4), divisions=3), measure("1", note(4, C4, tuplet=(3, 2)), note(4, C4, tuplet=(3, 2)), note(4, "unpitched", tuplet=(3, 2))),
        measure("2", note(12, C4)),
    ])
    (folder / "plain.musicxml").write_bytes(plain)
    one = score([measure("1", note(1, C4, x=10, y=-5), note(1, C4), note(2, D4), divisions=1, time=(4, 4), symbol="cut",
                         bar='<barline location="right"><bar-style>heavy-light</bar-style></barline>')])
    container = b'<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="inner/score.xml"/></rootfiles></container>'
    (folder / "packed.mxl").write_bytes(zipped_names([("other.xml", b"<x/>"), ("META-INF/container.xml", container), ("inner/score.xml", one)]))
    (folder / "bare.mxl").write_bytes(zipped_names([("META-INF/x.xml", b"<x/>"), ("only.xml", one)]))
    (folder / "bad.xml").write_bytes(b"<score-timewise/>")
    (folder / "broken.xml").write_bytes(b"<score")
    tables = musicxml.read_scores(spark, str(folder))
    musicxml.save_tables(tables, str(folder / "tables"))
    return musicxml.load_tables(spark, str(folder / "tables"))


@pytest.fixture(scope="module")
def parsed(corpus):
    return J.parse_scores(corpus["elements"], corpus["measures"], corpus["layout"])


def of(df, name):
    return [r for r in df.collect() if r.score_id.endswith(name)]


def test_rejections(corpus):
    assert sorted(r.score_id.rsplit("/", 1)[1] for r in corpus["rejected"].collect()) == ["bad.xml", "broken.xml"]


def test_measures(parsed):
    rows = sorted(of(parsed.measures, "plain.musicxml"), key=lambda r: r.measure_index)
    q = lambda r, c: Fraction(r[c], r.tpq)
    assert [(r.measure_number, q(r, "start"), q(r, "full"), q(r, "actual"), q(r, "pickup_shift"), f"{r.num}/{r.den}") for r in rows] == [
        ("0", 0, 4, 1, 3, "4/4"), ("1", 4, 4, 4, 0, "4/4"), ("2", 8, 4, 4, 0, "4/4"), ("3", 12, 3, 4, 0, "3/4")]
    packed = of(parsed.measures, "packed.mxl")[0]
    assert (packed.num, packed.den, packed.opening_anacrusis) == (2, 2, True)


def test_hits_and_ties(parsed):
    rows = sorted(of(parsed.hits, "plain.musicxml"), key=lambda r: r.onset)
    tpq = of(parsed.measures, "plain.musicxml")[0].tpq
    got = [(Fraction(r.onset, tpq), Fraction(r.duration, tpq), r.measure_index, Fraction(r.offset, tpq), r.source_count, r.pitches) for r in rows]
    third = Fraction(4, 3)
    assert got == [
        (Fraction(3), 1, 0, 3, 2, ["C4"]),
        (Fraction(4), 4, 1, 0, 4, ["C4", "E4", "G#4"]),
        # The grace note moves the chord onset but takes no time; the tied D4 lasts through measure 2.
        (Fraction(5), 1 + 1 + 3, 1, 1, 1, ["D4"]),
        (4 + third, third, 1, third, 1, ["C4"]),
        (4 + 2 * third, third, 1, 2 * third, 1, ["unpitched"]),
        (Fraction(8), 4, 2, 0, 1, ["C4"]),
        (Fraction(14), 2, 3, 2, 1, ["E4"]),
    ]
    assert [t.actual for t in rows[3].tuplets] == [3]


def test_quality(parsed):
    codes = {(r.score_id.rsplit("/", 1)[1], r.code) for r in parsed.quality.collect()}
    assert ("plain.musicxml", "unmatched-tie-stop") in codes
    assert ("plain.musicxml", "part-length-differs") in codes
    assert ("plain.musicxml", "no-note-coordinates") in codes
    assert ("packed.mxl", "meter-symbol-normalised") in codes
    assert ("packed.mxl", "no-note-coordinates") not in codes


def test_override(corpus):
    forced = J.parse_scores(corpus["elements"], corpus["measures"], corpus["layout"], meter_override="3/4")
    assert {(r.num, r.den) for r in of(forced.measures, "packed.mxl")} == {(3, 4)}
    assert "meter-override" in {r.code for r in of(forced.quality, "packed.mxl")}


def test_layout(parsed):
    rows = sorted(of(parsed.layouts, "plain.musicxml"), key=lambda r: r.measure_index)
    assert [(r.page_index, r.system_index, r.x_start, r.system_top) for r in rows] == [(0, 0, 80.0, 180.0), (0, 0, 280.0, 180.0), (0, 1, 80.0, 400.0), (1, 0, 80.0, 180.0)]
    attack = [r for r in of(parsed.attacks, "packed.mxl") if r.x_norm is not None]
    assert len(attack) == 1 and attack[0].x_norm == pytest.approx(90 / 1190) and attack[0].y_norm == pytest.approx(185 / 1684)


def test_visual_groups(parsed):
    groups = [r for r in of(J.visual_groups(parsed), "plain.musicxml") if r.measure_index == 1]
    kinds = sorted((r.visual_kind, r.onset, [(p.pitch, p.n) for p in r.pitches], r.analyzed) for r in groups)
    assert [k[0] for k in kinds] == ["grace", "main", "main", "main", "main"]
    assert kinds[1][2] == [("C4", 2), ("E4", 1), ("G#4", 1)]
    tied = [r for r in of(J.visual_groups(parsed), "plain.musicxml") if r.measure_index == 2]
    assert sorted(r.analyzed for r in tied) == [False, True]
    assert all(r.layout_known for r in groups)


def test_levels_end_to_end(parsed):
    events, segments = J.analyze_levels(parsed.hits, parsed.measures)
    segs = sorted(of(segments, "plain.musicxml"), key=lambda r: r.segment_index)
    assert [(s.num, s.den, s.start_measure_index, s.end_measure_index) for s in segs] == [(4, 4, 0, 2), (3, 4, 3, 3)]
    rows = sorted(of(events, "plain.musicxml"), key=lambda r: r.onset)
    assert all(r.levels for r in rows if r.tpq and (r.onset * 3) % r.tpq)
    from pulsegrid.sources import sinks

    reported = [r for r in sinks.segment_rows(segments, events).collect() if r.score_id.endswith("plain.musicxml") and r.segment_index == 0][0]
    assert (reported.meter, reported.beat_unit_name, reported.segment_end_quarter, reported.explicit_tuplet_ratios) == ("4/4", "quarter note", "12", ["3:2"])
    onsets = {r.onset_quarter for r in sinks.event_rows(events).collect() if r.score_id.endswith("plain.musicxml")}
    assert {"3", "16/3", "20/3", "14"} <= onsets
    derived = J.profile(events)
    assert derived.nodes.count() == derived.wave.count()
    assert sinks.score_documents(segments, events).count() == segments.count()
    assert J.analysis_quality(events, segments).count() >= 1


def test_hot_scores_give_the_same(spark, corpus, parsed):
    """Chunked scans over elements, measures and notes change nothing."""
    spark.conf.set(HOT_ROWS_CONF, "3")
    try:
        hot = J.parse_scores(corpus["elements"], corpus["measures"], corpus["layout"])
        rows = lambda df: sorted(repr(r) for r in df.select(*sorted(c for c in df.columns if c != CHUNK)).collect())
        assert CHUNK in hot.measures.columns
        assert rows(hot.measures) == rows(parsed.measures)
        assert rows(hot.hits) == rows(parsed.hits)
        assert rows(hot.layouts) == rows(parsed.layouts)
        assert rows(meter_segments(hot.measures)) == rows(meter_segments(parsed.measures))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)

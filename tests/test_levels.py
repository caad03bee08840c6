"""Grid folds and refinement against plain recursion."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grid import child_level, grid_position, grid_top, point_levels
from pulsegrid.operators import levels as L, votes
from tests import brute


@pytest.mark.parametrize("base,tops", [(2, [1, 2, 4, 16, 64, 128]), (3, [1, 3, 9, 27, 81]), (5, [5, 25])])
def test_grid_fold_equals_recursion(spark, base, tops):
    for top in tops:
        points, spans = brute.grid(top, base)
        df = spark.range(top + 1).select("id", grid_position(F.col("id"), F.lit(top), F.lit(base)).alias("g"))
        for row in df.collect():
            assert row.g.levels == sorted(points[row.id]), (base, top, row.id)
            assert row.g.span == spans.get(row.id), (base, top, row.id)


def test_grid_top(spark):
    rows = spark.range(1, 200).select("id", *[grid_top(F.lit(b), F.col("id")).alias(f"b{b}") for b in (2, 3)]).collect()
    for r in rows:
        assert (r.b2, r.b3) == (brute.top_of(r.id, 2), brute.top_of(r.id, 3))


@pytest.mark.parametrize("factor", [2, 3, 5, 7, 11])
def test_local_structure(spark, factor):
    points, spans = brute.grid(factor, factor)
    f, k = F.lit(factor), F.col("id").cast("int")
    for r in spark.range(factor + 1).select("id", point_levels(f, k).alias("p"), child_level(f, k).alias("c")).collect():
        assert set(r.p) == points[r.id]
        assert r.id == factor or r.c == spans[r.id]


def random_segments(seed, n, tuplets, canonical, dense=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        compound = rng.random() < 0.4
        base = rng.choice([2, 3])
        beats = rng.randint(1, 9)
        width = rng.choice([96, 48, 64, 60, 840, 7, 720])
        ticks = sorted({rng.randrange(beats * width) for _ in range(rng.randint(1, 14))} | ({0} if rng.random() < 0.5 else set()))
        hits = {}
        for t in ticks:
            marks = set()
            if tuplets and rng.random() < 0.6:
                for _ in range(rng.randint(1, 2)):
                    actual = rng.choice([2, 3, 5, 6, 7, 4])
                    normal = rng.choice([2, 3, 4])
                    marks.add((actual, normal, rng.choice([width // actual, width // (2 * actual), 5])))
            hits[t] = {"tuplets": marks, "canonical": canonical and rng.random() < 0.7}
        if tuplets and rng.random() < 0.7:
            beat, actual = rng.randrange(beats), rng.choice([3, 5, 7])
            if width % actual == 0:
                for k in range(actual):
                    hits[beat * width + k * width // actual] = {"tuplets": {(actual, 2, width // actual)}, "canonical": False}
        out.append((i, beats, width, base, compound, hits))
    return out


def to_frame(spark, segments, tuplets, canonical):
    rows = []
    for sid, beats, width, base, compound, hits in segments:
        start = 1000 * sid
        for t, mark in hits.items():
            rows.append((f"s{sid}", 0, start + t, start, start + beats * width, width, base, compound, sorted(mark["tuplets"]), mark["canonical"]))
    schema = ("score_id string, segment_index int, onset long, segment_start long, segment_end long, beat_ticks long, top_base int, "
              "compound boolean, tuplets array<struct<actual:int,normal:int,duration:long>>, canonical_recovered boolean")
    df = spark.createDataFrame(rows, schema)
    if not tuplets:
        df = df.drop("tuplets")
    return df if canonical else df.drop("canonical_recovered")


def check(segments, result):
    got = {}
    notes = {}
    for r in result.collect():
        got.setdefault(r.score_id, {})[r.onset] = r
        notes.setdefault(r.score_id, set()).update("depth" if n.startswith("depth") else n for n in r.notes)
    for sid, beats, width, base, compound, hits in segments:
        want, want_notes = brute.segment_levels(beats, width, base, compound, hits)
        rows = got[f"s{sid}"]
        assert len(rows) == len(hits)
        for t, levels in want.items():
            r = rows[1000 * sid + t]
            assert r.levels == sorted(levels), (sid, t, beats, width, base, compound, sorted(hits))
            assert (r.height, r.density, r.lowest_level) == (max(levels, default=0), len(levels), min(levels, default=0))
        assert notes[f"s{sid}"] == want_notes, (sid, hits)


@pytest.mark.parametrize("tuplets,canonical", [(False, False), (True, False), (False, True), (True, True)])
def test_refinement_equals_recursion(spark, tuplets, canonical):
    segments = random_segments(7, 150, tuplets, canonical)
    check(segments, L.refine(to_frame(spark, segments, tuplets, canonical)))


def test_defaults_and_votes_agree(spark, monkeypatch):
    segments = random_segments(11, 80, True, True)
    for s in segments:
        for mark in s[5].values():
            mark["tuplets"], mark["canonical"] = set(), False
    monkeypatch.setattr(L, "is_irregular", lambda rows: F.lit(True))
    check(segments, L.refine(to_frame(spark, segments, True, True)))


def test_hand_golden(spark):
    hits = {t: {"tuplets": set(), "canonical": False} for t in (0, 2, 3, 4)}
    out = {r.onset: r.levels for r in L.refine(to_frame(spark, [(0, 4, 2, 2, False, hits)], False, False)).collect()}
    assert out == {0: [1], 2: [1, 2], 3: [2], 4: [1, 2]}


def test_votes_take_one_written_table(spark, monkeypatch):
    """tuplet_levels, tuplet_notes: all rounds of a beat run in one task, so what is written does not depend on their number."""
    written = []
    monkeypatch.setattr(L, "write_table", lambda df, name, write=L.write_table: (written.append(name), write(df, name))[1])
    segments = random_segments(3, 20, True, True)
    check(segments, L.refine(to_frame(spark, segments, True, True)))
    assert written == ["beat-rows"]


def test_batches_are_cut_between_beats():
    rows = pa.record_batch({
        "score_id": ["a", "a", "a", "a", "b", None, None], "segment_index": pa.array([0, 0, 0, 1, 1, 1, 1], pa.int32()), "_beat": [0, 0, 1, 1, 1, 1, 1], "beat_ticks": [60] * 7, "compound": [False] * 7,
        "_side": ["S"] * 7, "_rel": [20, 40, 12, 30, 30, 12, 24], "_cap": pa.array([8] * 7, pa.int32()), "_parent": pa.array([1] * 7, pa.int32()),
        "tuplets": pa.array([[{"actual": 3, "normal": 2, "duration": 20}], [{"actual": 3, "normal": 2, "duration": None}], None, [], [{"actual": 6, "normal": 4, "duration": 10}],
                             [{"actual": 5, "normal": 4, "duration": 12}], [{"actual": 5, "normal": None, "duration": 12}]],
                            pa.list_(pa.struct([("actual", pa.int32()), ("normal", pa.int32()), ("duration", pa.int64())]))),
    })
    keys = ("score_id", "segment_index", "_beat")
    beats = [b.column("_rel").to_pylist() for b, _ in votes.whole_beats([rows.slice(k, 1) for k in range(7)], keys)]
    assert beats == [[20, 40], [12], [30], [30], [12, 24]]
    got = lambda batches: [r for b in votes.voted(iter(batches), keys, ("score_id", "_rel")) for r in b.to_pylist()]
    whole = got([rows])
    assert whole == got([rows.slice(k, 1) for k in range(7)]) == got([rows.slice(0, 0), rows.slice(0, 3), rows.slice(3)])
    assert whole[0]["_levels"] == [2, 3] and "composite:6:4" in whole[4]["_note"]

"""Positions by Level, from events to blocks and back."""

import random

from pyspark.sql import functions as F

from pulsegrid.operators import level_index


def frame(spark):
    rng = random.Random(8)
    rows = []
    for score in range(6):
        for segment in range(3):
            onsets = sorted({rng.randrange(-3000 if score == 5 else 0, 40_000) for _ in range(rng.randint(1, 200))})
            rows += [(f"s{score}", segment, t, sorted(rng.sample(range(1, 7), rng.randint(0, 4)))) for t in onsets]
    rows += [("hot", 0, t, [1]) for t in range(5000)]
    return rows, spark.createDataFrame(rows, "score_id string, segment_index int, onset long, levels array<int>")


def test_lists_restore_all_positions(spark):
    rows, events = frame(spark)
    index = level_index.build(events)
    want = sorted((s, g, level, t) for s, g, t, levels in rows for level in levels)
    assert sorted(map(tuple, level_index.positions(index).collect())) == want
    sizes = index.agg(F.max("positions").alias("most"), F.sum("positions").alias("all"), F.count_if(F.exists("deltas", lambda d: (d < 0) | (d > level_index.BLOCK)))).first()
    assert sizes.most == level_index.BLOCK and sizes["all"] == len(want) and sizes[2] == 0
    assert index.filter("score_id = 'hot'").count() == 5


def test_ranges_read_only_their_blocks(spark):
    rows, events = frame(spark)
    index = level_index.build(events)
    for start, end, highest in ((0, 1, None), (1000, 5000, 2), (-500, 1024, None), (39_000, 90_000, 6)):
        got = sorted(map(tuple, level_index.between(index, start, end, highest).collect()))
        assert got == sorted((s, g, level, t) for s, g, t, levels in rows for level in levels if start <= t < end and level <= (highest or 99))

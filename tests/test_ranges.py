"""Range lookup against a plain search, for any mix of range lengths and tick bases."""

import random

from pyspark.sql import functions as F

from pulsegrid.operators.ranges import cover, range_lookup


def test_lookup_against_search(spark):
    rng = random.Random(4)
    ranges, points = [], []
    for key in range(12):
        scale = 8 ** (key % 6) * (1 + key)
        at = -50 * scale if key % 4 == 3 else 0
        for i in range(rng.randint(1, 30)):
            length = rng.choice([0, 1, 3, 8, 64, 100, 5000]) * scale
            ranges.append((key, i, at, at + length))
            at += length + rng.choice([0, 0, scale])
        ranges.append((key, 99, at - 3 * scale, at + 400 * scale))  # ranges may overlap
        points += [(key, rng.randint(-60 * scale, at + 500 * scale)) for _ in range(60)] + [(key, r[2]) for r in ranges if r[0] == key] + [(key, r[3]) for r in ranges if r[0] == key]
    points.append((77, 5))
    r = spark.createDataFrame(ranges, "k int, i int, a long, b long")
    p = spark.createDataFrame(points, "k int, t long")
    got = sorted(map(tuple, range_lookup(p, r, ["k"], "t", "a", "b").select("k", "t", "i").collect()))
    assert got == sorted((k, t, i) for k, t in points for q, i, a, b in ranges if q == k and a <= t < b)


def test_rows_of_a_range_do_not_grow_with_the_tick_base(spark):
    lengths = [1, 7, 8, 100, 65_536, 1 << 18, 1 << 30, (1 << 40) + 12345, 1 << 62]
    df = spark.createDataFrame([(n, s, s + n) for n in lengths for s in (0, 1, 12_345_678_901)], "n long, a long, b long").filter("b > a")
    most = {r.n: r.m for r in cover(df, "a", "b").groupBy("n", "a").count().groupBy("n").agg(F.max("count").alias("m")).collect()}
    assert set(most) == set(lengths)
    assert all(m <= (9 if n < 1 << 18 else 65) for n, m in most.items()) and most[1 << 30] >= 8


def test_one_width_is_one_row_per_point(spark):
    """Segments of like length ask each point once; the lookup stays an equi-join."""
    ranges = spark.range(50).select((F.col("id") % 5).alias("k"), (F.col("id") * 100).alias("a"), (F.col("id") * 100 + 100).alias("b"))
    points = spark.range(5000).select((F.col("id") % 5).alias("k"), F.col("id").alias("t"))
    found = range_lookup(points, ranges, ["k"], "t", "a", "b")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == 1000

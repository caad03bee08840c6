"""Gcd per key in bounded folds, against math.gcd."""

import random
from math import gcd

from pyspark.sql import functions as F

from pulsegrid.operators import quantum


def test_gcd_against_plain(spark, monkeypatch):
    rng = random.Random(6)
    rows = []
    for key in range(60):
        step = rng.choice([1, 2, 7, 30, 1024, 99_991])
        rows += [(key, step * rng.randint(1, rng.choice([3, 100, 10**6]))) for _ in range(rng.randint(1, 40))]
    rows += [(100, 0), (100, -4), (101, None), (102, 12), (102, 0), (103, 2**62), (103, 2**61), (None, 9), (None, 6)]
    want = {}
    for key, v in rows:
        if v is not None and v > 0:
            want[key] = gcd(want.get(key, 0), v)
    df = spark.createDataFrame(rows, "k int, v long")
    for folded in (1024, 4):
        monkeypatch.setattr(quantum, "FOLDED", folded)
        assert {r.k: r.g for r in quantum.gcd_by(df, ["k"], "v", "g").collect()} == want


def test_folds_are_bounded(spark):
    """One key with every value up to a million: no fold sees more than two blocks' worth of values."""
    df = spark.range(1, 1_000_001).select(F.lit(1).alias("k"), (F.col("id") * 6).alias("v"))
    level = df.select("k", F.col("v").alias("_v"))
    for width in (quantum.FOLDED, quantum.FOLDED**2):
        sized = level.groupBy("k", F.call_function("div", F.col("_v"), F.lit(width)).alias("b")).agg(F.collect_set("_v").alias("s"))
        assert sized.agg(F.max(F.size("s"))).first()[0] <= 2 * quantum.FOLDED
        level = sized.select("k", quantum.gcd_of(F.col("s")).alias("_v"))
    assert quantum.gcd_by(df, ["k"], "v").first()["gcd"] == 6

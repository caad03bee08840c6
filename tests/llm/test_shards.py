import math
import struct
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from pulsegrid.llm import shards


def hashed(path, key):
    """64-bit hash chained over path and key, the way the native function chains its arguments (seed 42)."""
    seed = xxhash.xxh64(path.encode(), seed=42).intdigest()
    return seed if key is None else xxhash.xxh64(struct.pack("<q", key), seed=seed).intdigest()


def descend(key, node, path=""):
    while node.children:
        live = [c for c in node.children if c.weight > 0]
        draw = {c.name: -math.log(1.0 - (hashed(f"{path}/{c.name}", key) >> 11) * 2.0**-53) / c.weight for c in live}
        node = min(live, key=lambda c: draw[c.name])
        path = f"{path}/{node.name}"
    return node.shard


def test_placement_against_descent(spark):
    keys = [None, *range(-20, 2000), 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    weights = {0: 2.0, 5: 0.5, 7: 0.0}
    got = {r["doc_id"]: r for r in shards.assign(shards.assign(df, "doc_id", 9, "nine"), "doc_id", 8, "eight", weights).collect()}
    for k in keys:
        assert got[k]["nine"] == descend(k, shards.tree(9))
        assert got[k]["eight"] == descend(k, shards.tree(8, weights))
    assert 7 not in {r["eight"] for r in got.values()}


def test_growth_and_weights_move_only_what_they_must(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    for n in range(1, 14):
        df = shards.assign(df, "doc_id", n, f"s{n}")
    df = shards.assign(df, "doc_id", 8, "heavy", {6: 2.0})
    rows = df.collect()
    for n in range(8, 13):
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in rows)
        assert all(0.7 < c * n / 20000 < 1.3 for c in Counter(r[f"s{n}"] for r in rows).values())
    for r in rows:  # rows move into the heavier subtrees only: region of 4..7, then the rack of 6 and 7, then shard 6
        a, b = r["s8"], r["heavy"]
        if a // 4 != b // 4:
            assert b // 4 == 1
        elif a // 2 != b // 2:
            assert b // 2 == 3
        elif a != b:
            assert b == 6


def test_numbers_are_gapless_with_ties_nulls_and_copies(spark):
    rows = [(None, 1, "a")] * 500 + [(i % 37, i % 5, "b") for i in range(900)] + [(7, 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, _copies long, extra string").withColumn("shard", F.when(F.col("doc_id") != 3, F.col("doc_id") % 3).cast("int"))
    old, shards.BUCKET_ROWS = shards.BUCKET_ROWS, 50
    try:
        got = shards.number(df, "shard", ["doc_id", "_copies"]).collect()
    finally:
        shards.BUCKET_ROWS = old
    assert Counter((r["doc_id"], r["_copies"], r["extra"]) for r in got) == Counter(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.number(df.limit(0), "shard", ["doc_id"]).count() == 0


def test_query(spark):
    import zlib

    import duckdb

    from pulsegrid.llm.queries import QUERIES

    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = QUERIES["op9_hash_tree_shards"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == descend(r["doc_id"], shards.tree(8)) and r["grown_shard"] in (r["shard"], 8)

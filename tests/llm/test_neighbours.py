import duckdb
import numpy as np
from pyspark.accumulators import AccumulatorParam

from pulsegrid.llm import neighbours


class MostOf(AccumulatorParam):
    def zero(self, value):
        return value

    def addInPlace(self, a, b):
        return max(a, b)


def exact(ids, x, query, own, k=10):
    d = np.sqrt(((x - query) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != own][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_query_recall(spark):
    from pulsegrid.llm.queries import QUERIES

    for sf in ("sf0.01", "sf0.1"):
        rows = duckdb.sql(f"select vec_id, embedding from '/root/testdata/{sf}/embeddings.parquet'").fetchall()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        got = {}
        for r in QUERIES["op6_nearest_vectors"](spark, f"/root/testdata/{sf}").collect():
            got.setdefault(r["query_id"], []).append(r)
        assert sorted(got) == sorted(int(i) for i in ids if i % 100 == 0)
        hits = 0
        for q, own in got.items():
            own.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 11)) and own == sorted(own, key=lambda r: (r["score"], r["vec_id"]))
            where = {int(i): k for k, i in enumerate(ids)}
            for r in own:
                assert r["vec_id"] != q and abs(r["score"] - np.sqrt(((x[where[r["vec_id"]]] - x[where[q]]) ** 2).sum())) < 1e-12
            hits += len({r["vec_id"] for r in own} & {i for i, _ in exact(ids, x, x[where[q]], q)})
        assert hits / (10 * len(got)) >= 0.95


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.1]), (9, [1.0, 0.1]), (None, [1.0, 0.0]), (100, None), (200, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, dim string")
    got = neighbours.search(df, df.filter("vec_id % 100 = 0"), "vec_id", "embedding", 4)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert {q: sorted(v) for q, v in by.items()} == {0: [(1, 200), (2, 1), (3, 9), (4, 9)], 200: [(1, 0), (2, 1), (3, 9), (4, 9)]}
    assert neighbours.search(df.limit(0), df, "vec_id", "embedding").count() == 0


def test_far_and_identical_vectors(spark):
    rows = [(i, [float(i % 3), 5.0, -2.0]) for i in range(60)] + [(1000 + i, [1e6 * i, 1.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = neighbours.search(df, df.filter("id in (0, 1019)"), "id", "v", 25).collect()
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 0), key=lambda r: r["rank"])][:19] == list(range(3, 60, 3))
    assert sorted((r for r in got if r["query_id"] == 1019), key=lambda r: r["rank"])[0]["vec_id"] == 1018


def test_no_row_holds_a_block(spark, monkeypatch):
    """Rows on their way to and from the workers stay small however many vectors there are; results as from brute force, over cells, blocks and copies."""
    frame = type(spark.range(0))
    most, plain = spark.sparkContext.accumulator(0, MostOf()), frame.mapInArrow

    def seen(batches):
        for b in batches:
            most.add(max(b.nbytes // max(1, b.num_rows), b.nbytes if b.num_rows == 1 else 0))
            yield b

    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema, *a, **b: plain(self, lambda batches: seen(f(seen(batches))), schema, *a, **b))
    x = np.random.RandomState(3).standard_normal((16_000, 24)).astype(np.float32)
    x[1::5] = x[0::5]  # pairs of equal vectors
    x[9000:9020] = x[7]  # and one that is met often: ties go to the smaller id
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<float>").repartition(5)
    for kind in ("float", "double"):
        given = df.withColumn("v", df.v.cast(f"array<{kind}>"))
        got = {}
        for r in neighbours.search(given, given.filter("id in (0, 7, 999, 9001, 15999)"), "id", "v").collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        hits = 0
        for q in (0, 7, 999, 9001, 15999):
            want = exact(ids, x.astype(float), x[q].astype(float), q)
            hits += len({(v, s) for _, v, s in got[q]} & set(want))
            assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        assert hits >= 48 and [v for _, v, _ in sorted(got[7])] == list(range(9000, 9010))
    assert 0 < most.value <= 2 << 20


def test_blocks_of_extreme_vectors():
    """Overflowing, tiny and far-off vectors lose nothing to rounding."""
    rng = np.random.RandomState(4)
    near, k = rng.standard_normal((3000, 8)), 10
    for scale, shift in ((1.0, 0.0), (1e-25, 0.0), (1e30, 0.0), (1.0, 1e5), (1e-200, 0.0), (1e160, 0.0)):
        for kind in ("<f4", "<f8"):
            with np.errstate(over="ignore", under="ignore"):
                x = (near * scale + shift).astype(kind)
            if not np.isfinite(x).all() or not x.any():
                continue
            ids, cell = np.arange(len(x)), neighbours.Cell(8)
            cell.add(ids, x)
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                found = cell.search(ids[:20], x[:20].astype("<f8"), k).to_pydict()
                d = [np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)) for q in range(20)]
            assert len(found["query_id"]) == 20 * k
            hits = sum(s <= np.sort(np.delete(d[q], q))[k - 1] for q, s in zip(found["query_id"], found["score"], strict=True))
            assert hits >= 0.95 * 20 * k, (scale, shift, kind, hits)

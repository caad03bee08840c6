import hashlib

import duckdb
import numpy as np
import pytest

from pulsegrid.llm import centroids


def plain(rows, k, rounds, scale=64, salt=1):
    """(id, cluster, distance) of kept rows and the centroids, with Python's integers and every distance."""
    kept = [(i, [int(np.floor(scale * x)) if abs(x) < 2**50 else int(x) * scale for x in v]) for i, v in rows]
    digest = lambda i: (i is None, hashlib.sha256(f"{salt}:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted((repr(i), nearest(v)[1], nearest(v)[0]) for i, v in kept), centres


def found(spark, rows, dim, k, rounds):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string")
    got, centres = centroids.cluster(df, "vec_id", "embedding", k, rounds, dim)
    return sorted((repr(r["id"]), r["cluster"], r["distance"]) for r in got.collect()), [[int(x) for x in c] for c in centres]


def test_against_all_distances(spark):
    rng = np.random.default_rng(7)
    for dim, k, rounds, spread in ((2, 7, 6, 0.2), (3, 16, 4, 3.0), (8, 5, 3, 0.02), (1, 3, 5, 1.0)):
        middles = rng.normal(0, 1, (6, dim))
        rows = [(i, (middles[i % 6] + spread * rng.normal(0, 1, dim)).round(2).tolist()) for i in range(250)]
        rows += rows[:20]
        assert found(spark, rows, dim, k, rounds) == plain(rows, k, rounds)


def test_bounds_save_measurements_and_change_nothing():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (40, 8))[rng.integers(0, 40, 3000)] * 64 + rng.normal(0, 3, (3000, 8))).astype(np.int64)
    centres = x[:24].copy()
    m = centroids.Memory(np.zeros(3000, np.int64), np.ones(3000, np.int64), np.full(3000, np.inf), np.zeros(3000))
    moved, measured = np.zeros(24), []
    for _ in range(6):
        search = centroids.Search(centres, moved)
        search.assign(x, m)
        every = np.stack([((x - c) ** 2).sum(axis=1) for c in centres])
        assert (m.cluster == every.argmin(axis=0)).all()
        own = np.sqrt(every[m.cluster, np.arange(3000)])
        every[m.cluster, np.arange(3000)] = every.max() + 1
        assert (m.upper >= own).all() and (m.lower <= np.sqrt(every.min(axis=0))).all()
        measured.append(search.measured)
        new = np.stack([x[m.cluster == c].sum(axis=0) // max(1, (m.cluster == c).sum()) if (m.cluster == c).any() else centres[c] for c in range(24)])
        moved, centres = np.sqrt(((new - centres) ** 2).sum(axis=1)) + 1e-9, new
    assert measured[0] < 3000 * 24 * 0.9 and measured[-1] < 3000 * 24 * 0.3


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (None, [0.1, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0, None]), (6, [1.0]), (7, []), (8, [0.5, 0.5]), (9, [-0.01, 0.0])]
    good = [r for r in rows if r[0] in (1, None, 8, 9)]
    assert found(spark, rows, 2, 16, 3) == plain(good, 16, 3)
    assert found(spark, rows, 2, 2, 3) == plain(good, 2, 3)
    assert found(spark, rows, 2, 1, 3) == plain(good, 1, 3)
    assert found(spark, [(2, None)], 2, 3, 3) == ([], [])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster(df, "vec_id", "embedding")[0].count() == 0


def test_huge_components_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 2) * 10.0 ** rng.integers(0, 12)).tolist()) for i in range(80)] + [(100, [1e300, -1e300]), (101, [1.7e308, 3e5])]
    want, centres = plain(rows, 4, 2)
    assert found(spark, rows, 2, 4, 2) == ([(i, c, d if d < 2**63 else None) for i, c, d in want], centres)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    from pulsegrid.llm.queries import ORACLES, QUERIES

    duckdb.sql(f"create or replace view embeddings as select * from '/root/testdata/{sf}/embeddings.parquet'")
    rel = duckdb.sql(ORACLES["op12_centroid_clusters"])
    got = QUERIES["op12_centroid_clusters"](spark, f"/root/testdata/{sf}")
    assert sorted(map(tuple, got.select(rel.columns).collect())) == sorted(rel.fetchall())

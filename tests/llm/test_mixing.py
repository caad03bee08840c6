import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_stop_at_twice_the_size():
    sizes = {"b": 10, "a": 1000, None: 500, "c": 5}
    got = mixing.targets(sizes)
    assert list(got) == ["a", "b", "c", None]
    assert got["b"] == 20 and got["c"] == 10
    assert got["a"] + got[None] == pytest.approx(1.5 * 1515 - 30) and got["a"] == pytest.approx(got[None]) and got["a"] <= 2000 and got[None] <= 1000 or got[None] == 1000
    assert sum(got.values()) == pytest.approx(1.5 * 1515)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def best_cost(patterns, quotas):
    """Largest flow and its least cost, by trying every split of every pattern."""
    best = (0, 0)
    options = []
    for members, size in patterns.values():
        options.append([s for s in itertools.product(range(2 * size + 1), repeat=len(members)) if sum(s) <= 2 * size])
    for choice in itertools.product(*options):
        used = dict.fromkeys(quotas, 0)
        for (members, _), split in zip(patterns.values(), choice, strict=True):
            for m, n in zip(members, split, strict=True):
                used[m] += n
        if all(used[q] <= quotas[q] for q in quotas):
            cost = sum(sum(s) + 2 * max(0, sum(s) - size) for (_, size), s in zip(patterns.values(), choice, strict=True))
            best = max(best, (sum(map(sum, choice)), -cost))
    return best


def test_flow_is_largest_and_cheapest():
    r = random.Random(4)
    for _ in range(25):
        quotas = {q: r.randint(0, 6) for q in "ab"}
        patterns = {"[a]": (["a"], r.randint(1, 3)), "[a,b]": (["a", "b"], r.randint(1, 3)), "[b]": (["b"], r.randint(1, 2))}
        got = mixing.flow(patterns, quotas)
        assert all(sum(f.get(q, 0) for f in got.values()) <= quotas[q] for q in quotas)
        total = {p: sum(f.values()) for p, f in got.items()}
        cost = sum(n + 2 * max(0, n - patterns[p][1]) for p, n in total.items())
        assert (sum(total.values()), -cost) == best_cost(patterns, quotas)


def test_query(spark):
    from pulsegrid.llm.queries import QUERIES

    docs = {i: (len(WORD.findall(t or "")), s) for i, t, s in duckdb.sql(f"select doc_id, text, source from '{SF}/documents.parquet'").fetchall()}
    got = QUERIES["op5_source_mix"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op5_source_mix"](spark, SF).collect()))
    sizes = {}
    for n, s in docs.values():
        sizes[s] = sizes.get(s, 0) + n
    goal, taken = mixing.targets(sizes), {}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n, s = docs[r["doc_id"]]
        assert (r["size"], r["source_size"], r["target"]) == (n, sizes[s], goal[s])
        assert r["taken"] in (0, n, 2 * n)
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 0.01 * goal[s] + 5 for s in goal)


def test_overlap_edge_rows_and_ranges(spark):
    r = random.Random(8)
    rows = [(i, " ".join("w" * r.randint(1, 40)), r.choice([["a"], ["a", "b"], ["b", "a"], ["c", None], [None], [], None])) for i in range(400)]
    rows += [(None, "one two", ["a"])] * 50 + [(1, None, ["a"]), (2, "", ["b"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>").withColumn("place", F.lit("x"))
    old, mixing.RANGE_ROWS = mixing.RANGE_ROWS, 50
    try:
        got = mixing.mix(df, F.col("sources"), [F.col("doc_id")]).collect()
    finally:
        mixing.RANGE_ROWS = old
    assert len(got) == len(rows) and {r["place"] for r in got} == {"x"}
    assert all(0 <= r["copies"] <= 2 for r in got) and not any(r["copies"] for r in got if not r["sources"] or not r["text"])
    words = sum(len(r["text"].split()) * r["copies"] for r in got if r["text"])
    made = mixing.plan(df.select(mixing.pattern_of(F.col("sources")).alias("pattern"), mixing.order_of(F.col("doc_id")).alias("place"), mixing.count_words(F.col("text")).alias("size")))
    assert abs(words - sum(n for f in made.flows.values() for n in f.values())) <= 60
    assert mixing.mix(df.limit(0), F.col("sources"), [F.col("doc_id")]).count() == 0
    twice = mixing.repeated(spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "id long, n int"), "n").collect()
    assert sorted(r["id"] for r in twice) == [1, 1, 3]


def first_fit(rows, rest):
    """Sizes taken one by one in the order of (place, size), each as long as it fits."""
    out = []
    for place, size in sorted(rows):
        if 0 < size <= rest:
            out.append((place, size))
            rest -= size
    return out, rest


def test_rest_is_filled_until_nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 300)
    r = random.Random(5)
    straddled = [(i << 50, 100_000 if i == 500 else 100) for i in range(1001)]
    repeated = [(7 << 50, 7)] * 40
    falling = [(i << 50, 1 if i % 2 == 0 else 90 - i) for i in range(80)]
    mixed = [(r.randrange(60) << 55, r.choice([0, 1, 2, 5, 30, 400])) for _ in range(500)]
    for rows, rest in ((straddled, 99_000), (repeated, 150), (falling, 95), *[(mixed, n) for n in (333, 1234, 9999)]):
        df = spark.createDataFrame([('["a"]', p, s) for p, s in rows], "pattern string, place long, size long").repartition(5)
        made = mixing.plan(df, share=(rest + 0.01) / sum(s for _, s in rows))
        got = mixing.copies(df, made, "pattern", "place", "size", "copies").filter("copies > 0").collect()
        assert len(got) > 0 and all(x["copies"] == 1 for x in got)
        assert sorted((x["place"], x["size"]) for x in got) == first_fit(rows, rest)[0]
    assert first_fit(straddled, 99_000)[1] == 0

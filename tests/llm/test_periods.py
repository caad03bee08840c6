import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings, strategies as st

from pulsegrid.llm import periods

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words):
    """From the definition: all maximal stretches of every period, less those of a smaller period."""
    codes = np.array([hash(w) for w in words], np.int64)
    found = []
    for q in range(1, len(words) // 4 + 1):
        agree = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        for start, stop in zip(np.flatnonzero(~agree[:-1] & agree[1:]), np.flatnonzero(agree[:-1] & ~agree[1:]), strict=True):
            length = int(stop - start) + q
            own = words[start:start + length]
            if length >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.append((int(start), length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def library(texts):
    codes, vocabulary = periods.coded([t.encode() for t in texts])
    runs, owner = periods.runs_of(codes)
    own = [[tuple(r) for r, o in zip(runs.tolist(), owner.tolist(), strict=True) if o == i] for i in range(len(texts))]
    return own, [periods._collapsed(c, np.array(r, np.int64).reshape(-1, 3), vocabulary) for c, r in zip(codes, own, strict=True)]


chunk = st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 9), st.text("abcd", max_size=4)).map(lambda x: x[0] * x[1] + x[2])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(chunk, max_size=6).map("".join), min_size=1, max_size=5))
def test_runs_against_definition(letters):
    texts = [" ".join(t) for t in letters]
    runs, collapsed = library(texts)
    for text, r, c in zip(letters, runs, collapsed, strict=True):
        assert r == plain_runs(list(text)) and c == plain_collapse(list(text), r)


def test_long_periods_and_blocks_across_pieces(monkeypatch):
    monkeypatch.setattr(periods, "PIECE", 64)
    rng = random.Random(5)
    texts = []
    for n in (37, 90, 411):
        head, unit = [[f"w{rng.randrange(3000)}" for _ in range(k)] for k in (50, n)]
        texts.append("\t".join([*head, *(unit * 5)[: 4 * n + n // 3], *head]))
    texts.append("z" * 500 + " " + "tick tock " * 300)
    runs, collapsed = library(texts)
    for text, r, c in zip(texts, runs, collapsed, strict=True):
        assert r == plain_runs(text.split()) and c == plain_collapse(text.split(), r)
    assert [r[0][1:] for r in runs] == [(160, 37), (390, 90), (1781, 411), (600, 2)]


def test_rare_words_split_until_nothing_is_left():
    rng = np.random.default_rng(3)
    words = np.minimum(rng.zipf(1.3, 20000), 5000).astype(np.int32)
    places, segment = periods.survivors(words, np.zeros(len(words), np.int64))
    assert len(places) < len(words) // 4
    for s in range(segment.max(initial=-1) + 1):
        own = places[segment == s]
        assert (np.diff(own) == 1).all() and len(own) >= 6 and np.unique(words[own], return_counts=True)[1].min() >= 4


def test_edge_rows_and_clashing_names(spark):
    text = "a b " * 4 + "c"
    rows = [(1, None, 5), (2, "", 5), (3, " \t\n", 5), (4, text, 5), (4, text, 5), (None, "x y " * 6, 5), (5, "q " * 400_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = periods.find(df, "text")
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert by == {1: [([], "")], 2: [([], "")], 3: [([], "")], 4: [([(0, 8, 2)], "a b c")] * 2, None: [([(0, 6, 1)], "x y")], 5: [([(0, 400_000, 1)], "q")]}
    assert periods.find(df.limit(0), "text").collect() == []


def test_query_against_definition(spark):
    from pulsegrid.llm.queries import QUERIES

    want = {}
    for doc, text in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall():
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[doc] = (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{s},{k},{q}\n" for s, k, q in runs)), digest(plain_collapse(words, runs)))
    got = QUERIES["op13_period_runs"](spark, "/root/testdata/sf0.001")
    assert got.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    rows = got.collect()
    assert len(rows) == len(want) and {r[0]: tuple(r[1:]) for r in rows} == want
    assert sum(w[0] > 0 for w in want.values()) >= 10

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from pulsegrid.llm import quality, words
from pulsegrid.llm.common import slices

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if grams[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), sum(lines.index(x) < i for i, x in enumerate(lines)), len(covered)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab \n\t#é\r😀", max_size=60), st.lists(st.sampled_from(["a", "b", "a b c d e f g h", "\n"]), max_size=30).map(" ".join)), max_size=6))
def test_counts_against_plain_python(texts):
    counts, features = quality.statistics(pa.array(texts, pa.string()))
    assert counts.tolist() == [counted(t) for t in texts]
    assert np.isfinite(features).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \nç", max_size=30), max_size=6), st.integers(1, 5), st.booleans())
def test_shingle_sets(texts, size, lower):
    got, n = words.shingle_sets(words.Texts(pa.array(texts, pa.string()), lower=lower), size)
    sets = []
    for t in texts:
        found = WORD.findall(t.replace("B", "b") if lower else t)
        sets.append({tuple(found[i:i + size]) for i in range(len(found) - size + 1)} or ({tuple(found)} if found else set()))
    assert n.tolist() == [len(s) for s in sets]
    at = np.concatenate([[0], np.cumsum(n)])
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(set(got[at[i]:at[i + 1]]) & set(got[at[j]:at[j + 1]])) == len(sets[i] & sets[j])


def test_trees_learn_keep_order_and_match_plain_descent():
    r = np.random.RandomState(1)
    x = r.rand(3000, 4)
    y = ((x[:, 0] < 0.6) & (x[:, 1] + 0.2 * r.randn(3000) > 0.3)).astype(float)
    forest = quality.fit(x, y, {0: -1, 2: -1})
    p = forest.score(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.85
    for row in x[:50]:
        raw = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.feature[node]] <= forest.threshold[node] else forest.right[node]
            raw += forest.value[node]
        assert abs(1 / (1 + np.exp(-raw)) - forest.score(row[None])[0]) < 1e-12
    for f in (0, 2):
        grid = np.repeat(x[:200, None], 20, axis=1)
        grid[:, :, f] = np.linspace(-0.1, 1.1, 20)
        assert (np.diff(forest.score(grid.reshape(-1, 4)).reshape(200, 20), axis=1) <= 1e-12).all()


def test_query_counts_and_verdict(spark):
    from pulsegrid.llm.queries import QUERIES

    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    got = QUERIES["op4_quality_rules"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = counted(docs[r["doc_id"]])
        assert [r[c] for c in quality.COUNTS] == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in got if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(q == k for q, k in judged) / len(judged) > 0.97


def test_edge_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "w " * 5000, 3), (3, " ".join(f"word{i}" for i in range(40)), 4)], "doc_id long, text string, verdict int")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    kept = quality.keep(docs, none).collect()
    assert [(r["doc_id"], r["verdict"]) for r in kept] == [(3, 4)]
    assert quality.judge(docs, None).count() == 5
    assert quality.keep(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 0), (3, 1)], "doc_id long, quality int")
    assert {r["doc_id"] for r in quality.keep(docs, labels).collect()} <= {3}


def test_texts_are_measured_in_small_slices():
    """Pipeline: what a worker holds while it measures stays small, and the figures do not depend on the slices."""
    texts = pa.array([f"line {i} of words\n" * (i % 7) + "a b c d e f g h " * (i % 5) for i in range(60)] + [None, ""])
    parts = [quality.statistics(b.column("t")) for b in slices([pa.record_batch([texts], names=["t"])], "t", 300)]
    whole = quality.statistics(texts)
    assert len(parts) > 3 and all((np.concatenate([p[k] for p in parts]) == whole[k]).all() for k in (0, 1))
    assert quality.SLICE <= 512 << 10

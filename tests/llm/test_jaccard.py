import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from pulsegrid.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, size, per_cent):
    """Sets, links between different rows, components; by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall(lowered(text))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    inverted = {}
    for i, s in enumerate(sets):
        for g in s:
            inverted.setdefault(g, []).append(i)
    near, parent = set(), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in inverted[g]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= per_cent * (len(s) + len(sets[j]) - both):
                near.add((i, j))
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sets, near, [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def check(spark, rows, size=3, per_cent=90):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, token int").repartition(5)
    rule = jaccard.Rule(size, per_cent)
    sets, near, want = brute(rows, size, per_cent)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, jaccard.components(df, "doc_id", "text", rule).collect()), key=key) == sorted(want, key=key)
    joined = jaccard.join(df, "doc_id", "text", rule)
    named = {frozenset(sets[i]) for i in range(len(rows)) if sets[i]}
    assert joined.docs.filter("n > 0").select("class").distinct().count() == len(named)
    different = {frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in near if sets[i] != sets[j]}
    assert joined.links.count() == len(different)


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_families_chains_and_boilerplate(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    plain = " ".join(word() for _ in range(60))
    texts = []
    for n in (2, 8, 60):
        texts += family(r, " ".join(word() for _ in range(r.randint(60, 160))), n, 4)
    chain = [word() for _ in range(140)]
    texts += [" ".join(chain[i:i + 80]) for i in range(0, 60, 2)]
    texts += [" ".join(word() for _ in range(50)) + " " + plain for _ in range(40)] + [plain] * 30 + [plain.upper()] * 3
    texts += ["a b", "A  b", "a b c", "a", "", None, None, " \n", "é é é é", "a b c d"]
    check(spark, [(i * 7 % 1009, t) for i, t in enumerate(texts)])
    check(spark, [(i * 7 % 1009, t) for i, t in enumerate(texts)], 5, 80)


def test_null_and_repeated_ids(spark):
    same = " ".join(f"w{i}" for i in range(40))
    check(spark, [(None, same), (None, same), (5, same), (5, same + " more"), (None, "only null id here"), (None, "only null id here"), (9, None), (9, None)])
    assert jaccard.components(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", jaccard.Rule(3, 90)).count() == 0


def test_query(spark):
    from pulsegrid.llm.queries import ORACLES, QUERIES
    from tests.compare import connect

    for sf in ("sf0.001", "sf0.01"):
        rows = duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet'").fetchall()
        got = sorted(map(tuple, QUERIES["op1_ngram_jaccard"](spark, f"/root/testdata/{sf}").collect()))
        assert got == sorted(brute(rows, 3, 90)[2]) == sorted(connect(f"/root/testdata/{sf}").sql(ORACLES["op1_ngram_jaccard"]).fetchall())


def test_rows_without_a_verdict_are_not_shuffled(spark):
    """Of keep_one's rows only those that may be copies meet the verdicts; the texts of all others stay in the task that read them."""
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:5] + [None, "", " "])] + [(7, texts[7])], "doc_id long, text string")
    kept = jaccard.keep_one(rows, "doc_id", "text", jaccard.Rule(3, 90))
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id < 45) == sorted(enumerate(texts[:40]))
    assert kept.count() == 43
    plain = kept._jdf.queryExecution().sparkPlan().children().head().toString()
    assert "Join" not in plain and "Scan" in plain


def test_sets_are_made_in_small_slices_and_memory_is_handed_back(monkeypatch):
    """Pipeline: a worker outlives its task, so what it held at most is what counts against the executor."""
    texts = pa.array([" ".join(f"w{(k * j) % 97}" for j in range(90)) for k in range(40)] + [None, "", "a b"])
    batch, given = pa.record_batch([texts], names=["text"]), []
    monkeypatch.setattr(jaccard, "give_back", lambda: given.append(1))
    assert jaccard.SLICE <= 512 << 10

    def made(limit):
        monkeypatch.setattr(jaccard, "SLICE", limit)
        found = [(hashes, counts, names) for _, hashes, counts, names in jaccard._sets([batch], jaccard.Rule(5, 80))]
        return len(found), [np.concatenate(x).tolist() for x in zip(*found, strict=True)]

    (whole, want), (cut, got) = made(1 << 20), made(700)
    assert whole == 1 < cut and got == want and len(given) == 2

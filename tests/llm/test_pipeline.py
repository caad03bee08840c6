import duckdb

import corpus_pipeline
from pulsegrid.llm import jaccard, mixing, quality
from pulsegrid.llm.common import table, write_once
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import base
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept."""
    from pulsegrid.llm.tokens import Encoder, default_path

    docs, kept = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = write_once(stage(spark, docs, SF), "test-pipeline")
        assert docs.columns == corpus_pipeline.COLUMNS, name
        kept.append({(r["doc_id"], r["text"]): r for r in docs.collect()} if name != "mixing sources" else docs.collect())
    source = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    after_quality, after_join, after_secrets, after_mix = kept

    judged = {r["doc_id"]: r["verdict"] for r in quality.judge(table(spark, SF, "documents"), quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))).collect()}
    assert {d for d, _ in after_quality} == {d for d, v in judged.items() if v["kept"]} and all(source[d] == t for d, t in after_quality)
    assert sum(labels.get(d) == 0 for d, _ in after_quality) <= 0.02 * len(labels)

    rows = sorted(after_quality)
    want = {d for d, _, least in brute(rows, 5, 80)[2] if d == least}
    assert {d for d, _ in after_join} == want

    assert sorted(d for d, _ in after_secrets) == sorted(want)
    assert not any(base(t) for _, t in after_secrets)
    assert all(("[SECRET]" in t) or t == source[d] for d, t in after_secrets)

    sizes = {}
    for (_, t), r in after_secrets.items():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len((t or "").split())
    goal, taken, times = mixing.targets(sizes), dict.fromkeys(sizes, 0), {}
    for r in after_mix:
        assert (r["doc_id"], r["text"]) in after_secrets
        taken[r["source"]] += len((r["text"] or "").split())
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2 and all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 5 for s in goal)

    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    n, bound = check_packing(Encoder(default_path()), [(r["doc_id"], r["text"]) for r in after_mix], got, 1024)
    assert n <= bound * 1.02 + 1


def test_run_applies_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_near_duplicates_with_null_and_repeated_rows(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(None, same), (5, same), (5, same), (8, same + " x"), (None, "no other like this one here at all"), (9, None), (10, ""), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(5, same), (9, ""), (10, ""), (0, ""), (0, rows[4][1])])
    assert jaccard.components(df, "doc_id", "text", corpus_pipeline.NEAR_DUPLICATE).count() == len(rows)


def test_near_duplicates_keep_one_row_of_each_component(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    same, other, lone = words("s"), words("o"), words("l")
    rows = [(None, same, "a")] * 3 + [(None, same, "b"), (None, same + " x", "a"), (3, other, "a"), (7, other, "a"), (7, lone, "a"), (8, words("p"), "a"), (8, words("p") + " y", "a"), (None, " \t", "a"), (None, " \t", "a")]
    df = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, df.repartition(4), SF).collect()]
    assert sum(d is None and t.startswith("s0") for d, t in kept) == 1
    assert [d for d, t in kept if t == other] == [3] and [d for d, t in kept if t == lone] == [7]
    assert sum(d == 8 for d, _ in kept) == 1 and kept.count((None, " \t")) == 2 and len(kept) == 6


def test_empty_table_and_long_text(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name
    long = " ".join(f"w{i % 977}x{i % 1009}" for i in range(120_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1), (3, "short one of its own", "en", None, None)], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3]

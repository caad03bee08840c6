import zlib
from collections import Counter
from math import log

import duckdb
import pytest

from pulsegrid.llm import langid

SF = "/root/testdata/sf0.01"


def test_query_held_out_accuracy(spark):
    from pulsegrid.llm.queries import QUERIES

    langs = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = QUERIES["op10_language_id"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in out) / len(out) > 0.98


def slow(train, text):
    """Scores of the rule, from plain counts."""
    langs = sorted({lang for lang, _ in train})
    words = {lang: Counter(w for x, t in train if x == lang for w in t.split()) for lang in langs}
    all_words = {w for c in words.values() for w in c if sum(d[w] for d in words.values()) >= 2}
    grams = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in words[lang].items():
            m = f"^{w}$"
            for e in range(1, len(m) + 1):
                for k in range(1, min(5, e) + 1):
                    grams[lang][m[e - k:e]] += n
    known = {g for c in grams.values() for g in c}
    out = []
    for lang in langs:
        total = log((sum(x == lang for x, _ in train) + 0.5) / (len(train) + 0.5 * len(langs)))
        for w in text.split():
            if w in all_words:
                total += log((words[lang][w] + 0.5) / (sum(words[lang][x] for x in all_words) + 0.5 * len(all_words)))
                continue
            m, parts = f"^{w}$", []
            for e in range(1, len(m) + 1):
                for k in range(min(5, e), 0, -1):
                    if m[e - k:e] in known:
                        same = [g for g in known if len(g) == k]
                        parts.append(log((grams[lang][m[e - k:e]] + 0.5) / (sum(grams[lang][g] for g in same) + 0.5 * len(same))))
                        break
            total += sum(parts) / len(parts) if parts else 0.0
        out.append(total)
    return langs, out


def test_scores_against_plain_counts(spark):
    rows = [("en", "the cat and the dog"), ("en", "the house"), ("de", "der hund und die katze"), ("de", "das haus und der hund"), ("fr", "le chat et le chien")]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame([(ids[k], lang, text) for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string")
    model = langid.train(df)
    for text in ("the hund", "katzen und hunde", "xyz", "chats", "der the le"):
        langs, want = slow(rows, text)
        best = max(range(len(langs)), key=lambda k: want[k])
        lang, score = model.text(text, {})
        assert lang == langs[best]
        assert score == pytest.approx(1 / sum(2.718281828459045 ** (w - want[best]) for w in want), rel=1e-6)


def test_edge_rows(spark):
    schema = "doc_id long, lang string, text string, score string, language string"
    df = spark.createDataFrame([(None, "en", "hello world", "s", "l"), (1, "en", None, "s", "l"), (1, None, "hello", "s", "l"), (3, "de", "12 ... !", "s", "l"), (4, "de", "", "s", "l"), (5, "de", "hallo welt hallo", "s", "l")], schema)
    model = langid.train(df)
    got = [(r["text"], r["found"]["lang_pred"], r["score"]) for r in langid.predict(df, model, out="found").collect()]
    assert ("hello world", "en", "s") in got and {g[1] for g in got if g[0] in (None, "", "12 ... !")} == {"und"}
    nothing = langid.train(df.limit(0))
    assert {r["found"]["lang_pred"] for r in langid.predict(df, nothing, out="found").collect()} == {"und"}
    assert langid.predict(df.limit(0), model, out="found").count() == 0

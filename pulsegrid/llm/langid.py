"""Language of a text by words first, with backoff to shorter and shorter character n-grams.

Learned from labelled documents: how often each language uses each word, and each n-gram of 5 to 1 characters inside its words.  A known word
scores its smoothed log frequency in every language.  For an unknown one, every place of the word scores the longest known n-gram that ends there, averaged
over the word, so that it weighs about as much as a known word.  A text's score is the sum over its words plus the languages' shares; the best
language wins, ties go to the smaller name, and ``score`` is its posterior probability.

The model is fitted on a sample of the labelled documents whose expected size is ``FIT_ROWS`` (all of them where there are fewer), chosen by a hash of the id, and
every word of the sample's whole texts counts.  That bound is what may be sent to the executors; scoring covers every text.

Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing was learned. Repeated rows count and are scored one by one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import slices, unit

FIT_ROWS = 20_000
LONGEST_GRAM = 5
LEAST_WORD_COUNT = 2
SMOOTHING = 0.5
REMEMBERED = 300_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_ending(word: str, end: int) -> Iterator[str]:
    """N-grams of the marked word that end at a place, longest first."""
    for n in range(min(LONGEST_GRAM, end), 0, -1):
        yield word[end - n:end]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    shares: np.ndarray

    def unknown_word(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        found = []
        for end in range(1, len(marked) + 1):
            for gram in grams_ending(marked, end):
                at = self.grams.get(gram)
                if at is not None:
                    found.append(at)
                    break
        return self.gram_scores[found].mean(axis=0) if found else np.zeros(len(self.langs))

    def text(self, text: str | None, memory: dict[str, np.ndarray]) -> tuple[str, float]:
        found = words_of(text) if text else []
        if not self.langs or not any(map(str.isalpha, found)) and not any(c.isalpha() for w in found for c in w):
            return UNKNOWN, 0.0
        counts = Counter(found)
        places, times, total = [], [], self.shares.copy()
        for word, n in counts.items():
            at = self.words.get(word)
            if at is not None:
                places.append(at)
                times.append(n)
                continue
            own = memory.get(word)
            if own is None:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                own = memory[word] = self.unknown_word(word)
            total += n * own
        if places:
            total += np.asarray(times, np.float64) @ self.word_scores[places]
        best = int(np.argmax(total))
        return self.langs[best], float(1.0 / np.exp(total - total[best]).sum())


COUNTS = "lang string, kind int, token string, n long"


def _count(batches) -> Iterator[pa.RecordBatch]:
    """Partial counts of a slice: kind 0 for words, n for n-grams, -1 for documents."""
    for batch in slices(batches, "text"):
        words: dict[str, Counter] = {}
        docs: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            docs[lang] += 1
            words.setdefault(lang, Counter()).update(words_of(text or ""))
        rows = [(lang, -1, "", n) for lang, n in docs.items()]
        for lang, counts in words.items():
            grams: Counter = Counter()
            for word, n in counts.items():
                marked = f"^{word}$"
                for end in range(1, len(marked) + 1):
                    for gram in grams_ending(marked, end):
                        grams[gram] += n
            rows += [(lang, 0, w, n) for w, n in counts.items()] + [(lang, len(g), g, n) for g, n in grams.items()]
        columns = list(zip(*rows, strict=True))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "kind", "token", "n"])


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text is 2 modulo 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    rows = docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("lang"), F.col(text_column).alias("text")).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    share = min(1.0, fit_rows / max(1, rows.count()))
    sample = rows.filter(unit(F.xxhash64("id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))) < share).select("lang", "text")
    counts = sample.mapInArrow(_count, COUNTS).groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    lone = (F.col("kind") == 0) & (F.sum("n").over(_by_token()) < LEAST_WORD_COUNT)
    return build(counts.withColumn("_lone", lone).filter("NOT _lone").drop("_lone").toArrow())


def _by_token():
    from pyspark.sql import Window

    return Window.partitionBy("kind", "token")


def build(counts: pa.Table) -> Model:
    lang, kind, token, n = (counts.column(c).to_pylist() for c in ("lang", "kind", "token", "n"))
    langs = sorted(set(lang))
    number = {x: i for i, x in enumerate(langs)}
    shares = np.zeros(len(langs))
    at: tuple[dict[str, int], dict[str, int]] = ({}, {})
    for k, t in sorted({(k, t) for k, t in zip(kind, token, strict=True) if k >= 0}):
        own = at[k > 0]
        own[t] = len(own)
    tables = tuple(np.zeros((len(own), len(langs))) for own in at)
    for one, k, t, c in zip(lang, kind, token, n, strict=True):
        if k < 0:
            shares[number[one]] = c
        else:
            tables[k > 0][at[k > 0][t], number[one]] = c

    def scores(table: np.ndarray) -> np.ndarray:
        return np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * max(1, len(table))))

    order = np.fromiter(map(len, at[1]), np.int64, len(at[1]))
    grams = tables[1].copy()
    for size in range(1, LONGEST_GRAM + 1):
        grams[order == size] = scores(tables[1][order == size])
    return Model(langs, at[0], scores(tables[0]), at[1], grams, np.log((shares + SMOOTHING) / (shares.sum() + SMOOTHING * max(1, len(langs)))))


def predict(df: DataFrame, model: Model, text_column: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct (lang_pred, score). Other columns pass through."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def label(texts: pa.Array) -> pa.Array:
        found = []
        for batch in slices([pa.record_batch([texts], names=["t"])], "t"):
            found += [shared.value.text(t, _MEMORY) for t in batch.column("t").to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    _MEMORY: dict[str, np.ndarray] = {}
    return df.withColumn(out, label(F.col(text_column)))

"""Quality rules: document statistics, two fixed rules, and gradient-boosted trees with monotonic constraints.

The trees are fitted by Newton boosting on histograms of a bounded sample of labelled documents (``FIT_ROWS``, chosen by a hash of the id; all
labels where there are fewer) and flattened into node arrays, which score a whole Arrow batch level by level.  Features named in
``MONOTONE`` may only lower the score: a split that would break the order is not taken, and its children's values stay on their sides of the
middle, so the constraint holds for the whole ensemble.

Null text has no words and fails the fixed rules; so do empty texts.  Without usable labels the fixed rules decide alone. Repeated rows are judged one
by one; other columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import fresh, give_back, slices, unit
from pulsegrid.llm.words import Texts

#: Bytes of text measured at once: about fifty times as much is held meanwhile.
SLICE = 512 << 10
#: Rows of the labelled sample (its expected size; documented bound of what the driver gets).
FIT_ROWS = 20_000
TREES, DEPTH, RATE, SHRINK, BIN_COUNT, LEAST_HESSIAN = 60, 4, 0.2, 1.0, 32, 2.0
KEEP_FROM = 0.5
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Fixed value: what counts as a symbol.
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "upper_ratio", "digit_ratio", "mark_ratio",
            "top_word_ratio", "short_ratio", "long_ratio", "words_per_line", "lone_symbol_ratio", "wide_ratio")
MONOTONE = {"symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "top_word_ratio": -1}

_table = lambda members: np.isin(np.arange(256), np.frombuffer(bytes(members), np.uint8))
_IS_SYMBOL, _IS_UPPER, _IS_DIGIT = _table(SYMBOLS), _table(range(65, 91)), _table(range(48, 58))
_IS_MARK = _table([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (integers) and FEATURES (doubles) of every text, one row each. Null counts as empty."""
    t = Texts(column)
    n, data, rows = t.n_words, t.data, t.rows
    chars = (data & 0xC0) != 0x80
    in_word = np.zeros(len(data) + 1, np.int64)
    np.add.at(in_word, t.start, 1)
    np.add.at(in_word, t.end, -1)
    word_chars = t.sum_by_row(chars & (np.cumsum(in_word)[:-1] > 0))
    symbols = t.sum_by_row(_IS_SYMBOL[data])

    line_end = data == 10
    cuts = np.unique(np.concatenate([t.bounds[:-1], np.flatnonzero(line_end) + 1]))
    cuts = cuts[cuts < len(data)] if len(data) else cuts[:0]
    stops = np.append(cuts[1:], len(data)) if len(cuts) else cuts
    bare = stops - line_end[stops - 1] if len(cuts) else stops  # without the line feed
    used = np.searchsorted(t.start, stops) > np.searchsorted(t.start, cuts)
    owner, line = t.row_of(cuts[used]), t.hashes(cuts[used], bare[used])
    order = np.lexsort((line, owner))
    same = (line[order][1:] == line[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    dup_lines, lines = np.bincount(owner[order][1:][same], minlength=rows), np.bincount(owner, minlength=rows)

    first, h = t.windows(WINDOW)
    order = np.lexsort((h, t.owner[first]))
    same = (h[order][1:] == h[order][:-1]) & (t.owner[first[order][1:]] == t.owner[first[order][:-1]])
    twice = np.zeros(len(first), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(t.owner) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + WINDOW, -1)
    repeated = np.bincount(t.owner[np.cumsum(cover)[:-1] > 0], minlength=rows)

    order = np.lexsort((t.hash, t.owner))
    new = np.ones(len(order), bool)
    new[1:] = (t.hash[order][1:] != t.hash[order][:-1]) | (t.owner[order][1:] != t.owner[order][:-1])
    at = np.flatnonzero(new)
    times, whose = np.diff(np.append(at, len(order))), t.owner[order][at]
    distinct, top = np.bincount(whose, minlength=rows), np.zeros(rows, np.int64)
    np.maximum.at(top, whose, times)

    size = t.end - t.start
    by_word = lambda mask: np.bincount(t.owner[mask], minlength=rows)
    total = np.concatenate([[0], np.cumsum(_IS_SYMBOL[data] | _IS_MARK[data])])
    lone = by_word(total[t.end] - total[t.start] == size)
    counts = np.stack([n, word_chars, symbols, dup_lines, repeated], axis=1).astype(np.int64)
    part = lambda a, b: a / np.maximum(b, 1)
    features = np.stack([
        np.log1p(n), part(word_chars, n), part(symbols, n), part(dup_lines, lines), part(repeated, n), part(distinct, n),
        part(t.sum_by_row(_IS_UPPER[data]), word_chars), part(t.sum_by_row(_IS_DIGIT[data]), word_chars), part(t.sum_by_row(_IS_MARK[data]), word_chars),
        part(top, n), part(by_word(size <= 3), n), part(by_word(size >= 15), n), part(n, lines), part(lone, n),
        part(t.sum_by_row(chars & (data >= 128)), word_chars)], axis=1).astype(np.float64)
    return counts, features


@dataclass
class Forest:
    """Node arrays of all trees: go to ``left`` where the feature is at most the threshold; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1.0 / (1.0 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int]) -> Forest:
    """Boosted trees for labels 0 to 1; ``monotone`` gives +1 or -1 by feature number. Deterministic in its input."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BIN_COUNT + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots, raw = [], np.full(len(y), start)

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + SHRINK), low, high))

    def grow(rows: np.ndarray, depth: int, low: float, high: float) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, at, at, RATE * leaf_value(g, h, low, high)])
        best = (1e-9, 0, 0, 0.0, 0.0)
        for f in range(x.shape[1]) if depth < DEPTH else ():
            if not len(edges[f]):
                continue
            gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], len(edges[f]) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], hess[rows], len(edges[f]) + 1))[:-1]
            a, b = np.clip(-gs / (hs + SHRINK), low, high), np.clip(-(g - gs) / (h - hs + SHRINK), low, high)
            worth = lambda v, gg, hh: -(gg * v + 0.5 * (hh + SHRINK) * v * v)
            own = leaf_value(g, h, low, high)
            gain = worth(a, gs, hs) + worth(b, g - gs, h - hs) - worth(own, g, h)
            allowed = (hs >= LEAST_HESSIAN) & (h - hs >= LEAST_HESSIAN) & ((b - a) * monotone.get(f, 0) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k, float(a[k]), float(b[k]))
        gain, f, k, a, b = best
        if gain > 1e-9:
            goes = binned[rows, f] <= k
            middle, sign = (a + b) / 2, monotone.get(f, 0)
            left = grow(rows[goes], depth + 1, max(low, middle) if sign < 0 else low, min(high, middle) if sign > 0 else high)
            right = grow(rows[~goes], depth + 1, max(low, middle) if sign > 0 else low, min(high, middle) if sign < 0 else high)
            nodes[at][:4] = [f, float(edges[f][k]), left, right]
        return at

    for _ in range(TREES):
        p = 1.0 / (1.0 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
        one = Forest(*(np.array([n[k] for n in nodes[first:]]) for k in range(2)), *(np.array([n[k] for n in nodes[first:]]) - first for k in (2, 3)),
                     np.array([n[4] for n in nodes[first:]]), np.array([0]), 0.0)
        node = np.zeros(len(y), np.int64)
        for _ in range(DEPTH):
            node = np.where(x[np.arange(len(y)), one.feature[node]] <= one.threshold[node], one.left[node], one.right[node])
        raw = raw + one.value[node]
    column = lambda k, kind: np.array([n[k] for n in nodes], kind)
    return Forest(column(0, np.int32), column(1, np.float64), column(2, np.int32), column(3, np.int32), column(4, np.float64), np.array(roots, np.int32), start)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", fit_rows: int = FIT_ROWS) -> Forest | None:
    """Fit on a bounded sample of the labelled documents; None where there are no labels of both kinds.

    A document with several labels takes their mean; documents that share an id count once. Only the sample's texts are measured.
    """
    known = labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(id_column).agg(F.avg(label_column).alias("_label"))
    share = min(1.0, fit_rows / max(1, known.count()))
    chosen = known.filter(unit(F.xxhash64(id_column)) < share).select(F.col(id_column).alias("_id"), "_label")

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        out = [statistics(b.column("t"))[1] for b in slices([pa.record_batch([texts], names=["t"])], "t", SLICE)]
        give_back()
        return pa.array(np.concatenate(out).tolist(), pa.list_(pa.float64())) if out else pa.array([], pa.list_(pa.float64()))

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = rows.select("_id", "_label", measured("_text").alias("_x")).groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_x").alias("_x"))
    got = sorted((r["_id"], r["_label"], r["_x"]) for r in sample.collect())
    y = np.array([r[1] for r in got])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r[2] for r in got]), y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


VERDICT = "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ",base_failed:boolean,score:double,kept:boolean>"


def judge(df: DataFrame, forest: Forest | None, text_column: str = "text", out: str = "verdict") -> DataFrame:
    """Add ``out``: the counts, ``base_failed``, the trees' ``score`` (null without a forest) and ``kept``."""

    @F.arrow_udf(VERDICT)
    def verdict(texts: pa.Array) -> pa.Array:
        parts = []
        for batch in slices([pa.record_batch([texts], names=["t"])], "t", SLICE):
            counts, x = statistics(batch.column("t"))
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            score = forest.score(x) if forest is not None else np.full(len(x), np.nan)
            kept = ~failed & ((score >= KEEP_FROM) if forest is not None else True)
            parts.append(pa.StructArray.from_arrays([*(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed),
                                                     pa.array(score, mask=np.isnan(score)), pa.array(kept)], names=[*COUNTS, "base_failed", "score", "kept"]))
        give_back()
        if not parts:
            return pa.array([], pa.struct([*((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]))
        return pa.concat_arrays(parts)

    return df.withColumn(out, verdict(F.col(text_column)))


def keep(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    name = fresh(docs, "verdict")
    judged = judge(docs, train(docs, labels, id_column, text_column), text_column, name)
    return judged.filter(F.col(f"{name}.kept")).drop(name)

"""Runs of periodically repeated words in whole texts, by recursive frequency splitting and a lag scan.

A run of period q is at least 4 q words long, so each of its words occurs at least four times inside it.  A word that occurs less often than that in its segment
(first the whole text) lies in no run: it splits the segment, in whose parts further words become rare.  This goes on for all segments of a batch of texts at once
until nothing splits; ordinary prose is gone after a few rounds.

The segments left are scanned lag by lag.  Words q apart agree along a run of period q for at least 3 q places, which cover two whole aligned blocks of q places;
hence only neighbouring blocks with equal hashes are looked at, about m / q per lag and m log m in all.  Hits are compared word by word and extended on both
sides by less than a block, so hashes only choose where to look.  A stretch inside an earlier run, of smaller period, repeats that one and is no run of its own.

Words are what ``[^\\x20\\x09-\\x0D]+`` matches, compared as they stand.  Null and empty texts have no runs and collapse to an empty text.  Rows are worked on one by one,
so repeated rows get equal results.  Texts are read in pieces: beside the text a word costs about 50 bytes, and one text stands in one task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import slices

LEAST, FOLD = 6, 4
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of about a megabyte of text."""
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, start + PIECE)
        stop = cut.start() if cut else len(text)
        yield text[start:stop].split()
        start = stop


def coded(texts: list[bytes]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's words as numbers of one vocabulary."""
    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    out = []
    for text in texts:
        parts = [np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)) for words in pieces(text)]
        out.append(np.concatenate([*parts, np.empty(0, np.int32)]))
    return out, list(vocabulary)


def survivors(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words left after splitting, ascending, and the segment of each; a segment is consecutive words of one owner."""
    places, segment = np.arange(len(words)), owner.astype(np.int64)
    while len(places):
        order = np.lexsort((words[places], segment))
        s, w = segment[order], words[places[order]]
        first = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (w[1:] != w[:-1])]))
        often = np.diff(np.append(first, len(order)))
        kept = np.zeros(len(places), bool)
        kept[order] = np.repeat(often >= FOLD, often)
        before, total = segment[kept], len(places)
        places = places[kept]
        segment = np.cumsum(np.concatenate([[False], (np.diff(places) > 1) | (before[1:] != before[:-1])])) if len(places) else before
        size = np.bincount(segment) if len(segment) else np.empty(0, np.int64)
        long = size[segment] >= LEAST
        places, segment = places[long], segment[long]
        if len(places) == total:
            break
    return places, segment


def scan(words: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Runs (start, length, period) of segments that stand one after another; starts are indices into ``words``."""
    if not len(words):
        return np.empty((0, 3), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
    size, by_size = np.diff(edges), np.argsort(-np.diff(edges), kind="stable")
    # Longest segments first, a word of its own after each: lag q needs only the prefix of segments long enough.
    size = size[by_size]
    at = np.repeat(edges[:-1][by_size], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    ends = np.cumsum(size + 1)
    line = np.empty(int(ends[-1]), np.int64)
    line[ends - 1] = -1 - np.arange(len(size))
    inside = np.ones(len(line), bool)
    inside[ends - 1] = False
    line[inside], origin = words[at], np.zeros(len(line), np.int64)
    origin[inside] = at
    mixed = (line.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(line), _BASE)]))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(line), _BACK)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power[:-1])])
    reach = np.zeros(len(line), np.int64)  # the furthest end of a run known so far that covers this place
    found = []
    active = len(size)
    for q in range(1, int(size[0]) // FOLD + 1):
        while size[active - 1] < max(LEAST, FOLD * q):
            active -= 1
        n = int(ends[active - 1])
        block = sums[q:n + 1:q] - sums[:n + 1 - q:q]
        block *= back[:n + 1 - q:q]
        same = block[1:] == block[:-1]
        if not same.any():
            continue
        hit = np.flatnonzero(same[1:] & same[:-1]) if q > 1 else np.flatnonzero(same)
        hit = hit[reach[hit * q] < (hit + (3 if q > 1 else 2)) * q]
        upto = -1
        for j in hit.tolist():
            start, stop = j * q, (j + (2 if q > 1 else 1)) * q
            if stop <= upto or not np.array_equal(line[start:stop], line[start + q:stop + q]):
                continue
            while start and (step := min(start, 2 * q)):
                miss = np.flatnonzero(line[start - step:start] != line[start - step + q:start + q])
                start -= step if not len(miss) else step - 1 - int(miss[-1])
                if len(miss):
                    break
            while step := min(len(line) - q - stop, max(2 * q, 64)):
                miss = np.flatnonzero(line[stop:stop + step] != line[stop + q:stop + q + step])
                stop += step if not len(miss) else int(miss[0])
                if len(miss):
                    break
            upto, end = stop, stop + q
            if end - start >= max(LEAST, FOLD * q) and reach[start] < end:
                found.append((origin[start], end - start, q))
                np.maximum(reach[start:end], end, out=reach[start:end])
    return np.array(found, np.int64).reshape(-1, 3)


def runs_of(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of coded texts by text, start and period, and the text of each."""
    words = np.concatenate([*texts, np.empty(0, np.int32)])
    bounds = np.cumsum([0, *map(len, texts)])
    places, segment = survivors(words, np.repeat(np.arange(len(texts)), np.diff(bounds)))
    runs = scan(words[places], segment)
    runs[:, 0] = places[runs[:, 0]] if len(runs) else runs[:, 0]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    owner = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    runs[:, 0] -= bounds[owner]
    return runs, owner


def _collapsed(words: np.ndarray, runs: np.ndarray, vocabulary: list[bytes]) -> str:
    """Words joined by a blank, without those that any run contains after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = words[np.cumsum(change[:-1]) == 0]
    parts = [b" ".join([vocabulary[w] for w in kept[i:i + PIECE].tolist()]) for i in range(0, len(kept), PIECE)]
    return b" ".join(parts).decode()


def find(df: DataFrame, text_column: str, runs_column: str = "runs", collapsed_column: str = "collapsed") -> DataFrame:
    """Rows with their runs (start, length, period in words; by start, then period) and the text with every run reduced to its first period.

    Columns of the frame that bear these two names are replaced.
    """
    df = df.drop(runs_column, collapsed_column)

    def work(batches) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, text_column, 2 << 20):
            texts = [t.encode() if t else b"" for t in batch.column(text_column).to_pylist()]
            codes, vocabulary = coded(texts)
            runs, owner = runs_of(codes)
            at = np.searchsorted(owner, np.arange(len(codes) + 1))
            values = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
            out = [_collapsed(c, runs[at[i]:at[i + 1]], vocabulary) for i, c in enumerate(codes)]
            yield pa.record_batch([*batch.columns, lists, pa.array(out, pa.string())], names=[*batch.schema.names, runs_column, collapsed_column])

    made = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(work, ", ".join([*made, f"`{runs_column}` {RUNS}", f"`{collapsed_column}` string"]))


def strongest(runs: Column) -> Column:
    """The run of greatest exact length over period; ties: least start, then period. Null without runs."""
    beats = lambda a, b: (a["length"] * b["period"] > b["length"] * a["period"])
    rest = F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0)))
    return F.when(F.size(runs) > 0, F.aggregate(rest, F.get(runs, F.lit(0)), lambda best, r: F.when(beats(r, best), r).otherwise(best)))

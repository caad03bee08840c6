"""Beats whose hits vote on the arities of their spans, worked on many whole beats at a time as Arrow batches.

Rows come sorted by beat, tick and side (end sides first), so the rows of a span always stand together: a span is a run of rows with the same (beat, s, q).
A task holds the beats of one Arrow batch and the one that the batch before left open; a beat has at most two rows per tick.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NOTHING = np.iinfo(np.int64).max


def prime(value: int) -> bool:
    return value > 1 and all(value % d for d in range(2, int(value**0.5) + 1))


def whole_beats(batches, keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut between beats, with the number of each row's beat."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        new = _changes(held, keys)
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield held.slice(0, last), np.cumsum(new[:last]) - 1
        held = held.slice(last)
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, np.int64)


def _changes(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    n = batch.num_rows - 1
    new[1:] = False
    for key in keys:
        column = batch.column(key)
        new[1:] |= pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n)), False).to_numpy(zero_copy_only=False)
        new[1:] |= np.diff(column.is_null().to_numpy(zero_copy_only=False).astype(np.int8)) != 0
    return new


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False).copy()


def _flags(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False).astype(bool)


def _marks(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, actual, normal, duration of every tuplet mark, and whether its arity is prime; marks that change nothing or are incomplete are left out."""
    lists = batch.column("tuplets")
    parts = lists.flatten()
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    actual, normal, duration = (pc.fill_null(parts.field(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for c in ("actual", "normal", "duration"))
    known = pc.and_(parts.field("actual").is_valid(), parts.field("normal").is_valid())
    used = (actual != normal) & known.to_numpy(zero_copy_only=False).astype(bool)
    kinds, where = np.unique(actual, return_inverse=True)
    return tuple(x[used] for x in (row, actual, normal, duration, np.array([prime(k) for k in kinds.tolist()], bool)[where]))


def refine_beats(batch: pa.RecordBatch, beat: np.ndarray, pow3: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Levels gained and notes of every row. Rounds go on over the spans that still split; the depth allowance ends them all."""
    n = batch.num_rows
    width, rel, cap, parent = (_numbers(batch, c) for c in ("beat_ticks", "_rel", "_cap", "_parent"))
    is_end, compound = pc.equal(batch.column("_side"), "E").to_numpy(zero_copy_only=False), _flags(batch.column("compound"))
    recovered = _flags(batch.column("canonical_recovered")) if "canonical_recovered" in batch.schema.names else np.zeros(n, bool)
    m_row, m_actual, m_normal, m_duration, m_prime = _marks(batch) if "tuplets" in batch.schema.names else (np.empty(0, np.int64),) * 4 + (np.empty(0, bool),)
    outside, s, q = _numbers(batch, "_beat"), np.ones(n, np.int64), np.zeros(n, np.int64)
    was_split = np.zeros(n, bool)
    gained_row, gained_level, noted_row, noted = [], [], [], []

    def note(rows: np.ndarray, texts: list[str]) -> None:
        noted_row.append(rows)
        noted.extend(texts)

    at, depth = np.arange(n), 0
    while len(at):
        a_width, a_rel, a_end = width[at], rel[at], is_end[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(beat[at]) != 0) | (np.diff(s[at]) != 0) | (np.diff(q[at]) != 0)
        first = np.flatnonzero(new)
        span = np.cumsum(new) - 1
        inner = ~a_end & (a_rel > 0)
        any_of = lambda flag: np.logical_or.reduceat(flag, first)
        has = any_of(inner)
        split = has & (depth < cap[at[first]])
        for_rows = lambda flag: at[flag[span]]
        spent = for_rows(has & ~split)
        note(spent, [f"depth:{b}:{y}:{x}" for b, y, x in zip(outside[spent].tolist(), q[spent].tolist(), s[spent].tolist(), strict=True)])

        # An arity that a full part vouches for; without any, one with two onsets.  Two candidates are a conflict.
        span_of = np.full(n, -1)
        span_of[at] = span
        low, high = np.full(len(first), NOTHING), np.zeros(len(first), np.int64)
        votes = np.flatnonzero(m_prime & (span_of[m_row] >= 0) & (rel[m_row] * m_actual % width[m_row] == 0))
        if len(votes):
            row, p = m_row[votes], m_actual[votes]
            full = (m_duration[votes] > 0) & (m_duration[votes] * p * s[row] == width[row])
            by = np.lexsort((row, p, span_of[row]))
            row, p, full, g = row[by], p[by], full[by], span_of[row][by]
            head = np.ones(len(by), bool)
            head[1:] = (np.diff(g) != 0) | (np.diff(p) != 0)
            begin = np.flatnonzero(head)
            onset = head.copy()
            onset[1:] |= np.diff(row) != 0
            fulls, twice = np.logical_or.reduceat(full, begin), np.add.reduceat(onset.astype(np.int64), begin) > 1
            vouched = np.zeros(len(first), bool)
            vouched[g[begin][fulls]] = True
            chosen = np.where(vouched[g[begin]], fulls, twice)
            np.minimum.at(low, g[begin][chosen], p[begin][chosen])
            np.maximum.at(high, g[begin][chosen], p[begin][chosen])
        clash = for_rows(split & (low < high))
        note(clash, ["conflict"] * len(clash))
        explicit = low == high
        usual = np.where(compound[at[first]] & (depth == 0), 3, 2)
        ternary = ~explicit & (usual == 2) & any_of(inner & recovered[at] & (a_rel % pow3[at] != 0))
        told = for_rows(split & ternary)
        note(told, ["ternary"] * len(told))
        f = np.where(explicit, low, np.where(ternary, 3, usual))[span]

        going = split[span]
        at, f = at[going], f[going]
        was_split[at] = True
        x = rel[at] * f
        k = np.where(is_end[at], x - 1, x) // width[at]
        point = np.where(is_end[at], k + 1, k)
        lands = x % width[at] == 0
        least = np.where((f == 2) | (point == 0) | (point == f), 1, point)
        most = np.where((f == 2) | (point == 0), 1, np.where(point == f, f - 1, np.minimum(point + 1, f - 1)))
        most = np.maximum(most, least)
        many = np.where(lands, most - least + 1, 0)
        gained_row.append(np.repeat(at, many))
        gained_level.append(np.repeat(parent[at] + least, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        rel[at], q[at] = x - k * width[at], q[at] * f + k
        s[at] *= f
        parent[at] += np.minimum(k + 1, f - 1)
        depth += 1

    mixed = ~m_prime & was_split[m_row] & ~is_end[m_row]
    note(m_row[mixed], [f"composite:{a}:{b}" for a, b in zip(m_actual[mixed].tolist(), m_normal[mixed].tolist(), strict=True)])
    return _lists(gained_row, pa.array(np.concatenate([np.empty(0, np.int64), *gained_level]).astype(np.int32)), n), _lists(noted_row, pa.array(noted, pa.string()), n)


def _lists(rows: list[np.ndarray], values: pa.Array, n: int) -> pa.Array:
    row = np.concatenate([np.empty(0, np.int64), *rows])
    cuts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), values.take(pa.array(np.argsort(row, kind="stable"))))


def power_of_three(width: np.ndarray) -> np.ndarray:
    """Largest power of three (up to 3^26) that divides each width."""
    out = np.ones_like(width)
    for _ in range(26):
        out = np.where(width % (out * 3) == 0, out * 3, out)
    return out


def voted(batches, keys: tuple[str, ...], kept: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Columns ``kept`` with ``_levels`` and ``_note`` of every row."""
    for batch, beat in whole_beats(batches, keys):
        levels, notes = refine_beats(batch, beat, power_of_three(_numbers(batch, "beat_ticks")))
        yield pa.record_batch([*(batch.column(c) for c in kept), levels, notes], names=[*kept, "_levels", "_note"])

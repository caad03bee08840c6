"""Hierarchical residual best-fit packing of token pieces into sequences of a fixed capacity.

A text longer than the capacity is cut into full pieces, of which the first takes the rest; a full piece is a sequence of its own.  Each task packs its
other pieces best-fit decreasing and emits the bins that are nearly full.  The bins that are not become items of the next round: they are dealt to fewer tasks,
``FAN_IN`` to one, packed best-fit again, and so on up the tree.  A task of any round holds at most about ``TASK_ITEMS`` items; if more than that stay underfull, rounds
of other groupings go on until no two open bins fit together, which the counts of bins by fill (at most ``capacity`` of them) tell.  Where many bins fit none of
their own task, those with room for the smallest bins are dealt with those, so that a round always joins some.

Each round is written to the shared folder before the next reads it.  A sequence holds at most ``capacity`` pieces, so its member list is bounded.
Null and empty texts are one piece of the end id. Repeated rows and null ids are separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm import tokens
from pulsegrid.llm.common import give_back, slices, write_once

CAPACITY = 1024
NEARLY_FULL = 0.99
FAN_IN = 8
TASK_ITEMS = 100_000
#: Bytes of text encoded at once: what a worker holds for that stays with it beyond its task.
SLICE = 512 << 10
#: A round that joins fewer bins than this share is followed by one that brings emptiest and fullest together.
LEAST_GAIN = 0.01

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BINS = "closed boolean, sequence_id long, fill int, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, best-fit decreasing: the fullest bin it fits, else a new one. Open bins are kept by free space, found by a bit mask."""
    place = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n_bins = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[free].pop()
            if not open_bins[free]:
                mask ^= 1 << free
        else:
            free, chosen, n_bins = capacity, n_bins, n_bins + 1
        place[item] = chosen
        left = free - size
        if left:
            open_bins[left].append(chosen)
            mask |= 1 << left
    return place


def _bins(fill: np.ndarray, sizes: np.ndarray, members: pa.Array, capacity: int, least: int, number) -> Iterator[pa.RecordBatch]:
    """Pack items, whose members (``sizes`` of them each) stand one after another, and emit bins; those filled to ``least`` are closed."""
    place = best_fit(fill, capacity)
    order = np.argsort(place, kind="stable")
    own = sizes[order]
    ends = np.cumsum(own)
    moved = members.take(pa.array(np.repeat((np.cumsum(sizes) - sizes)[order] - (ends - own), own) + np.arange(len(members))))
    firsts = np.flatnonzero(np.diff(place[order], prepend=-1))
    yield from _batches(np.add.reduceat(fill[order], firsts), np.add.reduceat(own, firsts), moved, least, number)


def _batches(fill: np.ndarray, sizes: np.ndarray, members: pa.Array, least: int, number) -> Iterator[pa.RecordBatch]:
    """Bins as rows, a few at once."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for at in range(0, len(fill), 4096):
        some, cuts = fill[at:at + 4096], ends[at:at + 4097]
        lists = pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), members.slice(cuts[0], cuts[-1] - cuts[0]), type=pa.list_(MEMBER))
        yield pa.record_batch([pa.array(some >= least), pa.array([number() for _ in some], pa.int64()), pa.array(some, pa.int32()), lists],
                              names=["closed", "sequence_id", "fill", "members"])


def _lengths(members: pa.StructArray) -> np.ndarray:
    return members.field("length").to_numpy().astype(np.int64)


def _numbers(round_no: int):
    """Sequence numbers that no other task or round uses."""
    nth = (round_no << 56) | (TaskContext.get().partitionId() << 32)

    def number() -> int:
        nonlocal nth
        nth += 1
        return nth

    return number


def pieces(doc_id, ids: np.ndarray, capacity: int) -> list[dict]:
    """Members of one document."""
    return members_of(pa.array([doc_id], pa.int64()), ids, np.array([len(ids)]), capacity).to_pylist()


def members_of(doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, capacity: int) -> pa.StructArray:
    """Members of documents whose ids stand one after another, in their order: full pieces behind a first one that takes the rest."""
    rest = counts % capacity
    n = counts // capacity + (rest > 0)
    doc = np.repeat(np.arange(len(counts)), n)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    short = np.where(rest > 0, capacity - rest, 0)[doc]
    start = np.maximum(piece * capacity - short, 0)
    length = (piece + 1) * capacity - short - start
    at = (np.cumsum(counts) - counts)[doc] + start
    data = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
    return pa.StructArray.from_arrays([doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], fields=list(MEMBER))


def _members(batches, encoder: tokens.Encoder, end: int | None, capacity: int) -> Iterator[pa.StructArray]:
    """Members of all documents, those of a slice of texts at once."""
    for batch in slices(batches, "text", SLICE):
        yield members_of(batch.column("id"), *encoder.documents(batch.column("text"), end), capacity)


def pack(df: DataFrame, id_column: str, text_column: str, capacity: int = CAPACITY, end: int | None = 2, tokenizer: str | None = None,
         nearly_full: float = NEARLY_FULL, task_items: int = TASK_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    tokenizer = tokenizer or tokens.default_path()
    least = max(1, int(np.ceil(capacity * nearly_full)))

    def first(batches) -> Iterator[pa.RecordBatch]:
        number, held = _numbers(0), []
        encoder = tokens.encoder(tokenizer)

        def flush() -> Iterator[pa.RecordBatch]:
            members = pa.concat_arrays(held)
            held.clear()
            length = _lengths(members)
            yield from _bins(length, np.ones_like(length), members, capacity, least, number)

        for found in _members(batches, encoder, end, capacity):
            is_full = _lengths(found) == capacity
            full, others = found.filter(pa.array(is_full)), found.filter(pa.array(~is_full))
            yield from _batches(_lengths(full), np.ones(len(full), np.int64), full, least, number)
            if len(others):
                held.append(others)
            if sum(map(len, held)) >= task_items:
                yield from flush()
        if held:
            yield from flush()
        give_back()

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    level = write_once(rows.mapInArrow(first, BINS), "packing")
    done, open_bins, round_no = level.filter("closed"), level.filter("NOT closed"), 1
    n_open, tasks = open_bins.count(), level.rdd.getNumPartitions()
    while n_open:
        tasks = max(1, -(-tasks // FAN_IN), -(-n_open // task_items))
        level = write_once(_merge(open_bins, tasks, round_no, capacity, least), "packing")
        left, room = _room(level, capacity)
        if tasks == 1 or room is None:
            done = done.unionByName(level)
            break
        done, open_bins = done.unionByName(level.filter(f"closed OR fill > {room}")), level.filter(f"NOT closed AND fill <= {room}")
        if left > (1.0 - LEAST_GAIN) * n_open:
            # What fits together rarely meets by chance: the emptiest bins and the fullest that still have room for one of them go to one task.
            half = max(1, task_items // 2)
            chosen = open_bins.orderBy("fill").limit(half).unionByName(open_bins.orderBy(F.desc("fill")).limit(half)).dropDuplicates(["sequence_id"])
            chosen = write_once(chosen, "packing")
            joined = write_once(_merge(chosen, 1, round_no + 1, capacity, least), "packing")
            others = open_bins.join(chosen.select("sequence_id"), "sequence_id", "left_anti").select(*open_bins.columns)
            done, open_bins, round_no = done.unionByName(joined.filter("closed")), others.unionByName(joined.filter("NOT closed")), round_no + 1
        n_open, round_no = open_bins.count(), round_no + 1
    ends = F.aggregate(F.slice("members", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda acc, m: acc + m["length"])
    return done.select("sequence_id", "members", F.posexplode("members").alias("pos", "m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", ends.alias("offset"))


def _room(level: DataFrame, capacity: int) -> tuple[int, int | None]:
    """Number of open bins, and the most that a bin may hold to take the emptiest one in; None if no two of them fit together."""
    fills = sorted(level.filter("NOT closed").groupBy("fill").count().collect())  # at most ``capacity`` rows
    emptiest = [f for f, n in fills for _ in range(min(n, 2))][:2]
    fits = len(emptiest) == 2 and sum(emptiest) <= capacity
    return sum(n for _, n in fills), capacity - emptiest[0] if fits else None


def _merge(open_bins: DataFrame, tasks: int, round_no: int, capacity: int, least: int) -> DataFrame:
    def again(batches) -> Iterator[pa.RecordBatch]:
        number, fill, sizes, members = _numbers(round_no), [], [], []
        for batch in batches:
            lists = batch.column("members")
            fill.append(batch.column("fill").to_numpy().astype(np.int64))
            sizes.append(lists.value_lengths().to_numpy().astype(np.int64))
            members.append(pa.StructArray.from_arrays(lists.flatten().flatten(), fields=list(MEMBER)))
        if sum(map(len, fill)):
            yield from _bins(np.concatenate(fill), np.concatenate(sizes), pa.concat_arrays(members), capacity, least, number)
        del fill, sizes, members
        give_back()

    return open_bins.repartition(tasks, F.xxhash64("sequence_id", F.lit(round_no))).select("fill", "members").mapInArrow(again, BINS)

"""Token-id files in patched frame-of-reference blocks.

A file image holds whole documents, one after another, and can be decoded block by block:

* head: magic, version, counts of documents, blocks and exceptions;
* document table: id, null mark and token count of each document;
* block table: minimum, bit width and exception count of each block of 256 ids, from which the index of block starts follows by running sums;
* packed values: ``id - minimum`` of each block in the width that holds 90 % of them, low bits first;
* exceptions: place and upper bits of the values that do not fit, patched in after unpacking.

``write`` sorts documents by id over all partitions and stores the images as a Parquet table (part, seq, n_tokens, image), so the cluster's own commit
protocol and any file system it knows apply; an image is at most ``IMAGE_TOKENS`` ids plus one document.  ``read`` decodes them again; places in the
whole stream come from the sums of the parts before, never from one long scan.

Null and empty texts are documents of the end id alone.  Null ids sort first.  Repeated rows are separate documents; ties are ordered by text hash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm import tokens
from pulsegrid.llm.common import slices

MAGIC, VERSION = b"PFOR", 1
HEAD = struct.Struct("<4sHIII")
BLOCK = 256
PERCENTILE = 90
IMAGE_TOKENS = 1 << 20
#: Pieces that a worker remembers: more than elsewhere, as nothing else is held here.
MEMORY = 700_000


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1.0)).astype(np.uint8)


def encode(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray) -> bytes:
    """Image of documents whose ids stand one after another in ``ids``."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    grid.ravel()[: len(ids)] = ids
    if len(ids) % BLOCK:
        grid[-1, len(ids) % BLOCK:] = ids[-1]
    low = grid.min(axis=1) if blocks else np.empty(0, np.uint32)
    grid -= low[:, None]
    rank = BLOCK * PERCENTILE // 100
    width = _widths(np.partition(grid, rank, axis=1)[:, rank]) if blocks else np.empty(0, np.uint8)
    over = grid >> width[:, None].astype(np.uint32)
    block, place = np.nonzero(over)
    packed = np.empty(blocks, object)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(grid[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, count=int(w), bitorder="little")
        body = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        for row, data in zip(rows, body, strict=True):
            packed[row] = data.tobytes()
    table = [doc_ids.astype("<i8").tobytes(), np.asarray(nulls, np.uint8).tobytes(), counts.astype("<i8").tobytes(), low.astype("<u4").tobytes(), width.tobytes(),
             np.bincount(block, minlength=blocks).astype("<u2").tobytes()]
    patches = [place.astype(np.uint8).tobytes(), over[block, place].astype("<u4").tobytes()]
    return b"".join([HEAD.pack(MAGIC, VERSION, len(counts), blocks, len(block)), *table, *packed, *patches])


class Image:
    """Reader of one image; ``starts`` indexes the packed blocks, so any range can be decoded on its own."""

    def __init__(self, data: bytes):
        magic, version, docs, blocks, patches = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token image of this version")
        at = HEAD.size

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.counts = column("<i8", docs), column("u1", docs).astype(bool), column("<i8", docs)
        self.low, self.width, exceptions = column("<u4", blocks), column("u1", blocks), column("<u2", blocks).astype(np.int64)
        size = BLOCK // 8 * self.width.astype(np.int64)
        self.starts = at + np.cumsum(size) - size
        at += int(size.sum())
        self.place, self.upper = column("u1", patches), column("<u4", patches)
        self.first_patch = np.concatenate([[0], np.cumsum(exceptions)])
        self.data, self.n_tokens = data, int(self.counts.sum())

    def blocks(self, first: int, stop: int) -> np.ndarray:
        """Ids of the blocks first to stop - 1 (the last one padded)."""
        out = np.zeros((max(0, stop - first), BLOCK), np.uint32)
        raw = np.frombuffer(self.data, np.uint8)
        for w in np.unique(self.width[first:stop]):
            rows = np.flatnonzero(self.width[first:stop] == w)
            if w:
                body = raw[self.starts[first + rows][:, None] + np.arange(BLOCK // 8 * int(w))]
                bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
                bits[:, :, : int(w)] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), BLOCK, int(w))
                out[rows] = np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0]
        a, b = self.first_patch[first], self.first_patch[stop]
        row = np.repeat(np.arange(first, stop), np.diff(self.first_patch[first:stop + 1])) - first
        width = self.width[first:stop][row].astype(np.uint32)
        out[row, self.place[a:b]] |= self.upper[a:b] << width
        return out + self.low[first:stop, None]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from place start to stop - 1 of this image, decoding only the blocks they lie in."""
        stop = self.n_tokens if stop is None else min(stop, self.n_tokens)
        first = start // BLOCK
        return self.blocks(first, max(first, -(-stop // BLOCK))).ravel()[start - first * BLOCK: stop - first * BLOCK]


IMAGES = "part int, seq int, n_tokens long, image binary"
FOUND = "part int, seq int, nth int, doc_id long, local long, n_tokens long, ids_crc32 long"


def write(df: DataFrame, path: str, id_column: str, text_column: str, end: int | None = 2, tokenizer: str | None = None, image_tokens: int = IMAGE_TOKENS) -> None:
    """Encode all texts and write their images in ascending id order. Other columns of the frame are not read."""
    tokenizer = tokenizer or tokens.default_path()

    def images(batches) -> Iterator[pa.RecordBatch]:
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        encoder = tokens.encoder(tokenizer, MEMORY)

        def flush():
            nonlocal seq, held, size
            ids, docs, nulls, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            image = encode(ids, docs, nulls, counts)
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())],
                                  names=["part", "seq", "n_tokens", "image"])
            seq, held, size = seq + 1, [], 0
            return out

        for batch in slices(batches, "text", 2 << 20):
            ids, counts = encoder.documents(batch.column("text"), end)
            key = batch.column("id")
            held.append((ids, key.fill_null(0).to_numpy(zero_copy_only=False), key.is_null().to_numpy(zero_copy_only=False), counts))
            size += len(ids)
            if size >= image_tokens:
                yield flush()
        if held:
            yield flush()

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    keyed = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "text")
    ordered.mapInArrow(images, IMAGES).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written table: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit words)."""

    def decode(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "image")), strict=True):
                one = Image(image)
                ends = np.cumsum(one.counts)
                data = memoryview(one.ids().astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * (e - n): 4 * e]) for e, n in zip(ends.tolist(), one.counts.tolist(), strict=True)]
                n = len(ends)
                yield pa.record_batch([
                    pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(one.doc_ids, pa.int64(), mask=one.nulls), pa.array(ends - one.counts), pa.array(one.counts), pa.array(crc, pa.int64()),
                ], names=["part", "seq", "nth", "doc_id", "local", "n_tokens", "ids_crc32"])

    stored = spark.read.schema(IMAGES).parquet(path)
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, then per image of a part: far fewer rows than documents, and no scan longer than the number of parts.
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before([], "part")), F.lit(0)).alias("part_start"))
    inside = stored.select("part", "seq", F.coalesce(F.sum("n_tokens").over(before(["part"], "seq")), F.lit(0)).alias("image_start"))
    offsets = inside.join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("image_start")).alias("base"))
    return stored.mapInArrow(decode, FOUND).join(offsets, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")

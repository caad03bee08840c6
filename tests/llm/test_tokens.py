import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tokenizers import Tokenizer

from pulsegrid.llm import blocks, packing, tokens
from pulsegrid.llm.common import shared_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


special = st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", "b."]), max_size=6).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="ab .,\n\t'’é日1　\xa0\x1c\x85", max_size=12), special), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(texts):
    """Against the library itself, with nothing set but what the contract names."""
    plain = Tokenizer.from_file(tokens.default_path())
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, counts = tokens.encoder(tokens.default_path()).encode(pa.array(texts, pa.string()))
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for one in want for x in one]


def test_special_tokens_and_long_texts():
    plain = Tokenizer.from_file(tokens.default_path())
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>\ny", "plain words", "lorem ipsum. " * 100_000, "z" * 20_000 + " <|endoftext|>"]
    ids, counts = tokens.encoder(tokens.default_path()).encode(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 50256 in ids.tolist()


def test_pieces_met_again_outlive_the_others():
    """Beyond its memory an encoder forgets what it met once only, half of the memory at least, and gives the same ids."""
    own, plain = tokens.Encoder(tokens.default_path(), memory=60), Tokenizer.from_file(tokens.default_path())
    often = [f"often{k}" for k in range(20)]
    for turn in range(12):
        text = " ".join(["x", *often, *(f"once{turn}x{k}" for k in range(15))])
        ids, _ = own.encode(pa.array([text]))
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
        assert not turn or all(f" {word}" in own.known for word in often)
        assert len(own.known) <= 60 + 36


def test_documents_end_with_the_end_id(encoder):
    ids, counts = encoder.documents(pa.array([None, "", "a b", "x" * 5000]), 2)
    assert [own[-1] for own in np.split(ids, np.cumsum(counts)[:-1])] == [2] * 4 and counts[0] == counts[1] == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 50256), st.integers(0, 2**32 - 1)), max_size=700), max_size=5), st.integers(0, 900), st.integers(0, 900))
def test_image_round_trip(docs, a, b):
    counts = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    one = blocks.Image(blocks.encode(ids, np.arange(len(docs)), np.zeros(len(docs), bool), counts))
    assert one.ids().tolist() == ids.tolist() and one.counts.tolist() == counts.tolist()
    start, stop = sorted((min(a, len(ids)), min(b, len(ids))))
    assert one.ids(start, stop).tolist() == ids[start:stop].tolist()


def test_outliers_become_exceptions():
    ids = np.array([*range(100, 350), *[4_000_000_000] * 6], np.uint32)
    one = blocks.Image(blocks.encode(ids, np.array([1]), np.array([False]), np.array([256])))
    assert one.width[0] == 8 and len(one.place) == 6 and one.ids().tolist() == ids.tolist()


def expected(encoder, rows):
    """doc_id, start, n_tokens, crc by plain encoding in id order."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_written_blocks(spark, encoder):
    from pulsegrid.llm.queries import QUERIES

    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = QUERIES["op3_token_blocks"](spark, SF)
    assert sorted(map(tuple, got.collect())) == expected(encoder, rows)


def test_written_blocks_edge_rows(spark, encoder):
    rows = [(None, "null id"), (5, None), (5, None), (-3, ""), (9, "long " * 3000), (7, "a"), (7, "a"), (2**40, "b\n\n\nc")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, image string")
    for frame, want in ((df, expected(encoder, rows)), (df.limit(0), [])):
        path = shared_path(spark, "test-blocks")
        blocks.write(frame, path, "doc_id", "text", image_tokens=64)
        assert sorted(map(tuple, blocks.read(spark, path).collect()), key=lambda r: r[1]) == want


def check_packing(encoder, rows, got, capacity):
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2])
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        want = [(p["piece"], p["start"], p["length"], p["ids_crc32"]) for ids in texts[doc] for p in packing.pieces(doc, np.array(ids, np.uint32), capacity)]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == sorted(want)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), -(-sum(r["length"] for r in got) // capacity)


def test_packing_query(spark, encoder):
    from pulsegrid.llm.queries import QUERIES

    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    n, bound = check_packing(encoder, rows, QUERIES["op8_residual_packing"](spark, SF).collect(), 1024)
    assert n <= bound * 1.02 + 1


def test_packing_edge_rows_and_rounds(spark, encoder):
    r = random.Random(3)
    rows = [(None, None), (1, ""), (1, ""), (2, "w " * 300)] + [(i, " ".join("ab" for _ in range(r.randint(0, 40)))) for i in range(3, 400)]
    df = spark.createDataFrame([(*x, True) for x in rows], "doc_id long, text string, closed boolean").repartition(24)
    n, bound = check_packing(encoder, rows, packing.pack(df, "doc_id", "text", 64).collect(), 64)
    assert n <= bound * 1.05 + 1
    check_packing(encoder, rows, packing.pack(df, "doc_id", "text", 64, task_items=20).collect(), 64)
    over_half = spark.createDataFrame([(i, "ab " * 40) for i in range(300)], "doc_id long, text string").repartition(8)
    assert packing.pack(over_half, "doc_id", "text", 64, task_items=20).select("sequence_id").distinct().count() >= 300
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_packing_ends_only_when_no_two_bins_fit(spark, encoder):
    """Tiny tasks, so that partners meet by chance only seldom: many bins over half full, a few small ones that fit some of them."""
    sizes = [40] * 150 + [45] * 60 + [23] * 4 + [18] * 3
    rows = [(i, " ".join(["ab"] * n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = packing.pack(df, "doc_id", "text", 64, task_items=12).collect()
    check_packing(encoder, rows, got, 64)
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    least = sorted(fill.values())[:2]
    assert sum(least) > 64 and len(fill) <= 213


def test_best_fit_prefers_the_fullest_bin():
    place = packing.best_fit(np.array([60, 50, 40, 10, 4]), 64)
    assert place.tolist() in ([0, 1, 2, 1, 0], [0, 1, 2, 1, 1]) and len(packing.best_fit(np.array([], np.int64), 64)) == 0


def test_new_words_are_encoded_together(monkeypatch):
    """A call of the library per word held its ids as lists and took most of the time; words that may not stand beside others still go alone."""
    plain, own = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    sent = []
    whole = own._whole
    monkeypatch.setattr(own, "_whole", lambda texts, special=False: sent.extend(texts) or whole(texts, special))
    words = [f"w{i}x{i * 7919}" for i in range(2000)]
    texts = [" ".join(words), "a  b\tc \t d", " ".join(f"\u00e9{i}\xa0" for i in range(50)), "x " + "y" * 100 + " 日本 \n z", " ".join(words[::-1])]
    ids, counts = own.encode(pa.array(texts))
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert len(sent) < 200


def test_unknown_bytes_of_ids_change_no_id():
    """Where the bytes of the ids do not tell words apart, each word is encoded alone."""
    own, other = tokens.Encoder(tokens.default_path()), tokens.Encoder(tokens.default_path())
    other.bytes_of = np.ones_like(other.bytes_of)
    text = pa.array([" ".join(f"word{i} {i}" for i in range(3000))])
    assert np.array_equal(own.encode(text)[0], other.encode(text)[0])


def test_pieces_are_columns():
    """Pieces of a batch come as Arrow columns (a dictionary of Python objects for each took an executor's memory), equal to those cut one document at a time."""
    counts = [1, 64, 65, 128, 200, 63]
    ids = np.arange(sum(counts), dtype=np.uint32)
    got = packing.members_of(pa.array([5, None, 5, 6, 7, 8], pa.int64()), ids, np.array(counts), 64).to_pylist()
    want, at = [], 0
    for doc, n in zip([5, None, 5, 6, 7, 8], counts, strict=True):
        own, at, start = ids[at:at + n], at + n, 0
        for nth, size in enumerate(([n % 64] if n % 64 else []) + [64] * (n // 64)):
            crc = zlib.crc32(np.ascontiguousarray(own[start:start + size]).astype("<u4").tobytes())
            want.append({"doc_id": doc, "piece": nth, "start": start, "length": size, "ids_crc32": crc})
            start += size
    assert got == want


def test_bins_keep_every_member():
    r = np.random.default_rng(1)
    sizes, fill = r.integers(1, 5, 9000), r.integers(1, 60, 9000)
    members = packing.members_of(pa.array(np.arange(int(sizes.sum()))), np.arange(int(sizes.sum()), dtype=np.uint32), np.ones(int(sizes.sum()), np.int64), 64)
    out = [b for batch in packing._bins(fill, sizes, members, 64, 60, iter(range(10**6)).__next__) for b in batch.to_pylist()]
    item = np.repeat(np.arange(9000), sizes)
    for b in out:
        own = list(dict.fromkeys(item[m["doc_id"]] for m in b["members"]))
        assert b["fill"] == fill[own].sum() <= 64 and len(b["members"]) == sizes[own].sum() and b["closed"] == (b["fill"] >= 60)
    assert sorted(m["doc_id"] for b in out for m in b["members"]) == list(range(int(sizes.sum())))


def test_texts_are_packed_in_small_slices(encoder, monkeypatch):
    """Pipeline: a worker outlives its task, so what it holds to encode a slice counts against the executor."""
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(300)) for k in range(40)] + [None, "", "a b"]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    assert packing.SLICE <= 512 << 10

    def made(limit):
        monkeypatch.setattr(packing, "SLICE", limit)
        return [x.to_pylist() for x in packing._members([batch], encoder, 2, 64)]

    whole, cut = made(1 << 20), made(3000)
    assert len(whole) == 1 < len(cut) and whole[0] == [m for x in cut for m in x]

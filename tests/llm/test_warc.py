import base64
import gzip
import hashlib
import json
import os
import tempfile
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import warc
from pulsegrid.llm.common import shared_path


def local(path):
    return path.removeprefix("file:")


def archives(path):
    return sorted(os.path.join(local(path), f) for f in os.listdir(local(path)) if ".warc" in f and not f.startswith("."))


def plain_records(data):
    """(fields, block) by the rules of the format, from uncompressed bytes."""
    out = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert rest[n:n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4:]
    return out


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "n") for r in rows], "page_id long, url string, html string, first int, digest string").repartition(5)


ROWS = [(5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (None, "u", "same"), (1, "x", "é" * 3000), (2, "y", ""), (4, "z", None), (7, "w", "b\r\n\r\nWARC/1.1\r\n"),
        (8, "twice", "t"), (8, "twice", "t"), (None, "v", "lost"), (None, "v", "lost"), (6, "q", "t" * 300_000)]


def wanted(rows):
    least = {}
    for i, _, html in rows:
        key = html or ""
        least[key] = min([x for x in (least.get(key), i) if x is not None], default=None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = least[html or ""]
        again = first is not None and first != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return Counter(out)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_and_format(spark, compression):
    path = shared_path(spark, "warc")
    warc.write_pages(pages(spark, ROWS), path, compression=compression)
    back = warc.read(spark, path, payload=True, verify=True)
    rows = back.collect()
    assert Counter((None if r["record_id"] == "<urn:page:>" else int(r["record_id"][10:-1]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                    int(r["refers_to"][10:-1]) if r["refers_to"] else None) for r in rows) == wanted(ROWS)
    texts = {i: (h or "").encode() for i, _, h in ROWS}
    for r in rows:
        assert (r["intact"], r["payload"] is not None) == ((None, False) if r["record_type"] == "revisit" else (True, True))
        if r["payload"] is not None and r["record_id"] != "<urn:page:>":
            assert bytes(r["payload"]) == texts[int(r["record_id"][10:-1])]
    # The files are archives to any reader: gzip members one after another, and the format's own rules.
    seen = []
    for name in archives(path):
        data = open(name, "rb").read()
        seen += plain_records(gzip.decompress(data) if compression == "gzip" else data)
    assert len(seen) == len(ROWS)
    for fields, block in seen:
        head, payload = block.split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() and head.endswith(b"Content-Length: %d" % len(payload))
        else:
            assert payload == b"" and fields["WARC-Refers-To"].startswith("<urn:page:") and fields["WARC-Profile"].endswith("identical-payload-digest")


def test_spans_begin_at_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "SPLIT", 300)
    rows = [(i, f"http://h/{i}", f"text {i} " * (i % 50)) for i in range(200)]
    for packed in (True, False):
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        batch = pages(spark, rows).select(F.lit("response").alias("record_type"), F.concat(F.lit("<urn:page:"), "page_id", F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"),
                                          F.lit(None).cast("string").alias("refers_to"), F.col("html").cast("binary").alias("payload")).toArrow()
        writer = warc.WarcWriter(path, packed, "2020-01-01T00:00:00Z", False)
        writer.commit([writer.write(iter(batch.to_batches()))])
        reader = warc.WarcReader(path, warc.StructType.fromDDL(warc.SCHEMA), True)
        spans = reader.partitions()
        assert len(spans) > 20 and spans[0].start == 0
        got = [r for s in spans for b in reader.read(s) for r in b.to_pylist()]
        assert sorted((r["record_id"], r["payload"]) for r in got) == sorted((f"<urn:page:{i}>", h.encode()) for i, _, h in rows) and all(r["intact"] for r in got)


def test_predicates_are_pushed_and_payloads_left_alone(spark, monkeypatch):
    path = shared_path(spark, "warc")
    warc.write_pages(pages(spark, ROWS), path)
    back = warc.read(spark, path)
    assert "payload" not in back.columns
    for condition in ("record_type = 'revisit'", "target_uri like 'http://a/%'", "target_uri is null", "record_type in ('revisit', 'metadata')", "not (target_uri = 'w')", "target_uri > 'u'",
                      "content_length >= 100", "refers_to is not null and record_type <> 'response'", "target_uri like '%ice'", "target_uri like '%a/%'", "payload_bytes > 10"):
        few = back.filter(condition)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert ("Filter (" in plan or "Filter N" in plan) == ("payload_bytes" in condition), (condition, plan)
        whole = warc.read(spark, path).cache()
        assert whole.count() == len(ROWS)
        assert Counter(few.collect()) == Counter(whole.filter(condition).collect()), condition
        whole.unpersist()
    # Refused records and payloads not asked for: hardly more than the headers is inflated.
    inflated = []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def decompress(self, data, limit=0):
            out = self.inner.decompress(data, limit)
            inflated.append(len(out))
            return out

    real = zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: Counted(real(*a)))
    data = warc.member(warc.record("response", "<urn:page:1>", "u", None, os.urandom(3_000_000).hex().encode(), "d")) + warc.member(warc.record("response", "<urn:page:2>", "v", None, b"end", "d"))
    name = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "one.warc.gz")
    with open(name, "wb") as file:
        file.write(data)
    reader = warc.WarcReader(name, warc.StructType.fromDDL(warc.SCHEMA.rsplit(",", 1)[0]), False, [warc.EqualTo(("target_uri",), "v")])
    rows = [r for s in reader.partitions() for b in reader.read(s) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["<urn:page:2>"] and sum(inflated) < 200_000


def test_foreign_archives(spark):
    """Files of other tools: no manifest, no member lengths, other record types, whole-file members, continuation lines."""
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 5\r\nX-Note: two\r\n lines\r\n\r\nhello\r\n\r\n"
    page = warc.record("response", "<urn:x:2>", "http://b", None, b"p" * 200_000, "2024-01-01T00:00:00Z")
    os.mkdir(f"{root}/deep")
    for name, data in {"a.warc": info + page, "deep/b.warc.gz": gzip.compress(info) + gzip.compress(page), "c.txt": b"none"}.items():
        with open(f"{root}/{name}", "wb") as file:
            file.write(data)
    back = warc.read(spark, root, payload=True, verify=True)
    got = Counter((r["record_type"], r["record_id"], r["payload_bytes"], r["intact"]) for r in back.collect())
    assert got == Counter([("response", "<urn:x:2>", 200_000, True), ("warcinfo", "<urn:x:1>", 5, None)] * 2)
    assert warc.read(spark, f"{root}/a.warc").filter("record_type = 'response'").count() == 1


def test_empty_table_and_second_append(spark):
    path = shared_path(spark, "warc")
    warc.write_pages(pages(spark, ROWS).limit(0), path)
    assert warc.read(spark, path).count() == 0
    warc.write_pages(pages(spark, ROWS[:2]), path)
    warc.write_pages(pages(spark, ROWS[4:5]), path)
    assert warc.read(spark, path).count() == 3
    with open(f"{local(path)}/left-over.warc", "wb") as file:  # a file no manifest names, as of a task that was lost
        file.write(b"WARC/1.1\r\n")
    assert warc.read(spark, path).count() == 3 and len(json.load(open(f"{local(path)}/{warc.MANIFEST}"))["files"]) >= 2


def test_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 4)
    rows = [(i, "u", "hot" if i % 3 == 0 else f"t{i // 4}") for i in range(300)]
    path = shared_path(spark, "warc")
    warc.write_pages(pages(spark, rows), path)
    got = warc.read(spark, path, verify=True).select(warc.page_id("record_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to"))
    assert Counter(map(tuple, got.collect())) == wanted(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    from pulsegrid.llm.queries import ORACLES, QUERIES

    duckdb.sql(f"create or replace view pages as select * from '/root/testdata/{sf}/pages.parquet'")
    rel = duckdb.sql(ORACLES["op11_page_archives"])
    got = QUERIES["op11_page_archives"](spark, f"/root/testdata/{sf}")
    assert Counter(map(tuple, got.select(rel.columns).collect())) == Counter(rel.fetchall())

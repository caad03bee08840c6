"""Registered queries of the numbered operators and the SQL that checks them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm import blocks, centroids, jaccard, langid, mixing, neighbours, packing, periods, pii, quality, secrets, shards, warc
from pulsegrid.llm.common import WORD, count_words, shared_path, table, write_once

Query = Callable[[SparkSession, str], DataFrame]


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.components(table(spark, sf_dir, "documents"), "doc_id", "text", jaccard.Rule(size=3, per_cent=90))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secret_spans", lambda s: s["kind"] != "random")
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[of(k) for k in secrets.KINDS], F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"),
                       secrets.listed(F.col("secret_spans")).alias("spans"))


def hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shards.assign(shards.assign(rows, "doc_id", 8), "doc_id", 9, "grown_shard")
    numbered = shards.number(placed, "shard", ["doc_id", "text_crc32", "size"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-blocks")
    blocks.write(table(spark, sf_dir, "documents"), path, "doc_id", "text")
    return blocks.read(spark, path)


def residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *[f"verdict.{c}" for c in (*quality.COUNTS, "base_failed", "kept", "score")])


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda s: ~s["disguised"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[of(k) for k in pii.KINDS], F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sources, identity = F.array("source"), ["doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    rows = write_once(docs.select("doc_id", "source", mixing.pattern_of(sources).alias("pattern"), mixing.order_of(*identity).alias("place"), count_words(F.col("text")).alias("size")), "mix")
    made = mixing.plan(rows)
    by_source = lambda values, kind: F.coalesce(
        F.create_map(*[F.lit(x) for s, v in values.items() if s is not None for x in (s, v)])[F.col("source")] if set(values) - {None} else F.lit(None).cast(kind), F.lit(values.get(None)).cast(kind))
    counted = mixing.copies(rows, made, "pattern", "place", "size", "copies")
    return counted.select("doc_id", "size", by_source(made.sizes, "long").alias("source_size"), by_source(made.targets, "double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding")


def page_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, verify=True)
    return found.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to").alias("refers_to"))


def centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centres = centroids.cluster(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    total = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    whole = None if None in sums.values() else sum(sums.values())
    long = lambda x: None if x is None or x >= 2**63 else int(x)
    facts = [(c, long(x), long(whole), hashlib.sha256(",".join(str(int(y)) for y in centres[c]).encode()).hexdigest()) for c, x in sums.items()]
    per = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def rewritten(text: Column, doc_id: Column) -> Column:
    """The text with its words from a place on repeating the first ones after that place, for about one id in ten; null for the other ids and where no word is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    made = F.transform(
        F.array(F.struct(words.alias("w"), F.floor(h / 10).alias("g"))),
        lambda x: F.transform(
            F.array(F.struct((x["g"] % F.size(x["w"])).cast("int").alias("a"))),
            lambda y: F.transform(
                F.array(F.struct((1 + F.floor((F.size(x["w"]) - y["a"]) / (3 + x["g"] % 8))).cast("int").alias("p"))),
                lambda z: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < y["a"], w).otherwise(F.get(x["w"], y["a"] + (i - y["a"]) % z["p"]))), " "),
            )[0],
        )[0],
    )[0]
    return F.when((h % 10 == 0) & text.rlike(WORD), made)


def period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.find(docs.withColumn("text", F.coalesce(rewritten(F.col("text"), F.col("doc_id")), "text")), "text").drop("text")
    best = found.withColumn("best", periods.strongest(F.col("runs")))
    exponent = F.floor(F.col("best.length") * 1000 / F.col("best.period"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
                       digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": ngram_jaccard,
    "op2_secret_scan": secret_scan,
    "op3_token_blocks": token_blocks,
    "op4_quality_rules": quality_rules,
    "op5_source_mix": source_mix,
    "op6_nearest_vectors": nearest_vectors,
    "op7_personal_data": personal_data,
    "op8_residual_packing": residual_packing,
    "op9_hash_tree_shards": hash_tree_shards,
    "op10_language_id": language_id,
    "op11_page_archives": page_archives,
    "op12_centroid_clusters": centroid_clusters,
    "op13_period_runs": period_runs,
}

#: Distinct shingles, all pairs that share one, and everything reachable by links: plain relational algebra over the whole table.
JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM worded
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared.n >= 90 * (a.n + b.n - shared.n)
),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reached r JOIN edges e ON e.x = r.other)
SELECT doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

#: Base32 of SHA-1 from its hexadecimal form, five digits (20 bits) to four letters; the least page of each payload.
ARCHIVES_SQL = r"""
WITH hashed AS (SELECT page_id, html, upper(sha1(coalesce(html, ''))) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
bits AS (
  SELECT page_id, html, first, list_transform(range(8), lambda i: list_reduce(list_transform(range(1, 6), lambda j: strpos('0123456789ABCDEF', h[5 * i + j]) - 1), lambda a, b: 16 * a + b)) AS chunks
  FROM hashed
)
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((chunks[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

#: Plain k-means in integers: every vector against every centroid in each of four assignments.
CENTROIDS_SQL = r"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16),
""" + "".join(f"""
a{n} AS (
  SELECT r, vec_id, v, c, d FROM (
    SELECT r, vec_id, kept.v, c, list_sum(list_transform(list_zip(kept.v, c{n}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept, c{n}
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
),
""" + (f"""
m{n} AS (
  SELECT c, list(s ORDER BY i) AS v FROM (
    SELECT c, i, CAST(sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS s FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY c, i
  ) GROUP BY c
),
c{n + 1} AS (SELECT c{n}.c, coalesce(m{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN m{n} ON m{n}.c = c{n}.c),
""" if n < 3 else "") for n in range(4)) + r"""
digests AS (SELECT c, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c3)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a3 JOIN digests USING (c)"""

ORACLES: dict[str, str] = {"op1_ngram_jaccard": JACCARD_SQL, "op11_page_archives": ARCHIVES_SQL, "op12_centroid_clusters": CENTROIDS_SQL}

"""N-gram Jaccard join with several global token orders.

A document is the set of its word shingles.  Documents with the same set are one *class*, named by a 64-bit digest of the set, so copies cost nothing further.
Two classes can only reach the similarity if their prefixes share a token, whatever global order sorts the tokens; so a candidate pair has to share one
under each of ``ORDERS`` orders, and only what all filters let through is verified on the whole sets.

* The orders are rare-first: tokens seen repeatedly come last, by the logarithm of their count in a sketch of fixed size, then by a hash of each order's own seed.
  The sketch is summed over the whole corpus; its resolution only affects how many candidates there are, never which links are found.
* Prefixes use the position filter: at the first shared token, what is left of both sets must still allow the required overlap.
* Bucket members meet their bucket's most central member first (the one with the fewest rarer tokens).  Verified links join classes into components; after that only members
  of *different* components meet.  Pairs inside a component cannot change the result, so a group of m near copies needs about m verifications instead of m squared.

Every pass is a scan of the documents or a join of small rows; the sets of classes without candidates are never shuffled. Components come from alternating
minimum-label and pointer-jumping joins, each round written to the shared folder.

Null texts and texts without words have no shingles: they link with nothing. Shorter texts have their whole word sequence as one shingle.  Repeated rows share a class.
A null id never names a component while another member has an id.  An empty table gives an empty result; a very long text is one slice of a task and costs about forty
times its bytes there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import Scratch, bound_batches, discard, fresh, give_back, shared_path, slices, with_facts, write_once
from pulsegrid.llm.words import SLICE, Texts, mix, shingle_sets

ORDERS = 3
#: Slots of the count sketch (bound of what is broadcast: 4 bytes each) and bits of the map of candidate classes.
SKETCH_SLOTS = 1 << 20
MAP_BITS = 1 << 24
#: Shingles that a task counts together before it reports those seen at least twice.
COUNTED_TOGETHER = 1_000_000

_SEEDS = np.random.RandomState(77).randint(1, 2**62, 16).astype(np.uint64)


@dataclass(frozen=True)
class Rule:
    """Shingle size and similarity ``per_cent`` / 100, compared in whole numbers."""

    size: int
    per_cent: int

    def overlap(self, a, b):
        """Least intersection of sets of sizes a and b that reaches the similarity."""
        return -(-self.per_cent * (a + b) // (100 + self.per_cent))

    def prefix(self, n):
        """Tokens of a set of size n that can be its first shared one: the partner has at least ``per_cent`` of n."""
        return n - (-(-self.per_cent * n // 100)) + 1


def _digests(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit name of each set: an order-free sum of remixed tokens, mixed with the size. Sets without tokens get 0."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _SEEDS[15]))])
    ends = np.cumsum(counts)
    out = mix((total[ends] - total[ends - counts]) ^ mix(counts.astype(np.uint64) * _SEEDS[14]))
    return np.where(counts > 0, out, np.uint64(0)).view(np.int64)


def _sets(batches, rule: Rule) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with their shingle hashes, counts and class names."""
    for batch in slices(batches, "text", SLICE):
        hashes, counts = shingle_sets(Texts(batch.column("text"), lower=True), rule.size)
        yield batch, hashes, counts, _digests(hashes, counts)
    give_back()


CLASSES = "id long, class long, n int, slots binary, times binary"


def _classes(rows: DataFrame, rule: Rule) -> DataFrame:
    """One row per document (id, class, n); rows with ``slots`` carry repeated tokens' sketch slots and counts instead."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, set()

        def counted() -> pa.RecordBatch:
            nonlocal held, size
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            again = times > 1
            slots, where = np.unique(tokens[again] % np.uint64(SKETCH_SLOTS), return_inverse=True)
            out = np.bincount(where, times[again], len(slots)) if len(slots) else np.empty(0)
            held, size = [], 0
            return pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32()),
                                    pa.array([slots.astype("<u4").tobytes()], pa.binary()), pa.array([out.astype("<u4").tobytes()], pa.binary())], names=["id", "class", "n", "slots", "times"])

        for batch, hashes, counts, names in _sets(batches, rule):
            yield pa.record_batch([batch.column("id").cast(pa.int64()), pa.array(names), pa.array(counts.astype(np.int32)), pa.nulls(len(names), pa.binary()), pa.nulls(len(names), pa.binary())],
                                  names=["id", "class", "n", "slots", "times"])
            new = np.fromiter((c not in known and not known.add(c) for c in names.tolist()), bool, len(names))
            held.append(hashes[np.repeat(new, counts)])
            size += len(held[-1])
            if size >= COUNTED_TOGETHER:
                yield counted()
                known.clear()
        if size:
            yield counted()
        give_back()

    return rows.mapInArrow(work, CLASSES)


def _sketch(classes: DataFrame) -> np.ndarray:
    """Summed counts by slot: at most SKETCH_SLOTS rows come back."""

    def spread(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slots, times in zip(batch.column("slots").to_pylist(), batch.column("times").to_pylist(), strict=True):
                yield pa.record_batch([pa.array(np.frombuffer(slots, "<u4").astype(np.int64)), pa.array(np.frombuffer(times, "<u4").astype(np.int64))], names=["slot", "times"])

    found = classes.filter("slots IS NOT NULL").select("slots", "times").mapInArrow(spread, "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(SKETCH_SLOTS, np.uint32)
    out[found.column("slot").to_numpy()] = np.minimum(found.column("times").to_numpy(), 2**32 - 1)
    return out


def _prefixes(hashes: np.ndarray, counts: np.ndarray, sketch: np.ndarray, rule: Rule, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix tokens of every set under one global order: token, owner, position."""
    owner = np.repeat(np.arange(len(counts)), counts)
    rank = mix(hashes ^ _SEEDS[order])
    seen = sketch[hashes % np.uint64(SKETCH_SLOTS)]
    common = np.where(seen > 0, np.floor(np.log2(np.maximum(seen, 1))) + 1, 0).astype(np.int8)
    by = np.lexsort((rank, common, owner))
    at = np.arange(len(by)) - np.repeat(np.cumsum(counts) - counts, counts)
    first = at < rule.prefix(counts)[owner]
    return hashes[by][first], owner[first], at[first]


TOKENS = "token long, class long, n int, at int"


def _tokens(rows: DataFrame, rule: Rule, sketch: Broadcast) -> DataFrame:
    """Prefix tokens of the first order; a class once per task."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        known = set()
        for _, hashes, counts, names in _sets(batches, rule):
            new = np.fromiter((c not in known and not known.add(c) for c in names.tolist()), bool, len(names)) & (counts > 0)
            hashes, counts, names = hashes[np.repeat(new, counts)], counts[new], names[new]
            token, owner, at = _prefixes(hashes, counts, sketch.value, rule, 0)
            yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(names[owner]), pa.array(counts[owner].astype(np.int32)), pa.array(at.astype(np.int32))], names=["token", "class", "n", "at"])

    return rows.mapInArrow(work, TOKENS)


def _map_slot(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(MAP_BITS))


def _marked(wanted: DataFrame) -> np.ndarray:
    """Bit map over the slots of the ids wanted: at most MAP_BITS / 64 rows come back, whatever their number."""
    word, bit = F.floor(F.col("slot") / 64).cast("long"), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    found = wanted.select(_map_slot(F.col("id")).alias("slot")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MAP_BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _told_apart(rows: DataFrame, key: str, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in no row of ``facts``, and the others, with a few that share a slot of the bit map."""
    marked = rows.sparkSession.sparkContext.broadcast(_marked(facts.select(F.col(key).alias("id"))))

    @F.arrow_udf("boolean")
    def hit(slots: pa.Array) -> pa.Array:
        slot = slots.to_numpy(zero_copy_only=False)
        return pa.array(((marked.value[slot // 64] >> (slot % 64)) & 1).astype(bool))

    found = hit(_map_slot(F.col(key)))
    return rows.filter(~found), rows.filter(found)


PREFIXES = "class long, " + ", ".join(f"order{k} array<long>" for k in range(1, ORDERS))
SETS = "class long, tokens binary"


def _of_marked(rows: DataFrame, rule: Rule, sketch: Broadcast, marked: Broadcast, whole: bool) -> DataFrame:
    """The whole sets of the marked documents, or their prefixes under the further orders."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        known = set()
        for batch, hashes, counts, names in _sets(batches, rule):
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            hit = ((marked.value[slot // 64] >> (slot % 64)) & 1).astype(bool) & (counts > 0)
            hit[hit] = [c not in known and not known.add(c) for c in names[hit].tolist()]
            if not hit.any():
                continue
            mine = hashes[np.repeat(hit, counts)]
            own, ends = counts[hit], np.cumsum(counts[hit])
            columns = [pa.array(names[hit])]
            if whole:
                columns.append(pa.array([mine[e - n:e].astype("<u8").tobytes() for e, n in zip(ends.tolist(), own.tolist(), strict=True)], pa.binary()))
            for k in range(1, ORDERS) if not whole else ():
                token, owner, _ = _prefixes(mine, own, sketch.value, rule, k)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(own)))]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(token.view(np.int64))))
            yield pa.record_batch(columns, names=[c.split()[0] for c in (SETS if whole else PREFIXES).split(", ")])

    return rows.withColumn("slot", _map_slot(F.col("id"))).mapInArrow(work, SETS if whole else PREFIXES)


def _both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) with the facts of both classes as a_ and b_ columns."""
    side = lambda name: facts.select(F.col("class").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in facts.columns if c != "class"])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def _intersected(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs that share a prefix token under every further order."""
    met = _both(pairs, prefixes)
    for k in range(1, ORDERS):
        met = met.filter(F.arrays_overlap(f"a_order{k}", f"b_order{k}"))
    return met.select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose whole sets reach the similarity."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a.as_buffer(), "<u8"), np.frombuffer(b.as_buffer(), "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= rule.per_cent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return _both(pairs, sets).filter(similar("a_tokens", "b_tokens")).select("a", "b")


def _may_reach(rule: Rule, a: str, b: str) -> Column:
    """Position filter for a token shared at places ``at`` of sets of size ``n``; a link passes it at its first shared token."""
    need = F.ceil(F.lit(rule.per_cent) * (F.col(f"{a}.n") + F.col(f"{b}.n")) / F.lit(100 + rule.per_cent) - F.lit(1e-9))
    return F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at")) >= need


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph (a, b): rows (node, label) with the least node as label, for every node that has an edge.

    Alternating large-star and small-star steps; every round is written, and ends when it changes nothing.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    before = held = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        path, made = shared_path(spark, "components"), small.select("e.a", "e.b").filter("a <> b").distinct()
        made.write.parquet(path)
        edges = spark.read.schema(made.schema).parquet(path)
        if held is not None:
            discard(spark, held)
        state, held = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()), path
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


@dataclass
class Joined:
    """``docs``: id, class, n of every document; ``links``: pairs (a, b) of classes."""

    docs: DataFrame
    links: DataFrame


def join(df: DataFrame, id_column: str, text_column: str, rule: Rule, every_link: bool = True) -> Joined:
    """Links between classes. With ``every_link`` all of them; without, enough of them to connect what belongs together."""
    spark = df.sparkSession
    bound_batches(spark)
    context, scratch = spark.sparkContext, Scratch(spark)
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    level = write_once(_classes(rows, rule), "jaccard-classes")
    docs = level.filter("slots IS NULL").select("id", "class", "n")
    sketch = context.broadcast(_sketch(level))

    # Dealt out by token once: the buckets where a pair may link are found, and their rows picked, from the same exchange, without holding any bucket.
    # A bucket of two rows, by far the most frequent kind, is decided at once by the position filter; larger ones are kept.
    tokens = _tokens(rows, rule, sketch).repartition("token")
    member = F.struct("class", "n", "at")
    met = tokens.groupBy("token").agg(F.min(member).alias("x"), F.max(member).alias("y"), F.count(F.lit(1)).alias("rows"))
    met = met.filter((F.col("x.class") < F.col("y.class")) & ((F.col("rows") > 2) | _may_reach(rule, "x", "y"))).select("token")
    shared = scratch.write(tokens.join(met, "token").dropDuplicates(["token", "class"]), "jaccard-shared")

    def of_classes(pairs: DataFrame, whole: bool) -> DataFrame:
        """Prefixes or whole sets of the classes in these pairs, by one more scan of the documents that stand for them."""
        mates = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
        marked = context.broadcast(_marked(docs.groupBy("class").agg(F.min("id").alias("id")).join(mates, "class", "left_semi")))
        return scratch.write(_of_marked(rows, rule, sketch, marked, whole).join(mates, "class", "left_semi").dropDuplicates(["class"]), "jaccard-sets")

    def filtered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs that all orders let through, judged on short prefixes, and the whole sets of what is left."""
        pairs = scratch.write(pairs.distinct(), "jaccard-pairs")
        left = scratch.write(_intersected(pairs, of_classes(pairs, whole=False)), "jaccard-pairs")
        return left, of_classes(left, whole=True)

    def linked(links: DataFrame) -> DataFrame:
        return scratch.write(connected(links).withColumnRenamed("node", "class"), "jaccard-labels")

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components."""
        of = lambda c: labels.select(F.col("class").alias(c), F.col("label").alias(f"{c}_label"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")

    def meeting(frame: DataFrame, key: str) -> DataFrame:
        """Pairs of classes that share a bucket, differ in ``key`` and pass the position filter."""
        side = lambda name: frame.select("token", F.struct("class", "n", "at", "label").alias(name))
        pairs = side("x").join(side("y"), "token").filter((F.col(f"x.{key}") < F.col(f"y.{key}")) & _may_reach(rule, "x", "y"))
        return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"))

    if every_link:
        left, sets = filtered(meeting(shared.withColumn("label", F.col("class")), "class"))
        links = write_once(_verified(left, sets, rule), "jaccard-links")
        scratch.clear()
        return Joined(docs, links)
    centres = shared.groupBy("token").agg(F.min(F.struct("at", "n", "class")).alias("y"))
    star = shared.select("token", F.struct("class", "n", "at").alias("x")).join(centres, "token").filter((F.col("x.class") != F.col("y.class")) & _may_reach(rule, "x", "y"))
    left, sets = filtered(star.select(F.col("y.class").alias("a"), F.col("x.class").alias("b")))
    # A member of a large group meets many centres of the same group: one of them is verified first, the rest only where it did not connect them.
    first = left.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = write_once(_verified(first, sets, rule), "jaccard-links")
    second = write_once(_verified(apart(left, linked(links)), sets, rule), "jaccard-links")
    links = links.unionByName(second)
    labelled = shared.join(linked(links), "class", "left").withColumn("label", F.coalesce("label", "class"))
    left, sets = filtered(meeting(labelled, "label"))
    links = links.unionByName(write_once(_verified(left, sets, rule), "jaccard-links"))
    scratch.clear()
    return Joined(docs, links)


def components(df: DataFrame, id_column: str, text_column: str, rule: Rule) -> DataFrame:
    """One row per document: id, n (set size), component_id (least id of all documents that links connect it with; its own without any).

    Classes are named by their least id before they are connected, so a component's label is its answer and nothing is gathered or joined by component.
    """
    joined = join(df, id_column, text_column, rule, every_link=False)
    whole = joined.docs.filter("n > 0")
    # Classes without any id come last and are told apart by their name.
    node = F.struct(F.col("id").isNull().alias("last"), F.coalesce("id", "class").alias("id"))
    classes = write_once(whole.groupBy("class").agg(F.min(node).alias("node"), F.count(F.lit(1)).alias("docs")), "jaccard-nodes")
    of = lambda c: classes.select(F.col("class").alias(c), F.col("node").alias(f"{c}_node"))
    edges = joined.links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    least = lambda c: F.when(~F.col(f"{c}.last"), F.col(f"{c}.id"))
    named = classes.join(connected(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
    facts = write_once(named.select("class", "docs", least("label").alias("component_id")), "jaccard-components")
    found = with_facts(whole, facts, "class", "docs").select("id", F.col("n").cast("long").alias("n"), "component_id")
    return found.unionByName(joined.docs.filter("n = 0").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id")))


def keep_one(df: DataFrame, id_column: str, text_column: str, rule: Rule) -> DataFrame:
    """One row of each component: the one of least id (null last), then of least hash of id and text; of rows equal in both, the least in all columns.

    Rows are told apart by a 64-bit hash of id and text, so different texts under one id are judged one by one.  Rows without words all stay.  Columns must be orderable.
    """
    columns, key = df.columns, fresh(df, "_key")
    keyed = df.withColumn(key, F.xxhash64(id_column, text_column))
    joined = join(keyed, key, text_column, rule, every_link=False)
    counted = joined.docs.filter("n > 0").groupBy(F.col("id").alias("key"), "class").agg(F.count(F.lit(1)).alias("rows"))
    ids = keyed.groupBy(F.col(key).alias("key")).agg(F.min(F.col(id_column).cast("long")).alias("doc"))
    keys = write_once(counted.join(ids, "key"), "jaccard-keys")
    node = F.struct(F.col("doc").isNull().alias("last"), F.coalesce("doc", F.lit(0)).alias("doc"), "key")
    classes = write_once(keys.groupBy("class").agg(F.min(node).alias("node"), F.count(F.lit(1)).alias("docs")), "jaccard-nodes")
    of = lambda c: classes.select(F.col("class").alias(c), F.col("node").alias(f"{c}_node"))
    edges = joined.links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    kept = classes.join(connected(edges), "node", "left").select("class", "docs", F.coalesce("label", "node")["key"].alias("kept"))
    judged = with_facts(keys.select("key", "rows", "class"), write_once(kept, "jaccard-kept"), "class", "docs")
    verdict = write_once(judged.filter("key <> kept OR rows > 1").select(F.col("key").alias(key), "rows", (F.col("key") != F.col("kept")).alias("_gone")), "jaccard-verdicts")
    # Most rows have no verdict: they are told by a bit map of fixed size and stay where they are; only the others' texts are shuffled.
    plain, others = _told_apart(keyed, key, verdict)
    marked = with_facts(others, verdict, key, "rows")
    once = marked.filter("NOT _gone").groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return plain.select(*columns).unionByName(marked.filter("_gone IS NULL").select(*columns)).unionByName(once)

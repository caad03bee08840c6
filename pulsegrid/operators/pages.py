"""Pages put together from placed pieces of every kind, in a fixed order, as documents of bounded size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.rational import int_div
from pulsegrid.operators.scan import sized_scan

PAGE = ["score_id", "page_index"]
#: Pieces of one document; longer pages are split into numbered documents, no piece is dropped.
DOCUMENT_PIECES = 10_000

# Kinds in page order, each with what orders its pieces inside a system: two numbers and a text (None where there is none).
ORDERS = {
    "bounds": (None, None, None),
    "layer": ("measure_index", "offset", None),
    "wave": ("measure_index", "offset", None),
    "pivot": ("pivot_index", None, None),
    "node": ("onset", "node_index", None),
    "branch": ("branch_index", None, "span_role"),
}
_SORT = ["kind_order", "system_index", "first", "second", "role"]


def page_pieces(kinds: dict[str, DataFrame]) -> DataFrame:
    """Placed pieces of all kinds in one shape: page, kind, order columns and the piece's own columns as JSON.

    Pieces without a position (no page, or a reason) are left out; they stay in the missing reports.  Each frame is reduced to these columns before the union, so
    the kinds meet in one exchange instead of one join per kind.
    """
    def rows(kind: str, df: DataFrame) -> DataFrame:
        first, second, role = ORDERS[kind]
        number = lambda c: F.col(c).cast("bigint") if c else F.lit(0).cast("bigint")
        found = df.filter("page_index IS NOT NULL")
        found = found.filter("reason IS NULL").drop("reason") if "reason" in df.columns else found
        body = F.to_json(F.struct(*[F.col(c) for c in found.columns if c not in PAGE]))
        return found.select(
            "score_id", F.col("page_index").cast("int").alias("page_index"), F.lit(list(ORDERS).index(kind)).alias("kind_order"), F.lit(kind).alias("kind"),
            F.col("system_index").cast("int").alias("system_index"), number(first).alias("first"), number(second).alias("second"),
            F.coalesce(F.col(role) if role else F.lit(""), F.lit("")).alias("role"), body.alias("body"))

    return reduce(DataFrame.unionByName, (rows(kind, kinds[kind]) for kind in ORDERS if kind in kinds))


def page_places(pieces: DataFrame) -> DataFrame:
    """Place of every piece on its page, from 0: kinds in order, then system, then the kind's own order."""
    rows, scan = sized_scan(pieces, PAGE, [*_SORT, "body"])
    return scan.number(rows, "place").drop(*([scan.chunk] if scan.chunk else []))


def page_documents(pieces: DataFrame, size: int = DOCUMENT_PIECES) -> DataFrame:
    """Documents (score_id, page_index, document, pieces in order): at most ``size`` pieces each, whatever a page holds."""
    placed = page_places(pieces).withColumn("document", int_div(F.col("place"), size).cast("int"))
    piece = F.struct("place", "kind", "system_index", "first", "second", "role", "body")
    return placed.groupBy(*PAGE, "document").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))

"""One-dimensional clustering: gap clusters, medoids, running-centroid columns, largest-gap boundaries, bounds and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.rational import int_div
from pulsegrid.operators.scan import Scan

_RANK_BLOCK = 1 << 16


def gap_clusters(rows: DataFrame, scan: Scan, value: str, tolerance: Column, name: str = "cluster") -> DataFrame:
    """New cluster wherever the step from the previous value exceeds the tolerance (zero-based index per key)."""
    stepped = scan.neighbour(rows, -1, _before=F.col(value))
    starts = F.coalesce((F.col(value) - F.col("_before") > tolerance).cast("int"), F.lit(0))
    return scan.running(stepped, **{name: ("sum", starts)}).drop("_before")


def medoids(clustered: DataFrame, scan: Scan, value: str, identity: str) -> DataFrame:
    """Member with the least total distance to its cluster, ties by identity; no pairs are formed.

    ``scan`` must order the members of a cluster by ``value``.  With r members up to v (their sum P), n members in all (sum T), the total
    distance of v is v*(2r - n) + T - 2P.
    """
    ranked = scan.running(clustered, _r=("count", F.lit(1)), _p=("sum", F.col(value)))
    keys = list(scan.keys)
    if scan.chunk is None:
        whole = Window.partitionBy(*keys)
        sized = ranked.withColumns({"_m": F.count(F.lit(1)).over(whole), "_t": F.sum(value).over(whole)})
    else:
        totals = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.sum(value).alias("_t"))
        sized = ranked.join(totals, keys)
    distance = F.col(value) * (2 * F.col("_r") - F.col("_m")) + F.col("_t") - 2 * F.col("_p")
    return sized.withColumn("_d", distance).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(identity).alias("medoid"), F.col(value).alias("medoid_value")), F.struct("_d", identity)).alias("_best"),
        F.min("_d").alias("total_distance"), F.count(F.lit(1)).alias("members"),
    ).select(*keys, "_best.*", "total_distance", "members")


def centroid_columns(values: DataFrame, scan: Scan, value: str, weight: str, tolerance: Column) -> DataFrame:
    """Join a value to the open column while it is within tolerance of the column's mean so far, else open a new column.

    Takes distinct values with a weight (equal values always share a column).  A step above the tolerance always opens a column, so the
    order-dependent fold runs inside gap islands only.
    """
    keys = list(scan.keys)
    islands = gap_clusters(values.withColumn("_tol", tolerance), scan, value, F.col("_tol"), "_island")
    start = F.array().cast("array<struct<first:double,last:double,total:double,n:bigint>>")
    item = lambda first, last, total, n: F.struct(first.alias("first"), last.alias("last"), total.alias("total"), n.alias("n"))

    def step(acc: Column, v: Column) -> Column:
        x, w = v["x"].cast("double"), v["w"].cast("bigint")
        open_ = F.element_at(acc, -1)
        fresh = F.array_append(acc, item(x, x, x * w, w))
        grown = F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), item(open_["first"], x, open_["total"] + x * w, open_["n"] + w))
        near = F.abs(x - open_["total"] / open_["n"]) <= v["tol"]
        return F.when(F.size(acc) == 0, fresh).when(near, grown).otherwise(fresh)

    folded = islands.groupBy(*keys, "_island").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct(F.col(value).alias("x"), F.col(weight).alias("w"), F.col("_tol").alias("tol")))), start, step).alias("_c")
    )
    opened = folded.select(*keys, F.explode("_c").alias("_c")).select(
        *keys, F.col("_c.first").alias("first_value"), F.col("_c.last").alias("last_value"),
        (F.col("_c.total") / F.col("_c.n")).alias("centroid"), F.col("_c.n").alias("members"),
    )
    return Scan(scan.keys, ("first_value",)).number(opened, "column_index")


def largest_gap_systems(rows: DataFrame, scan: Scan, centre: Column, top: Column, wanted: str, name: str = "system_index") -> DataFrame:
    """Split each ordered key into ``wanted`` systems at its largest gaps (ties: the later gap wins).

    The gap after a row is ``top`` of the next row minus ``centre`` of the row.  Candidates are first ranked inside blocks of the order, so
    a hot key never ranks in one task more than blocks * (wanted - 1) rows.
    """
    keys = list(scan.keys)
    numbered = scan.number(rows.withColumns({"_here": centre, "_top": top}), "_index")
    stepped = scan.neighbour(numbered, +1, _next=F.col("_top")).withColumn("_step", F.col("_next") - F.col("_here"))
    largest = [F.col("_step").desc(), F.col("_index").desc()]
    blocks = Window.partitionBy(*keys, int_div(F.col("_index"), _RANK_BLOCK)).orderBy(*largest)
    local = stepped.filter("_step IS NOT NULL").select(*keys, "_index", "_step", wanted).withColumn("_rank", F.row_number().over(blocks))
    overall = Window.partitionBy(*keys).orderBy(*largest)
    chosen = (
        local.filter(F.col("_rank") < F.col(wanted)).withColumn("_rank", F.row_number().over(overall))
        .filter(F.col("_rank") < F.col(wanted)).select(*keys, "_index", F.lit(1).alias("_cut"))
    )
    flagged = stepped.join(chosen, [*keys, "_index"], "left").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    return scan.running(flagged, exclusive=True, **{name: ("sum", F.col("_cut"))}).drop("_here", "_top", "_next", "_step", "_cut", "_index")


def guard_bounds(systems: DataFrame, page_keys: list[str], system: str) -> DataFrame:
    """Bounds of each system and the guard line halfway to the next system's top (its own bottom for the last one)."""
    boxes = systems.groupBy(*page_keys, system).agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"))
    below = F.lead("top").over(Window.partitionBy(*page_keys).orderBy("top", system))
    return boxes.withColumn("guard_bottom", F.coalesce((F.col("bottom") + below) / 2, F.col("bottom")))

"""Page layout from notehead boxes and row projections: staves, systems, attack columns, bounds, five-line frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.notation import is_notehead
from pulsegrid.operators.clusters import centroid_columns, gap_clusters, guard_bounds, largest_gap_systems
from pulsegrid.operators.scan import Scan
from pulsegrid.session import write_table

PAGE = ["score_id", "page_index"]
SYSTEM = [*PAGE, "system_index"]

# Raster file endings, in lower case.
RASTER_ENDINGS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")


def noteheads(symbols: DataFrame) -> DataFrame:
    return symbols.filter(is_notehead(F.col("shape")) & (F.col("w") > 0) & (F.col("h") > 0)).withColumns({
        "cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})


def interline(keys: list[str], size: str, factor: float) -> Column:
    """Median positive interline of the key, else the median symbol size times a factor (8 at least)."""
    whole = Window.partitionBy(*keys)
    stated = F.median(F.when(F.col("interline") > 0, F.col("interline"))).over(whole)
    return F.coalesce(stated, F.greatest(F.lit(8.0), F.median(size).over(whole) * factor))


def page_scale(pages: DataFrame) -> DataFrame:
    """Image pixels per annotation unit of each page; 1 where the annotation states no size."""
    ratio = lambda image, note: F.when(F.coalesce(F.col(note), F.lit(0.0)) > 0, F.col(image) / F.col(note)).otherwise(F.lit(1.0))
    return pages.select(*PAGE, "width", "height", ratio("width", "annotation_width").alias("scale_x"), ratio("height", "annotation_height").alias("scale_y"))


def staff_clusters(heads: DataFrame) -> DataFrame:
    """Noteheads in vertical bands: a new band where centres step further than 4.5 interlines (18 at least)."""
    measured = heads.withColumn("_il", interline(PAGE, "h", 1.5))
    measured = measured.withColumn("_far", F.greatest(F.lit(18.0), F.col("_il") * 4.5))
    return gap_clusters(measured, Scan(tuple(PAGE), ("cy", "symbol_id")), "cy", F.col("_far"), "staff_cluster").drop("_far")


def system_clusters(heads: DataFrame, expected: DataFrame) -> DataFrame:
    """System of every notehead: the expected number of systems cut at the largest gaps between bands, else wide vertical gaps."""
    banded = write_table(staff_clusters(heads), "banded")
    bands = banded.groupBy(*PAGE, "staff_cluster").agg(F.max(F.col("y") + F.col("h")).alias("_bottom"), F.min("y").alias("_top"))
    wanted = bands.join(expected.filter("expected_systems > 0"), PAGE)
    counted = wanted.withColumn("_want", F.least("expected_systems", F.count(F.lit(1)).over(Window.partitionBy(*PAGE))))
    cut = largest_gap_systems(counted, Scan(tuple(PAGE), ("staff_cluster",)), F.col("_bottom"), F.col("_top"), "_want")
    by_band = cut.select(*PAGE, "staff_cluster", F.col("system_index").alias("_sys"))
    wide = banded.withColumn("_far", F.greatest(F.lit(30.0), F.col("_il") * 16.0))
    plain = gap_clusters(wide, Scan(tuple(PAGE), ("cy", "symbol_id")), "cy", F.col("_far"), "_plain")
    return plain.join(by_band, [*PAGE, "staff_cluster"], "left").withColumn("system_index", F.coalesce("_sys", "_plain").cast("int")).drop("_sys", "_plain", "_far", "_il")


def attack_columns(heads: DataFrame) -> DataFrame:
    """Columns of a system: a head joins while it is within a third of an interline (or about half a width) of the column's mean."""
    measured = heads.withColumns({"_il": interline(SYSTEM, "w", 1.3), "_mw": F.median("w").over(Window.partitionBy(*SYSTEM))})
    near = F.greatest(F.lit(2.5), F.least(F.col("_il") * 0.34, F.col("_mw") * 0.55))
    values = measured.withColumn("_near", near).groupBy(*SYSTEM, "cx").agg(F.count(F.lit(1)).alias("_n"), F.first("_near").alias("_near"))
    return centroid_columns(values, Scan(tuple(SYSTEM), ("cx",)), "cx", "_n", F.col("_near"))


def column_members(heads: DataFrame, columns: DataFrame) -> DataFrame:
    """Column of every head: the last one that starts at or before its centre, found in one ordered pass over heads and column starts.

    Columns of a system do not overlap and every centre lies in one, so the start decides alone and no head meets a column it is not in.
    """
    starts = columns.select(*SYSTEM, F.col("first_value").alias("cx"), F.col("column_index").alias("_start"))
    order = Window.partitionBy(*SYSTEM).orderBy("cx", F.col("_start").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = heads.withColumn("_head", F.lit(True)).unionByName(starts, allowMissingColumns=True)
    return passed.withColumn("column_index", F.last("_start", ignorenulls=True).over(order)).filter("_head").drop("_head", "_start")


def physical_groups(symbols: DataFrame, pages: DataFrame, expected: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """Attack columns with their system's bounds in image pixels; five-line bands widen the bounds where their number agrees.

    Heads with their system are written once; columns, membership and bounds all read that copy, and everything behind the column starts shares one exchange by system.
    """
    heads = write_table(system_clusters(noteheads(symbols), expected).join(page_scale(pages), PAGE).select(
        *SYSTEM, "symbol_id", "x", "y", "w", "h", "interline", "cx", "cy", "scale_x", "scale_y"), "heads")
    system = Window.partitionBy(*SYSTEM)
    extent = {"system_top": F.min("y").over(system) * F.col("scale_y"), "system_bottom": F.max(F.col("y") + F.col("h")).over(system) * F.col("scale_y"),
              "system_left": F.min("x").over(system) * F.col("scale_x"), "system_right": F.max(F.col("x") + F.col("w")).over(system) * F.col("scale_x")}
    groups = column_members(heads, attack_columns(heads)).withColumns(extent).groupBy(*SYSTEM, F.col("column_index").alias("group_index")).agg(
        (F.avg("cx") * F.first("scale_x")).alias("cx"), (F.avg("cy") * F.first("scale_y")).alias("cy"), F.count(F.lit(1)).alias("heads"), *[F.first(c).alias(c) for c in extent])
    if bands is None:
        return groups
    found = groups.groupBy(*PAGE).agg(F.count_distinct("system_index").alias("n"))
    agreeing = found.join(bands.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")), [*PAGE, "n"]).select(*PAGE)
    return groups.join(bands.join(agreeing, PAGE), SYSTEM, "left").withColumns({
        "system_top": F.least("system_top", "top"), "system_bottom": F.greatest("system_bottom", "bottom")}).drop("top", "bottom")


def system_bounds(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Normalised bounds of every system with the guard line below it."""
    boxes = groups.select(*SYSTEM, F.col("system_top").alias("top"), F.col("system_bottom").alias("bottom"), F.col("system_left").alias("left"), F.col("system_right").alias("right"))
    guarded = guard_bounds(boxes, PAGE, "system_index").join(pages.select(*PAGE, "width", "height"), PAGE, "left")
    w, h = F.coalesce("width", F.lit(1.0)), F.coalesce("height", F.lit(1.0))
    return guarded.select(*SYSTEM, *[(F.col(c) / h).alias(f"{c}_norm") for c in ("top", "bottom", "guard_bottom")], *[(F.col(c) / w).alias(f"{c}_norm") for c in ("left", "right")])


def page_images(pages: DataFrame, members: DataFrame) -> DataFrame:
    """Image member of every page: exact path, else the first of the same base name, else the Nth raster in name order."""
    ref = F.replace(F.coalesce("image_ref", F.lit("")), F.lit("\\"), F.lit("/"))
    base = lambda path: F.lower(F.element_at(F.split(path, "/"), -1))
    asked = pages.withColumns({"_ref": ref, "_base": base(ref)})
    exact = members.select("score_id", F.col("member").alias("_ref"), F.col("member").alias("_exact"))
    named = members.groupBy("score_id", base(F.col("member")).alias("_base")).agg(F.min_by("member", "member_ord").alias("_named"))
    raster = members.filter(F.lower("member").rlike("(" + "|".join(e.replace(".", r"\.") for e in RASTER_ENDINGS) + ")$")).withColumn("_key", F.lower("member"))
    nth = Scan(("score_id",), ("_key", "member_ord")).number(raster, "page_index").select("score_id", F.col("page_index").cast("int").alias("page_index"), F.col("member").alias("_nth"))
    joined = asked.join(exact, ["score_id", "_ref"], "left").join(named, ["score_id", "_base"], "left").join(nth, ["score_id", "page_index"], "left")
    asked_for = F.col("_ref") != ""
    return joined.withColumn("member", F.coalesce(F.when(asked_for, F.col("_exact")), F.when(asked_for, F.col("_named")), F.col("_nth"))).drop("_ref", "_base", "_exact", "_named", "_nth")


def staff_frames(projection: DataFrame) -> DataFrame:
    """Five equally spaced dark lines per staff, strongest non-overlapping frames first, from a (page, y, dark_fraction) table."""
    whole = Window.partitionBy(*PAGE)
    cut = F.greatest(F.lit(0.14), F.least(F.lit(0.42), F.percentile("dark_fraction", F.lit(0.995)).over(whole) * 0.48))
    dark = projection.withColumn("_cut", cut).filter("dark_fraction >= _cut")
    lines = gap_clusters(dark, Scan(tuple(PAGE), ("y",)), "y", F.lit(2), "_line").groupBy(*PAGE, "_line").agg(
        F.avg("y").alias("c"), F.max("dark_fraction").alias("s"), F.first("_cut").alias("_cut"))
    order = Window.partitionBy(*PAGE).orderBy("_line")
    five = lines.withColumns({f"c{k}": F.lead("c", k).over(order) for k in range(1, 5)} | {f"s{k}": F.lead("s", k).over(order) for k in range(1, 5)}).filter("c4 IS NOT NULL")
    centres = ["c", "c1", "c2", "c3", "c4"]
    gaps = F.array_sort(F.array(*[F.col(b) - F.col(a) for a, b in zip(centres, centres[1:])]))
    spaced = five.withColumn("_g", gaps).withColumn("spacing", (F.get("_g", F.lit(1)) + F.get("_g", F.lit(2))) / 2)
    worst = F.greatest(F.abs(F.get("_g", F.lit(0)) - F.col("spacing")), F.abs(F.get("_g", F.lit(3)) - F.col("spacing")))
    strength = (F.col("s") + F.col("s1") + F.col("s2") + F.col("s3") + F.col("s4")) / 5.0
    fit = spaced.withColumn("score", strength).filter(
        (F.col("spacing") >= 3.0) & (F.col("spacing") <= 45.0) & (worst <= F.greatest(F.lit(1.6), F.col("spacing") * 0.28))
        & (F.col("score") >= F.greatest(F.lit(0.12), F.col("_cut") * 0.82)))
    frame = F.struct((-F.col("score")).alias("rank"), F.col("c").alias("top"), F.col("c4").alias("bottom"), "spacing")

    def keep(chosen: Column, cand: Column) -> Column:
        half = cand["spacing"] * 0.5
        clash = F.exists(chosen, lambda x: ~((cand["bottom"] < x["top"] - half) | (cand["top"] > x["bottom"] + half)))
        return F.when(clash, chosen).otherwise(F.array_append(chosen, cand))

    empty = F.array().cast("array<struct<rank:double,top:double,bottom:double,spacing:double>>")
    chosen = fit.groupBy(*PAGE).agg(F.aggregate(F.array_sort(F.collect_list(frame)), empty, keep).alias("_f"))
    return chosen.select(*PAGE, F.explode("_f").alias("_f")).select(
        *PAGE, ((F.col("_f.top") + F.col("_f.bottom")) / 2.0).alias("center"), F.col("_f.spacing").alias("spacing"),
        F.col("_f.top").alias("line_top"), F.col("_f.bottom").alias("line_bottom"))


def frame_bands(frames: DataFrame, pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Frames grouped into the expected number of systems at the largest centre steps, widened by 1.8 spacings."""
    scale = F.least(F.lit(1.0), F.lit(1800.0) / F.greatest(F.col("width"), F.lit(1.0)))
    sized = frames.join(pages.select(*PAGE, "width", "height"), PAGE).withColumn("_inv", 1.0 / scale)
    margin = F.col("spacing") * F.col("_inv") * 1.8
    wide = sized.withColumns({
        "top": F.greatest(F.lit(0.0), F.col("line_top") * F.col("_inv") - margin),
        "bottom": F.least(F.col("height").cast("double"), F.col("line_bottom") * F.col("_inv") + margin), "_c": F.col("center") * F.col("_inv")})
    wanted = wide.join(expected.filter("expected_systems > 0"), PAGE).withColumn("_want", F.least("expected_systems", F.count(F.lit(1)).over(Window.partitionBy(*PAGE))))
    cut = largest_gap_systems(wanted, Scan(tuple(PAGE), ("_c",)), F.col("_c"), F.col("_c"), "_want")
    return cut.groupBy(*SYSTEM).agg(F.min_by("top", "_c").alias("top"), F.max_by("bottom", "_c").alias("bottom"))

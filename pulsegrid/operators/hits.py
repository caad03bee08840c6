"""Attacks merged by onset, and the text keys of a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.rational import rational_text


def merge_hits(attacks: DataFrame) -> DataFrame:
    """One hit per (score, onset): longest duration, place of the first source, distinct pitches, tuplet marks.

    Every aggregate combines on the map side, so an onset shared by many attacks costs one partial row per task; the attacks
    themselves stay in their own table under the same (score_id, onset) key.  ``doc_rank`` (part-major document order) must be unique.
    """
    columns = attacks.columns
    place = [c for c in ("measure_index", "measure_number", "offset") if c in columns]
    first = F.min(F.struct("doc_rank", *place))
    aggregates: list[Column] = [F.max("duration").alias("duration"), first.alias("_first"), F.count(F.lit(1)).alias("source_count")]
    aggregates.append(F.array_sort(F.collect_set("pitch")).alias("pitches"))
    if "tuplet_actual" in columns:
        mark = F.struct(
            F.col("tuplet_actual").cast("int").alias("actual"), F.col("tuplet_normal").cast("int").alias("normal"),
            F.col("duration").cast("bigint").alias("duration"),
        )
        aggregates.append(F.array_sort(F.collect_set(F.when(F.col("tuplet_actual").isNotNull() & F.col("tuplet_normal").isNotNull(), mark))).alias("tuplets"))
    merged = attacks.groupBy("score_id", "onset").agg(*aggregates)
    return merged.select("score_id", "onset", "duration", *[F.col(f"_first.{c}").alias(c) for c in place], "source_count", "pitches",
                         *(["tuplets"] if "tuplet_actual" in columns else []))


def attack_key(measure: Column, offset: Column, tpq: Column) -> Column:
    return F.concat_ws(":", measure.cast("string"), rational_text(offset, tpq))

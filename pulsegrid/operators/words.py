"""Corpus jobs over tables of metric words and of number parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions import bigint, combinatorics as C
from pulsegrid.functions.meter import is_prime
from pulsegrid.operators import residues


def word_profiles(words: DataFrame, modulus: int = 2) -> DataFrame:
    """Trace of every word: normal form, path, endpoint, class size (digits as text, exact at any length) and its residues.

    Invalid words keep only ``valid = false``.
    """
    n, k, p = F.col("n").cast("bigint"), F.col("k").cast("bigint"), F.lit(modulus).cast("bigint")
    checked = words.withColumn("metric_word", C.normalized_word(F.col("word"))).withColumn("valid", F.coalesce(C.is_metric_word(F.col("metric_word")), F.lit(False)))
    word = F.when(F.col("valid"), F.col("metric_word"))
    ended = checked.withColumns({"n": F.length(word), "k": C.word_ones(word), "path": C.word_path(word)})
    # Sizes and residues depend on (n, k) only: one evaluation per class, not per word.  Both come from the prime powers of the size.
    factors = ended.select("n", "k").filter("n IS NOT NULL").distinct().withColumn("_q", C.prime_power_factors(n, k))
    classes = factors.select(
        "n", "k", bigint.text(bigint.product(F.col("_q"))).alias("class_size"), p.alias("modulus"),
        F.aggregate("_q", F.lit(1).cast("bigint") % p, lambda acc, q: acc * (q % p) % p).alias("binomial_mod"), C.lucas_mod(n, k, p).alias("lucas_mod"))
    return ended.join(classes, ["n", "k"], "left").select(
        *words.columns, "metric_word", "valid", "n", "k", "path", "class_size", "modulus", "binomial_mod", "lucas_mod")


def word_classes(words: DataFrame) -> DataFrame:
    """Words by (length, number of T): how many occur, how many are distinct, how many exist (digits as text, exact at any length)."""
    word = C.normalized_word(F.col("word"))
    valid = words.select(word.alias("w")).filter(C.is_metric_word(F.col("w")))
    counted = valid.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return (
        counted.groupBy(F.length("w").alias("n"), C.word_ones(F.col("w")).alias("k"))
        .agg(F.sum("c").alias("words"), F.count(F.lit(1)).alias("distinct_words"))
        .withColumn("class_size", C.binomial_text(F.col("n"), F.col("k")))
    )


def arity_grid(params: DataFrame) -> DataFrame:
    """Residues, dilation check, boundaries and scales for rows of (p, n, k, m, schedule); residues are null for p < 2."""
    p, n, k, m = (F.col(c).cast("bigint") for c in ("p", "n", "k", "m"))
    rows = residues.with_tables(params, "p", "_parts")
    tables, factor = F.col("_parts"), C.int_power(p, m)
    return rows.select(
        *params.columns, is_prime(p).alias("p_is_prime"), C.lucas_mod(n, k, p).alias("lucas_mod"), residues.residue(n, k, p, tables).alias("pascal_mod"),
        F.when(m >= 0, residues.residue(factor * n, factor * k, p, tables) == residues.residue(n, k, p, tables)).alias("dilation_invariant"), C.boundary_sequence(p, m + 2).alias("boundaries"),
        C.boundary_sequence_by_recurrence(p, m + 2).alias("boundaries_by_recurrence"),
        C.scale_ray(p, m, F.lit(1), F.lit(0)).alias("ray"), C.valid_schedule(F.col("schedule")).alias("valid_schedule"),
        C.scale_vector(F.col("schedule")).alias("scale_vector"),
    )

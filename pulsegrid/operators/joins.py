"""Joins of frames that grow with the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sorted_join(left: DataFrame, right: DataFrame, keys: list[str] | str, how: str = "inner") -> DataFrame:
    """Join by shuffle and sort, never by broadcast.

    For sides with a row per measure, slot or graph object.  Spark takes an exploded frame for as small as its source and a written table for as small as its
    compressed columns, and would collect millions of rows on the driver to send them to every executor.
    """
    return left.join(right.hint("merge"), keys, how)

"""Typed relations between objects: members of a type pair, degrees by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.operators.joins import sorted_join


def typed_edges(objects: DataFrame, relations: DataFrame, scope: list[str], kind: str | None, source_tags: list[str] | None = None,
                target_tags: list[str] | None = None) -> DataFrame:
    """Relations of one type (all types when None) whose ends both exist in the scope, with the ends' tags and shapes.

    Needs objects(scope, obj_id, tag, shape) and relations(scope, source, target, type, ...).
    """
    end = lambda name, tags: objects.filter(F.col("tag").isin(tags) if tags else F.lit(True)).select(
        *scope, F.col("obj_id").alias(name), F.col("tag").alias(f"{name}_tag"), F.col("shape").alias(f"{name}_shape"))
    edges = relations.filter(F.col("type") == kind) if kind else relations
    return sorted_join(sorted_join(edges, end("source", source_tags), [*scope, "source"]), end("target", target_tags), [*scope, "target"])


def degree(edges: DataFrame, keys: list[str], other: Column, name: str, distinct: bool = False) -> DataFrame:
    counted = F.count_distinct(other) if distinct else F.count(other)
    return edges.groupBy(*keys).agg(counted.alias(name))

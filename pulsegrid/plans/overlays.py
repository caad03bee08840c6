"""Page overlays of the events: attacks registered to notation columns, everything derived placed on them, pages put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.operators import layout, pages, profiles, register
from pulsegrid.plans import generic_more as H
from pulsegrid.plans.event_scores import page_symbols
from pulsegrid.plans.events import read_events
from pulsegrid.plans.generic import LONG, banded_events, longs, users
from pulsegrid.session import write_table

#: Pieces of a document in the query; small, so that busy pages have several.
QUERY_PIECES = 25


def overlay_kinds(events: DataFrame) -> dict[str, DataFrame]:
    """Placed pieces of every kind.  Frames that several kinds read (hits, wave, its positions, nodes) are written once."""
    banded = write_table(banded_events(events), "banded")
    anchors = register.register_anchors(banded, H.notation_columns(events), H._pages(events))
    wave, scan = profiles.profile_scan(profiles.wave_profile(banded), users(events))
    wave, anchors = write_table(wave, "wave"), write_table(anchors, "anchors")
    placed = write_table(register.register_wave(wave, anchors), "placed")
    tree = write_table(profiles.tree(wave, scan), "tree")
    nodes = write_table(register.register_nodes(tree.drop("parent"), placed), "nodes")
    boxes, sheet, expected = page_symbols(events)
    bounds = layout.system_bounds(layout.physical_groups(boxes, sheet, expected), sheet)
    return {"bounds": bounds, "layer": anchors, "wave": placed, "pivot": register.register_pivots(profiles.pivots(wave, scan), placed), "node": nodes,
            "branch": register.register_branches(profiles.branches(tree, scan), nodes)}


def page_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every page: bounds, attacks, wave, pivots, tree nodes and branches in order, with their x (top for bounds)."""
    documents = pages.page_documents(pages.page_pieces(overlay_kinds(read_events(spark, sf_dir))), QUERY_PIECES)
    x = lambda p: F.when(p["kind"] == "bounds", F.rint(F.get_json_object(p["body"], "$.top_norm").cast("double") * 4400)).otherwise(
        F.coalesce(F.get_json_object(p["body"], "$.recovered_x_abs"), F.get_json_object(p["body"], "$.source_x_abs")).cast("double")).cast(LONG)
    text = lambda p: F.concat_ws(":", p["kind"], *[p[c].cast("string") for c in ("system_index", "first", "second")], p["role"], x(p).cast("string"))
    return documents.select(*longs("score_id", "page_index", "document"), F.size("pieces").cast(LONG).alias("n_pieces"), F.array_join(F.transform("pieces", text), ",").alias("body"))


PIECES = """
here AS (SELECT score_id, m, off, page_index AS page, system_index AS sys, CAST(px AS BIGINT) AS x FROM anchored WHERE reason = 'mapped'),
stand AS (SELECT n.score_id, n.node_index, n.onset, h.page, h.sys, h.x FROM node n JOIN here h USING (score_id, m, off)),
link AS (
  SELECT b.score_id, b.branch_index, s.page AS sp, s.sys AS ss, t.page AS tp, t.sys AS ts_, s.x, s.page = t.page AND s.sys = t.sys AS together
  FROM branch b JOIN stand s ON s.score_id = b.score_id AND s.node_index = b.source_node_index JOIN stand t ON t.score_id = b.score_id AND t.node_index = b.target_node_index
),
piece AS (
  SELECT score_id, page, 0 AS k, 'bounds' AS kind, sys, 0 AS a, 0 AS b, '' AS role, CAST(top * 2 AS BIGINT) AS x FROM extent
  UNION ALL SELECT score_id, page, 1, 'layer', sys, m, off, '', x FROM here
  UNION ALL SELECT score_id, page, 2, 'wave', sys, m, off, '', x FROM here
  UNION ALL SELECT p.score_id, h.page, 3, 'pivot', h.sys, p.pivot_index, 0, '', h.x FROM piv p JOIN here h ON h.score_id = p.score_id AND h.m = p.pivot_measure_index AND h.off = p.pivot_offset
  UNION ALL SELECT score_id, page, 4, 'node', sys, onset, node_index, '', x FROM stand
  UNION ALL SELECT score_id, sp, 5, 'branch', ss, branch_index, 0, CASE WHEN together THEN 'complete' ELSE 'source-endpoint' END, x FROM link
  UNION ALL SELECT score_id, tp, 5, 'branch', ts_, branch_index, 0, 'target-endpoint', x FROM link WHERE NOT together
),
put AS (SELECT *, row_number() OVER (PARTITION BY score_id, page ORDER BY k, sys, a, b, role) - 1 AS place FROM piece)"""


def oracles(with_, longs_, *parts: str) -> dict[str, str]:
    return {"page_overlay": with_(*parts, PIECES) + f"""
SELECT {longs_('score_id', 'page AS page_index', f'place // {QUERY_PIECES} AS document', 'count(*) AS n_pieces')},
  string_agg(concat_ws(':', kind, sys, a, b, role, x), ',' ORDER BY place) AS body
FROM put GROUP BY score_id, page, place // {QUERY_PIECES}"""}


QUERIES = {"page_overlay": page_overlay}

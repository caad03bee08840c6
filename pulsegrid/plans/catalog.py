"""Names of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.plans import event_scores as S
from pulsegrid.plans import generic as G
from pulsegrid.plans import generic_more as H
from pulsegrid.plans import graph_oracles
from pulsegrid.plans import overlays as O
from pulsegrid.plans import tuplets as T
from pulsegrid.plans.oracles import ANCHORS, BANDED, BASE, GRID, ORACLES, PAGES, TREE, longs, pivot_sql, with_

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "hit_merge": G.hit_merge,
    "meter_segments": G.meter_segments,
    "segment_hits": G.segment_hit_rows,
    "grid_levels": G.grid_levels,
    "event_levels": G.level_rows,
    "level_positions": G.level_positions,
    "level1_labels": G.level1_labels,
    "level_index": G.level_index_rows,
    "level_marks": G.level_marks,
    "wave_profile": G.wave_profile,
    "pivots": G.pivot_rows,
    "pivot_stats": G.pivot_stats,
    "level_pivots": G.level_pivots,
    "tree_branches": G.tree_branches,
    "tree_degrees": G.tree_degrees,
    "cursor_onsets": G.cursor_onsets,
    "ffill_state": G.ffill_state,
    "measure_starts": G.measure_starts,
    "tie_chains": G.tie_chains,
    "layout_counters": G.layout_counters,
    "visual_groups": G.visual_groups,
    "gap_clusters": G.gap_clusters,
    "cluster_medoid": G.cluster_medoid,
    "centroid_columns": G.centroid_columns,
    "gcd_quantum": G.gcd_quantum,
    "anchor_chain": G.anchor_chains,
    "monotone_fill": G.fill_rows,
    "framework_gaps": H.framework_gaps,
    "framework_verdicts": H.framework_verdicts,
    "register_anchors": H.register_anchors,
    "register_stats": H.register_stats,
    "missing_targets": H.missing_targets,
    "branch_endpoints": H.branch_endpoints,
    "pivot_anchors": H.pivot_anchors,
    "wave_anchor_stats": H.wave_anchor_stats,
    "nearest_anchor": H.nearest_anchor,
    "top_gap_systems": H.top_gap_systems,
    "guard_bounds": H.guard_bounds,
    "graph_members": H.graph_members,
    "metric_words": H.metric_words,
    "word_classes": H.word_classes,
    "lucas_mod": H.lucas_mod,
    "binomial_mod": H.binomial_mod,
    "class_sizes": H.class_sizes,
    "boundary_seq": H.boundary_seq,
    "scale_vector": H.scale_vector,
    "quality_report": H.quality_report,
    "score_hits": S.score_hits,
    "score_measures": S.score_measures,
    "canonical_columns": S.canonical_columns,
    "canonical_hits": S.canonical_hits,
    "recovery_audit": S.recovery_audit,
    "canonical_stats": S.canonical_stats,
    "physical_groups": S.physical_groups,
    "system_bounds": S.system_bounds,
    **T.QUERIES,
    **O.QUERIES,
}
ORACLES = {**ORACLES, **T.oracles(with_, longs, GRID), **graph_oracles.oracles(with_, longs),
           **O.oracles(with_, longs, BASE, BANDED, ANCHORS, TREE, pivot_sql("banded"), PAGES)}

__all__ = ["ORACLES", "QUERIES", "Query"]

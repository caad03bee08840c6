"""Every registered query against its SQL, with plain scans and with every key treated as hot."""

import os

import pytest

from pulsegrid.operators.scan import HOT_ROWS_CONF
from pulsegrid.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCANNED = ["tie_chains", "layout_counters", "cursor_onsets", "ffill_state", "pivots", "tree_branches", "cluster_medoid", "top_gap_systems"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert difference(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", SCANNED)
def test_query_with_hot_keys(spark, con, name):
    spark.conf.set(HOT_ROWS_CONF, "8")
    try:
        assert difference(spark, con, SF, QUERIES[name], ORACLES[name]) is None
    finally:
        spark.conf.unset(HOT_ROWS_CONF)


def test_tuplet_queries_reach_every_case(con):
    """The SQL side alone: conflicts, composite marks and recovered thirds all occur in the given tables."""
    kinds = {note for _, _, note in con.sql(ORACLES["tuplet_notes"]).fetchall()}
    assert {"conflict", "composite:6:4", "ternary"} <= kinds
    assert {levels.count(",") for *_, levels in con.sql(ORACLES["tuplet_levels"]).fetchall()} >= {0, 1, 2}


def test_graph_queries_reach_every_case(con):
    """The SQL side alone: all timing sources, stems both ways, dots, ties, several chords in a column and hits with and without details occur in the given tables."""
    rows = con.sql(f"SELECT timing_source, confidence_milli, tie_continuation_only, chords FROM ({ORACLES['canonical_columns']})").fetchall()
    assert {(source, sure) for source, sure, *_ in rows} >= {("semantic-begin-anchor", 920), ("semantic-begin-anchor", 940), ("semantic-monotonic-anchor", 900), ("canonical-grid-interpolation", 720)}
    chords = [c.split(":") for *_, text in rows for c in text.split(",")]
    assert {c[2] for c in chords} == {"0", "1", "2"} and {c[3] for c in chords} == {"up", "down", "none"} and {c[5] for c in chords} == {"0", "1"}
    assert any(tied for *_, tied, _ in rows) and any("," in text for *_, text in rows)
    details = {bool(n) for (n,) in con.sql(f"SELECT source_count FROM ({ORACLES['canonical_hits']})").fetchall()}
    assert details == {True, False}


def test_class_sizes_reach_forty_digits(con):
    sizes = dict(con.sql(f"SELECT class_size, digits FROM ({ORACLES['class_sizes']})").fetchall())
    assert max(sizes.values()) > 40 and all(len(text) == digits for text, digits in sizes.items())


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())

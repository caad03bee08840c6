"""Run registered queries next to their SQL: python -m tests.compare [--hot ROWS] <sf_dir> [query ...]

``--hot`` lowers the row count at which a key is treated as hot, so that every scan takes its chunked form.
"""

import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    return sorted(tuple(repr(r[c]) for c in order) for r in rows)


def difference(spark, con, sf_dir, query, sql):
    """None if equal, else a short text."""
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = canonical(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    spark_types = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if spark_types.get(t) != types[c]}
    if odd:
        return f"types {odd}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} vs {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return None if got else "empty"


def main():
    from pulsegrid.operators.scan import HOT_ROWS_CONF
    from pulsegrid.plans.catalog import ORACLES, QUERIES
    from pulsegrid.session import build_session

    args = sys.argv[1:]
    hot = args[1] if args[0] == "--hot" else None
    args = args[2:] if hot else args
    sf_dir, names = args[0], args[1:] or list(QUERIES)
    spark = build_session("compare", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    if hot:
        spark.conf.set(HOT_ROWS_CONF, hot)
    con = connect(sf_dir)
    for name in names:
        t0 = time.time()
        try:
            if name not in ORACLES:
                out = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
            else:
                out = difference(spark, con, sf_dir, QUERIES[name], ORACLES[name]) or "ok"
        except Exception as exc:  # noqa: BLE001
            out = f"FAILED {type(exc).__name__}: {str(exc)[:600]}"
        print(f"{name:20s} {time.time() - t0:6.1f}s  {out}", flush=True)


if __name__ == "__main__":
    main()

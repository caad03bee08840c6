"""SQL of the notation-graph queries, stated from the events and the rules of recovery; no graph is built."""

from __future__ import annotations

CHORDS = """
gev AS (
  SELECT user_id AS score_id, event_type AS kind, CAST(ceil(value) AS BIGINT) AS size,
    CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0) AS BIGINT) AS sec FROM events
),
gday AS (SELECT *, CAST(floor(sec / 86400.0) AS BIGINT) AS day FROM gev),
gmeas AS (
  SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY day) - 1 AS m, num * 24 // den AS full6,
    coalesce(sum(num * 24 // den) OVER (PARTITION BY score_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start6
  FROM (SELECT *, CASE WHEN turn = 0 THEN 4 ELSE 6 END AS num, CASE WHEN turn = 2 THEN 8 ELSE 4 END AS den
    FROM (SELECT *, (week % 3 + 3) % 3 AS turn FROM (SELECT *, CAST(floor(day / 7.0) AS BIGINT) AS week
      FROM (SELECT score_id, unnest(range(least(0, min(day)), max(day) + 1)) AS day FROM gday GROUP BY 1))))
),
chord AS (
  SELECT *, day || '.' || minute || '.' || kind AS chord_id, kind = 'purchase' AS two, kind <> 'error' AND NOT (kind = 'signup' AND size % 10 = 0) AS headed,
    kind <> 'error' AND size % 3 <> 0 AND size % 17 <> 0 AS stemmed, minute // 4 + 3.0::DOUBLE AS x, length(kind) * 10.0::DOUBLE AS y, CASE WHEN kind IN ('view', 'click') THEN 1 ELSE 2 END AS staff
  FROM (SELECT score_id, day, (sec - day * 86400) // 60 AS minute, kind, max(size) AS size FROM gday GROUP BY ALL)
),
shaped AS (
  SELECT *, kind = 'error' AS rest,
    CASE WHEN headed AND two THEN y + 10 ELSE y + 4 END AS cy,
    CASE WHEN headed AND size % 11 = 0 THEN 4 WHEN headed AND (size % 4 = 0 OR two AND size % 9 = 0) THEN 2 ELSE 1 END AS whole_part,
    CASE WHEN NOT stemmed THEN 0 WHEN kind IN ('view', 'click') THEN size % 3 ELSE [0, 1, 2, 1][size % 4 + 1] END AS splits,
    CASE WHEN NOT headed THEN 0 WHEN size % 14 = 0 THEN 2 WHEN size % 7 = 0 THEN 1 ELSE 0 END AS dots,
    headed AND size % 5 <> 0 AND (size % 6 = 3 OR size % 6 = 2 AND NOT two) AS tied
  FROM chord
),
note AS (
  SELECT s.*, g.m, g.week, g.full6,
    CASE WHEN rest THEN [4, 2, 1, 1, 4, 1][size % 6 + 1] ELSE whole_part * ((2 << dots) - 1) END AS len_n,
    CASE WHEN rest THEN [1, 1, 1, 2, 16, 1][size % 6 + 1] ELSE (CASE WHEN whole_part = 1 THEN 1 << splits ELSE 1 END) * (1 << dots) END AS len_d,
    CASE WHEN NOT stemmed OR size % 13 = 0 THEN 'none'
         WHEN CASE WHEN abs(y - 21 + size % 5 * 10 - cy) >= abs(y + 14 - cy) THEN y - 21 + size % 5 * 10 ELSE y + 14 END < cy THEN 'up' ELSE 'down' END AS direction
  FROM shaped s JOIN gmeas g USING (score_id, day) WHERE NOT (rest AND size % 6 = 0 AND 24 >= g.full6)
),
begin_hour AS (
  SELECT score_id, day, chord_id, minute // 60 AS hour, minute AS place FROM chord WHERE kind IN ('error', 'view', 'purchase')
  UNION ALL SELECT score_id, day, chord_id, minute // 60 - 1, minute + 1440 FROM chord WHERE two AND size % 10 = 1
),
begins AS (
  SELECT score_id, chord_id, place, part // gcd(part, 24) * 4 AS t_n, 24 // gcd(part, 24) AS t_d
  FROM (SELECT *, CASE WHEN hour = 7 THEN 6 ELSE hour END AS part FROM begin_hour WHERE hour BETWEEN 0 AND 22)
),
bases AS (
  SELECT score_id, list_reduce(list(DISTINCT d), lambda a, b: lcm(a, b)) AS base
  FROM (SELECT score_id, len_d AS d FROM note UNION ALL SELECT score_id, t_d FROM begins UNION ALL SELECT score_id, 6 FROM gmeas) GROUP BY 1
),
tick AS (SELECT n.*, b.base, len_n * base // len_d AS dur, full6 * base // 6 AS full_t FROM note n JOIN bases b USING (score_id)),
columned AS (
  SELECT *, sum(fresh) OVER (PARTITION BY score_id, m ORDER BY x, staff, chord_id) AS i FROM (
    SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY score_id, m ORDER BY x, staff, chord_id) > 12 THEN 1 ELSE 0 END AS fresh FROM tick)
),
middle AS (
  SELECT score_id, m, i, arg_min(x, {'d': d, 'c': chord_id}) AS x, arg_min(cy, {'d': d, 'c': chord_id}) AS y FROM (
    SELECT a.score_id, a.m, a.i, a.chord_id, any_value(a.x) AS x, any_value(a.cy) AS cy, sum(abs(a.x - b.x)) AS d FROM columned a JOIN columned b USING (score_id, m, i) GROUP BY ALL)
  GROUP BY ALL
),
col AS (
  SELECT score_id, m, i, any_value(week) AS week, any_value(base) AS base, any_value(full_t) AS full_t, max(dur) AS dur,
    bool_or(NOT rest AND NOT tied) AS attack, bool_or(rest) AS rest, coalesce(bool_and(CASE WHEN NOT rest THEN tied END), false) AS tie_only,
    bool_or(NOT rest AND NOT tied AND headed) AS exact_attack, count(*) OVER (PARTITION BY score_id, m) AS n,
    string_agg(concat_ws(':', chord_id, dur, dots, CASE WHEN rest THEN 'none' ELSE direction END, CAST(NOT rest AND NOT tied AS INT), CAST(tied AS INT)), ',' ORDER BY x, staff, chord_id) AS chords
  FROM columned GROUP BY score_id, m, i
),
support AS (
  SELECT c.score_id, c.m, c.i, t_n * c.base // t_d AS t, any_value(c.full_t) AS full_t, count(*) AS support, min({'x': c.x, 's': c.staff, 'c': c.chord_id, 'p': place}) AS seen
  FROM columned c JOIN begins b USING (score_id, chord_id) GROUP BY ALL
),
steps AS (
  SELECT score_id, m, list_reduce(list(DISTINCT v), lambda a, b: gcd(a, b)) AS g FROM (
    SELECT score_id, m, dur AS v FROM columned
    UNION ALL SELECT score_id, m, t - lag(t) OVER (PARTITION BY score_id, m ORDER BY t) FROM (SELECT DISTINCT score_id, m, t FROM support WHERE t >= 0 AND t < full_t))
  WHERE v > 0 GROUP BY ALL
),
lattice AS (
  SELECT score_id, m, CASE WHEN small THEN base * 2 ELSE first_step END AS step, base * 64 * (1 << CASE WHEN small THEN kf ELSE k END) AS qbase FROM (
    SELECT *, first_step < base * 2 * (1 << k) AS small, (SELECT min(e) FROM range(0, 41) r(e) WHERE full_t * 64 * (1 << e) >= n * base * 2) AS kf FROM (
      SELECT *, (SELECT min(e) FROM range(0, 41) r(e) WHERE full_t * 64 * (1 << e) >= n * first_step) AS k FROM (
        SELECT c.score_id, c.m, c.base, c.full_t, c.n, least(s.g, c.base) * 64 AS first_step
        FROM (SELECT DISTINCT score_id, m, base, full_t, n FROM col) c JOIN steps s USING (score_id, m))))
),
grid AS (SELECT c.*, l.step, l.qbase, l.qbase // c.base AS up, full_t * (l.qbase // c.base) // l.step AS units, d.x, d.y FROM col c JOIN lattice l USING (score_id, m) JOIN middle d USING (score_id, m, i)),
usable AS (
  SELECT *, row_number() OVER (PARTITION BY score_id, m ORDER BY i, seen) AS k FROM (
    SELECT g.score_id, g.m, g.i, s.t * g.up // g.step AS j, s.support AS w, s.seen FROM grid g JOIN support s USING (score_id, m, i)
    WHERE s.t >= 0 AND s.t < g.full_t AND s.t * g.up % g.step = 0 AND g.i > 0 AND s.t > 0 AND s.t * g.up // g.step >= g.i AND g.units - 1 - s.t * g.up // g.step >= g.n - 1 - g.i)
),
grown AS (
  SELECT DISTINCT score_id, m, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i BIGINT, j BIGINT, w BIGINT, c BIGINT, p BIGINT)[]) AS done FROM usable
  UNION ALL
  SELECT score_id, m, k, list_append(done, {'i': i, 'j': j, 'w': w + coalesce(best.w, 0), 'c': 1 + coalesce(best.c, 0), 'p': coalesce(-best.q, 0)}) FROM (
    SELECT g.score_id, g.m, u.k, u.i, u.j, u.w, g.done,
      list_max([{'w': g.done[q].w, 'c': g.done[q].c, 'q': -q} FOR q IN range(1, len(g.done) + 1) IF g.done[q].i < u.i AND u.j - g.done[q].j >= u.i - g.done[q].i]) AS best
    FROM grown g JOIN usable u ON u.score_id = g.score_id AND u.m = g.m AND u.k = g.k + 1)
),
walked AS (
  SELECT score_id, m, done, -list_max([{'w': done[q].w, 'c': done[q].c, 'j': -done[q].j, 'i': -done[q].i, 'q': -q} FOR q IN range(1, len(done) + 1)]).q AS q
  FROM (SELECT score_id, m, max_by(done, k) AS done FROM grown GROUP BY 1, 2)
  UNION ALL
  SELECT score_id, m, done, done[q].p FROM walked WHERE done[q].p > 0
),
anchored AS (
  SELECT g.*, CASE WHEN g.i = 0 THEN 0 ELSE a.j END AS anchor FROM grid g
  LEFT JOIN (SELECT score_id, m, done[q].i AS i, done[q].j AS j FROM walked) a ON a.score_id = g.score_id AND a.m = g.m AND a.i = g.i
),
rises AS (
  SELECT score_id, m, list_sort(list((x - px) / (anchor - pj))) AS s FROM (
    SELECT *, lag(anchor) OVER w AS pj, lag(x) OVER w AS px FROM anchored WHERE anchor IS NOT NULL WINDOW w AS (PARTITION BY score_id, m ORDER BY i))
  WHERE anchor > pj AND x > px GROUP BY 1, 2
),
ends AS (
  SELECT e.*, CASE WHEN s.s IS NOT NULL THEN s.s[len(s.s) // 2 + 1] WHEN e.li > 0 THEN greatest(1.0, (e.lx - e.fx) / greatest(1, e.li)) ELSE 1.0 END AS px
  FROM (SELECT score_id, m, max(i) AS li, max(x) AS lx, min(x) AS fx, max(CASE WHEN anchor IS NOT NULL THEN i END) AS ai, max(anchor) AS aj, max(CASE WHEN anchor IS NOT NULL THEN x END) AS ax FROM anchored GROUP BY 1, 2) e
  LEFT JOIN rises s USING (score_id, m)
),
fixed AS (
  SELECT a.*, CASE WHEN a.anchor IS NOT NULL THEN a.anchor
    WHEN a.i = e.li THEN least(a.units - 1, greatest(e.aj + e.li - e.ai, e.aj + greatest(e.li - e.ai, CAST(round_even((e.lx - e.ax) / greatest(e.px, 0.000001), 0) AS BIGINT)))) END AS j0
  FROM anchored a JOIN ends e USING (score_id, m)
),
between_ AS (
  SELECT *, last_value(CASE WHEN j0 IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, last_value(j0 IGNORE NULLS) OVER b AS aj, last_value(CASE WHEN j0 IS NOT NULL THEN x END IGNORE NULLS) OVER b AS ax,
    first_value(CASE WHEN j0 IS NOT NULL THEN i END IGNORE NULLS) OVER a AS bi, first_value(j0 IGNORE NULLS) OVER a AS bj, first_value(CASE WHEN j0 IS NOT NULL THEN x END IGNORE NULLS) OVER a AS bx
  FROM fixed WINDOW b AS (PARTITION BY score_id, m ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY score_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
walk AS (
  SELECT score_id, m, i, CAST(j0 AS BIGINT) AS j FROM between_ WHERE i = 0
  UNION ALL
  SELECT n.score_id, n.m, n.i, CASE WHEN n.j0 IS NOT NULL THEN n.j0 ELSE greatest(w.j + 1, least(n.bj - (n.bi - n.i),
    CAST(round_even(n.aj + (n.bj - n.aj) * CASE WHEN n.bx > n.ax THEN (n.x - n.ax) / (n.bx - n.ax) ELSE (n.i - n.ai) / (n.bi - n.ai) END, 0) AS BIGINT))) END
  FROM walk w JOIN between_ n ON n.score_id = w.score_id AND n.m = w.m AND n.i = w.i + 1
),
rate AS (SELECT score_id, list_reduce(list(DISTINCT qbase), lambda a, b: lcm(a, b)) AS tpq FROM grid GROUP BY 1),
timed AS (
  SELECT a.*, r.tpq, w.j, w.j * a.step * (r.tpq // a.qbase) AS onset, a.dur * (r.tpq // a.base) AS duration, coalesce(s.support, 0) AS exact_support
  FROM anchored a JOIN walk w USING (score_id, m, i) JOIN rate r USING (score_id)
  LEFT JOIN support s ON s.score_id = a.score_id AND s.m = a.m AND s.i = a.i AND s.t * a.up = w.j * a.step
),
recovered AS (
  SELECT t.score_id, t.m, t.onset AS offset_t, g.start6 * (t.tpq // 6) + t.onset AS onset, max(t.duration) AS duration, any_value(t.tpq) AS tpq
  FROM timed t JOIN gmeas g USING (score_id, m) WHERE t.attack AND t.onset < g.full6 * (t.tpq // 6) GROUP BY ALL
)"""


def _quarter(num: str, den: str) -> str:
    whole = f"CAST({num} // gcd({num}, {den}) AS VARCHAR)"
    return f"CASE WHEN {num} % {den} = 0 THEN {whole} ELSE {whole} || '/' || CAST({den} // gcd({num}, {den}) AS VARCHAR) END"


def oracles(with_, longs) -> dict[str, str]:
    return {
        "recovery_audit": with_(CHORDS, """
traced AS (
  SELECT t.*, f.j0, CASE WHEN t.exact_support > 0 THEN 'b' WHEN t.anchor IS NOT NULL THEN 'c' ELSE 'x' END AS source FROM timed t JOIN fixed f USING (score_id, m, i)
),
audited AS (
  SELECT score_id, m, any_value(week) AS week, any_value(full_t) AS full_t, any_value(base) AS base, any_value(step) AS step, any_value(qbase) AS qbase, any_value(units) AS units, count(*) AS n_columns,
    count(*) FILTER (attack) AS attacks, count(anchor) AS anchors, count(*) FILTER (source = 'b') AS b, count(*) FILTER (source = 'c') AS c, count(*) FILTER (source = 'x') AS x,
    string_agg(i || ':' || anchor, ',' ORDER BY i) FILTER (anchor IS NOT NULL) AS semantic, string_agg(i || ':' || j0, ',' ORDER BY i) FILTER (j0 IS NOT NULL) AS timing
  FROM traced GROUP BY 1, 2
)""") + f"""
SELECT {longs('a.score_id AS score_id', 'a.m AS measure_index', 'a.week AS page_index', 'g.day - g.week * 7 AS stack_ord', '0 AS stack_left', '360 AS stack_right', 'a.units AS units', 'a.n_columns AS physical_column_count',
              'a.attacks AS attack_column_count', 'a.anchors AS semantic_anchor_count', 'a.b AS begin_columns', 'a.c AS chain_columns', 'a.x AS interpolated_columns')},
  {_quarter('a.full_t', 'a.base')} AS full_duration_quarter, {_quarter('a.step', 'a.qbase')} AS quantum_quarter, a.semantic AS semantic_anchors, a.timing AS timing_anchors,
  CAST(round_even(e.px * 1000, 0) AS BIGINT) AS px_per_unit_milli
FROM audited a JOIN gmeas g USING (score_id, m) JOIN ends e USING (score_id, m)""",
        "canonical_columns": with_(CHORDS) + f"""
SELECT {longs('score_id', 'm AS measure_index', 'week AS page_index', 'i AS column_index', 'tpq', 'onset', 'duration', 'j AS grid_index', 'units', 'exact_support')},
  round_even(CASE WHEN exact_support > 0 THEN least(1.0, 0.9 + 0.02 * exact_support) WHEN anchor IS NOT NULL THEN 0.9 ELSE 0.72 END * 1000, 0)::BIGINT AS confidence_milli,
  x AS x_abs, y AS y_abs,
  CASE WHEN exact_support > 0 THEN 'semantic-begin-anchor' WHEN anchor IS NOT NULL THEN 'semantic-monotonic-anchor' ELSE 'canonical-grid-interpolation' END AS timing_source,
  {longs('attack', 'rest', 'tie_only AS tie_continuation_only')}, chords
FROM timed""",
        "canonical_hits": with_(CHORDS, """
own AS (
  SELECT d.score_id, g.m, (d.sec - d.day * 86400) * g.full6 // 86400 AS off6, count(*) AS source_count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS pitches
  FROM gday d JOIN gmeas g USING (score_id, day) GROUP BY ALL
)""") + f"""
SELECT {longs('r.score_id AS score_id', 'r.m AS measure_index', 'r.offset_t AS offset', 'r.onset AS onset', 'r.duration AS duration', 'r.tpq AS tpq', 'coalesce(o.source_count, 0) AS source_count')},
  coalesce(o.pitches, '') AS pitches
FROM recovered r LEFT JOIN own o ON o.score_id = r.score_id AND o.m = r.m AND o.off6 * (r.tpq // 6) = r.offset_t""",
        "canonical_stats": with_(CHORDS) + f"""
SELECT {longs('c.score_id AS score_id', 'c.columns AS column_count', 'c.attacks AS attack_column_count', 'c.ties AS tie_continuation_column_count', 'c.rests AS rest_column_count',
              'c.exact AS exact_attack_geometry_column_count', 'coalesce(d.dots, 0) AS augmentation_dot_count', 'coalesce(h.hits, 0) AS canonical_hit_count')}
FROM (SELECT score_id, count(*) AS columns, count(*) FILTER (attack) AS attacks, count(*) FILTER (tie_only) AS ties, count(*) FILTER (rest) AS rests, count(*) FILTER (exact_attack) AS exact FROM timed GROUP BY 1) c
LEFT JOIN (SELECT score_id, sum(dots) AS dots FROM shaped GROUP BY 1) d USING (score_id)
LEFT JOIN (SELECT score_id, count(*) AS hits FROM recovered GROUP BY 1) h USING (score_id)""",
    }

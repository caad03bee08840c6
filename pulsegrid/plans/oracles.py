"""The registered queries once more, as plain SQL over the given tables."""

from __future__ import annotations

BASE = """
ev AS (
  SELECT event_id, ts, user_id AS score_id, event_type, CAST(ceil(value) AS BIGINT) AS dur,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000 AS sec
  FROM events
),
att AS (
  SELECT *, sec // 86400 AS m, CASE WHEN (sec // 86400 // 7) % 3 = 0 THEN 256 ELSE 192 END AS full_ticks FROM ev
),
loc AS (
  SELECT score_id, m, (sec % 86400) * full_ticks // 86400 AS off, max(dur) AS duration, count(*) AS source_count,
         string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS pitches
  FROM att GROUP BY 1, 2, 3
),
cal AS (
  SELECT score_id, unnest(range(0, last_day + 1)) AS m FROM (SELECT score_id, max(sec // 86400) AS last_day FROM ev GROUP BY 1)
),
meas AS (
  SELECT score_id, m,
         CASE (m // 7) % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 6 END AS num, CASE (m // 7) % 3 WHEN 2 THEN 8 ELSE 4 END AS den,
         CASE (m // 7) % 3 WHEN 0 THEN 256 ELSE 192 END AS full_ticks,
         coalesce(sum(CASE (m // 7) % 3 WHEN 0 THEN 256 ELSE 192 END) OVER (PARTITION BY score_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_tick
  FROM cal
),
hits AS (
  SELECT l.*, s.start_tick + l.off AS onset FROM loc l JOIN meas s USING (score_id, m)
),
seg AS (
  SELECT score_id, run AS segment_index, min(start_tick) AS start_tick, max(start_tick + full_ticks) AS end_tick, min(m) AS first_m, max(m) AS last_m,
         any_value(num) AS num, any_value(den) AS den,
         CASE WHEN any_value(num) = 6 THEN 96 ELSE 64 END AS width, CASE WHEN any_value(num) = 6 THEN 2 ELSE any_value(num) END AS beat_count,
         CASE WHEN any_value(num) = 3 THEN 3 ELSE 2 END AS base, CASE WHEN any_value(num) = 6 THEN 1 ELSE 0 END AS compound
  FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY score_id ORDER BY m) AS run FROM (
      SELECT *, CASE WHEN lag(num) OVER w IS NOT NULL AND (lag(num) OVER w <> num OR lag(den) OVER w <> den) THEN 1 ELSE 0 END AS fresh
      FROM meas WINDOW w AS (PARTITION BY score_id ORDER BY m)))
  GROUP BY 1, 2
),
placed AS (
  SELECT h.*, g.segment_index, g.start_tick, g.end_tick, g.num, g.den, g.width, g.base, g.compound, (g.end_tick - g.start_tick) // g.width AS beats
  FROM hits h JOIN seg g ON h.score_id = g.score_id AND h.onset >= g.start_tick AND h.onset < g.end_tick
)
"""

GRID = """
kinds AS (SELECT DISTINCT base, (end_tick - start_tick) // width AS beats FROM seg),
pieces AS (
  SELECT base, lo, hi FROM (
    SELECT b AS base, 0 AS lo, 1 AS hi FROM (VALUES (2), (3)) t(b)
    UNION ALL
    SELECT b, CAST(pow(b, e) AS BIGINT), CAST(pow(b, e + 1) AS BIGINT) FROM (VALUES (2), (3)) t(b), range(0, 15) r(e))
),
tops AS (
  SELECT k.base, k.beats, min(p.hi) AS top FROM kinds k JOIN pieces p ON p.base = k.base AND p.hi >= k.beats GROUP BY 1, 2
),
iv AS (
  SELECT base, beats, CAST(0 AS BIGINT) AS a, CAST(top AS BIGINT) AS b, 1 AS lv FROM tops
  UNION ALL
  SELECT iv.base, iv.beats, iv.a + p.lo, iv.a + least(p.hi, iv.b - iv.a), iv.lv + 1
  FROM iv JOIN pieces p ON p.base = iv.base AND p.lo < iv.b - iv.a AND least(p.hi, iv.b - iv.a) - p.lo > 1
  WHERE iv.b - iv.a > 1
),
marks AS (
  SELECT iv.base, iv.beats, iv.a AS pos, iv.lv FROM iv
  UNION
  SELECT iv.base, iv.beats, iv.a + least(p.hi, iv.b - iv.a), iv.lv FROM iv JOIN pieces p ON p.base = iv.base AND p.lo < iv.b - iv.a
),
unit_spans AS (
  SELECT DISTINCT iv.base, iv.beats, iv.a + p.lo AS pos, iv.lv FROM iv JOIN pieces p ON p.base = iv.base AND p.lo < iv.b - iv.a AND least(p.hi, iv.b - iv.a) - p.lo = 1
)
"""

LEVELS = """
spans AS (
  SELECT DISTINCT h.score_id, h.segment_index, h.start_tick + bt.beat * h.width AS a, h.start_tick + (bt.beat + 1) * h.width AS b,
         u.lv AS parent, CASE WHEN h.compound = 1 THEN 3 ELSE 2 END AS f
  FROM placed h
  JOIN (SELECT score_id, segment_index, onset, (onset - start_tick) // width AS beat FROM placed) bt USING (score_id, segment_index, onset)
  JOIN unit_spans u ON u.base = h.base AND u.beats = h.beats AND u.pos = bt.beat
  WHERE (h.onset - h.start_tick) % h.width > 0
  UNION
  SELECT s.score_id, s.segment_index, s.a + k * ((s.b - s.a) // s.f), s.a + (k + 1) * ((s.b - s.a) // s.f),
         s.parent + CASE WHEN s.f = 2 OR k = 0 THEN 1 ELSE 2 END, 2
  FROM spans s, range(0, 3) r(k), placed h
  WHERE k < s.f AND h.score_id = s.score_id AND h.segment_index = s.segment_index
    AND h.onset > s.a + k * ((s.b - s.a) // s.f) AND h.onset < s.a + (k + 1) * ((s.b - s.a) // s.f)
),
stack AS (
  SELECT h.score_id, h.segment_index, h.onset, g.lv FROM placed h JOIN marks g ON g.base = h.base AND g.beats = h.beats
    AND (h.onset - h.start_tick) % h.width = 0 AND g.pos = (h.onset - h.start_tick) // h.width
  UNION
  SELECT h.score_id, h.segment_index, h.onset, s.parent + v.lv
  FROM spans s JOIN (VALUES (2, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 1), (3, 1, 1), (3, 1, 2), (3, 2, 2), (3, 3, 1), (3, 3, 2)) v(f, k, lv) ON v.f = s.f
  JOIN placed h ON h.score_id = s.score_id AND h.segment_index = s.segment_index AND h.onset = s.a + v.k * ((s.b - s.a) // s.f)
),
leveled AS (
  SELECT h.score_id, h.segment_index, h.onset, h.m, h.off, h.width, coalesce(max(s.lv), 0) AS height, count(s.lv) AS density, coalesce(min(s.lv), 0) AS lowest_level,
         coalesce(string_agg(s.lv, ',' ORDER BY s.lv), '') AS levels
  FROM placed h LEFT JOIN stack s USING (score_id, segment_index, onset) GROUP BY ALL
)
"""

BANDED = """
banded AS (
  SELECT *, duration % 8 + 1 AS lowest_level, greatest(duration % 8, least(7, duration // 8)) + 1 AS height FROM placed
)
"""


def frac(num: str, den: str) -> str:
    return (f"(CASE WHEN ({num}) % ({den}) = 0 THEN CAST(({num}) // ({den}) AS VARCHAR) "
            f"ELSE CAST(({num}) // gcd({num}, {den}) AS VARCHAR) || '/' || CAST(({den}) // gcd({num}, {den}) AS VARCHAR) END)")


def longs(*names: str) -> str:
    """``expr`` or ``expr AS name``, each cast to BIGINT under its name."""
    return ", ".join(f'CAST({n.rpartition(" AS ")[0] or n} AS BIGINT) AS "{n.rpartition(" AS ")[2]}"' for n in names)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(p.strip().rstrip(",") for p in parts) + "\n"


def pivot_sql(points: str) -> str:
    return f"""
pt AS (SELECT score_id, segment_index, onset, m, off, height FROM {points}),
linked AS (
  SELECT *, lag(height) OVER w AS before, lead(height) OVER w AS next_height, lead(onset) OVER w AS next_onset
  FROM pt WINDOW w AS (PARTITION BY score_id, segment_index ORDER BY onset)
),
runs AS (
  SELECT *, sum(CASE WHEN height > before THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, segment_index ORDER BY onset) AS run FROM linked
),
crest AS (
  SELECT *, max(height) OVER r AS top, min(height) OVER r AS bottom, max(onset) OVER r AS last_onset, lead(onset) OVER s AS nx FROM runs
  WINDOW r AS (PARTITION BY score_id, segment_index, run), s AS (PARTITION BY score_id, segment_index ORDER BY onset)
),
found AS (
  SELECT c.score_id, c.segment_index, c.run, c.top, c.bottom, max(CASE WHEN c.height = c.top THEN c.onset END) AS pivot_onset, any_value(c.last_onset) AS trough_onset,
         min(CASE WHEN c.height < c.top THEN c.onset END) AS after_drop_onset, max(CASE WHEN c.onset = c.last_onset THEN c.next_onset END) AS recovery_onset,
         max(CASE WHEN c.onset = c.last_onset THEN c.next_height END) AS recovery_height
  FROM crest c GROUP BY 1, 2, 3, 4, 5
),
piv AS (
  SELECT f.*, p.m AS pivot_measure_index, p.off AS pivot_offset, a.height AS after_height,
         row_number() OVER (PARTITION BY f.score_id ORDER BY f.segment_index, f.pivot_onset) - 1 AS pivot_index,
         CASE WHEN f.top - f.bottom = 1 THEN 'simple' ELSE 'compound' END AS kind
  FROM found f JOIN pt p ON p.score_id = f.score_id AND p.segment_index = f.segment_index AND p.onset = f.pivot_onset
  JOIN pt a ON a.score_id = f.score_id AND a.segment_index = f.segment_index AND a.onset = f.after_drop_onset
  WHERE f.top > f.bottom AND f.recovery_onset IS NOT NULL
)
"""


TREE = """
node AS (
  SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY segment_index, onset) - 1 AS node_index FROM banded
),
parented AS (
  SELECT t.score_id, t.segment_index, t.node_index, t.onset, t.lowest_level, max(s.node_index) AS parent
  FROM node t LEFT JOIN node s ON s.score_id = t.score_id AND s.segment_index = t.segment_index AND s.node_index < t.node_index AND s.lowest_level <= t.lowest_level
  GROUP BY ALL
),
branch AS (
  SELECT t.score_id, t.segment_index, s.node_index AS source_node_index, t.node_index AS target_node_index, s.onset AS source_onset, t.onset AS target_onset,
         s.lowest_level AS source_level, t.lowest_level AS target_level,
         row_number() OVER (PARTITION BY t.score_id ORDER BY t.node_index) - 1 AS branch_index
  FROM parented t JOIN node s ON s.score_id = t.score_id AND s.node_index = t.parent
)
"""

TIES = """
flags AS (
  SELECT *, event_type IN ('click', 'view') AS starts, event_type IN ('view', 'purchase') AS stops FROM ev
),
isl AS (
  SELECT *, sum(CASE WHEN starts AND NOT stops THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY ts, event_id) AS island FROM flags
),
closing AS (
  SELECT *, coalesce(sum(CASE WHEN stops AND NOT starts THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM isl
),
live AS (
  SELECT score_id, island, sum(dur) AS extra FROM closing WHERE stops AND island > 0 AND closed = 0 GROUP BY 1, 2
)
"""

LAYOUT = """
paged AS (
  SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY ts, event_id) AS page_index FROM ev
),
systems AS (
  SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, page_index ORDER BY ts, event_id) AS system_index FROM paged
)
"""

GAPS = """
stepped AS (
  SELECT *, sec // 60 AS minute, lag(sec // 60) OVER (PARTITION BY score_id ORDER BY ts, event_id) AS before FROM ev
),
clustered AS (
  SELECT *, sum(CASE WHEN minute - before > 240 THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY ts, event_id) AS cluster FROM stepped
)
"""

DAYCOLS = """
daycols AS (
  SELECT score_id, sec // 86400 AS m, sec % 86400 // 60 AS x, count(*) AS members, max(dur) AS duration,
         row_number() OVER (PARTITION BY score_id, sec // 86400 ORDER BY sec % 86400 // 60) - 1 AS i, count(*) OVER (PARTITION BY score_id, sec // 86400) AS n
  FROM ev GROUP BY 1, 2, 3
)
"""

ORACLES: dict[str, str] = {
    "hit_merge": with_(BASE) + f"""
SELECT {longs('score_id', 'onset', 'm AS measure_index', 'off AS offset', 'duration', 'source_count')}, pitches,
       CAST(m AS VARCHAR) || ':' || {frac('off', '64')} AS attack_key FROM hits""",
    "meter_segments": with_(BASE) + f"""
SELECT {longs('score_id', 'segment_index', 'start_tick AS start', 'end_tick AS end', 'first_m AS start_measure_index', 'last_m AS end_measure_index', 'num', 'den', 'width AS beat_ticks', 'beat_count', 'base AS top_base', 'compound')} FROM seg""",
    "segment_hits": with_(BASE) + f"""
SELECT {longs('score_id', 'onset', 'segment_index', 'start_tick AS segment_start', 'end_tick AS segment_end', 'num', 'den')} FROM placed""",
    "grid_levels": with_(BASE, GRID) + f"""
SELECT {longs('s.score_id AS score_id', 's.segment_index AS segment_index', 'p.pos AS position')}, p.levels, CAST(u.lv AS BIGINT) AS span_level
FROM seg s JOIN (SELECT base, beats, pos, string_agg(lv, ',' ORDER BY lv) AS levels FROM marks GROUP BY 1, 2, 3) p
  ON p.base = s.base AND p.beats = (s.end_tick - s.start_tick) // s.width AND p.pos <= p.beats
LEFT JOIN unit_spans u ON u.base = p.base AND u.beats = p.beats AND u.pos = p.pos AND p.pos < p.beats""",
    "event_levels": with_(BASE, GRID, LEVELS) + f"""
SELECT {longs('score_id', 'segment_index', 'onset', 'height', 'density', 'lowest_level')}, levels FROM leveled""",
    "level_positions": with_(BASE, GRID, LEVELS) + f"""
SELECT {longs('score_id', 'segment_index', 'lv AS level', 'count(*) AS positions', 'min(onset) AS first_onset', 'max(onset) AS last_onset', 'sum(onset) AS onset_sum')}
FROM stack GROUP BY score_id, segment_index, lv""",
    "level_index": with_(BASE, GRID, LEVELS) + f"""
SELECT {longs('score_id', 'segment_index', 'lv AS level', 'onset // 1024 AS block', 'count(*) AS positions')}, string_agg(d, ',' ORDER BY onset) AS deltas FROM (
  SELECT *, onset - coalesce(lag(onset) OVER (PARTITION BY score_id, segment_index, lv, onset // 1024 ORDER BY onset), onset // 1024 * 1024) AS d FROM stack
) GROUP BY score_id, segment_index, lv, onset // 1024""",
    "level_marks": with_(BASE, GRID, LEVELS) + f"""
, named AS (
  SELECT p.score_id, p.segment_index, arg_min(CASE WHEN (p.onset - s.start_tick) % p.width = 0 THEN 'm.' || (s.m + 1) || ' b' || ((p.onset - s.start_tick) // p.width + 1)
         ELSE 'm.' || (s.m + 1) || ' +' || {frac('(p.onset - s.start_tick)', '64')} END, p.onset) AS label
  FROM placed p JOIN stack t ON t.score_id = p.score_id AND t.segment_index = p.segment_index AND t.onset = p.onset AND t.lv = 1 JOIN meas s ON s.score_id = p.score_id AND s.m = p.m
  GROUP BY p.score_id, p.segment_index
),
sizes AS (SELECT score_id, segment_index, count(*) AS events FROM placed GROUP BY score_id, segment_index),
spans_ AS (
  SELECT score_id, segment_index, lv, count(*) AS positions, count(DISTINCT onset // 1024) AS blocks, min(onset) AS first_onset, max(onset) AS last_onset FROM stack GROUP BY score_id, segment_index, lv
)
SELECT {longs('score_id', 'segment_index', 'lv AS level', 'positions', 'blocks', 'first_onset', 'last_onset', 'events')}, CASE WHEN lv = 1 THEN coalesce(label, 'none') ELSE 'none' END AS first_label
FROM spans_ JOIN sizes USING (score_id, segment_index) LEFT JOIN named USING (score_id, segment_index)""",
    "level1_labels": with_(BASE, GRID, LEVELS) + f"""
SELECT {longs('p.score_id AS score_id', 'p.segment_index AS segment_index', 'p.onset AS onset')},
       CASE WHEN (p.onset - s.start_tick) % p.width = 0 THEN 'm.' || (s.m + 1) || ' b' || ((p.onset - s.start_tick) // p.width + 1)
            ELSE 'm.' || (s.m + 1) || ' +' || {frac('(p.onset - s.start_tick)', '64')} END AS label
FROM placed p JOIN stack k ON k.score_id = p.score_id AND k.segment_index = p.segment_index AND k.onset = p.onset AND k.lv = 1
JOIN meas s ON s.score_id = p.score_id AND p.onset >= s.start_tick AND p.onset < s.start_tick + s.full_ticks""",
    "wave_profile": with_(BASE, BANDED) + f"""
SELECT {longs('score_id', 'segment_index', 'onset', 'm AS measure_index', 'off AS offset', 'height', 'CASE WHEN height = lowest_level THEN 1 ELSE 2 END AS density', 'lowest_level')}
FROM (SELECT *, row_number() OVER (PARTITION BY score_id, m, off ORDER BY segment_index, onset) AS nth FROM banded) WHERE nth = 1""",
    "pivots": with_(BASE, BANDED, pivot_sql("banded")) + f"""
SELECT {longs('score_id', 'pivot_index', 'segment_index', 'top - bottom AS drop_depth', 'top - after_height AS immediate_drop_depth', 'top AS crest_height', 'bottom AS trough_height', 'recovery_height', 'pivot_onset', 'after_drop_onset', 'trough_onset', 'recovery_onset')}, kind FROM piv""",
    "pivot_stats": with_(BASE, BANDED, pivot_sql("banded")) + f"""
SELECT {longs('score_id', 'count(*) AS pivots', "count(*) FILTER (kind = 'simple') AS simple_pivots", "count(*) FILTER (kind = 'compound') AS compound_pivots", 'max(top - bottom) AS deepest_drop')} FROM piv GROUP BY score_id""",
    "level_pivots": with_(BASE, GRID, LEVELS, pivot_sql("leveled WHERE density > 0")) + f"""
SELECT {longs('score_id', 'pivot_index', 'segment_index', 'top - bottom AS drop_depth', 'top - after_height AS immediate_drop_depth', 'top AS crest_height', 'bottom AS trough_height', 'pivot_measure_index', 'pivot_offset', 'pivot_onset', 'trough_onset', 'recovery_onset')}, kind FROM piv""",
    "tree_branches": with_(BASE, BANDED, TREE) + f"""
SELECT {longs('score_id', 'branch_index', 'segment_index', 'source_node_index', 'target_node_index', 'source_onset', 'target_onset', 'source_level', 'target_level', 'target_onset - source_onset AS distance', 'CASE WHEN source_level = target_level THEN 1 ELSE 0 END AS same_level')} FROM branch""",
    "tree_degrees": with_(BASE, BANDED, TREE) + f"""
SELECT {longs('p.score_id AS score_id', 'p.node_index AS node_index', 'p.onset AS onset', 'p.lowest_level AS lowest_level', 'CASE WHEN p.parent IS NULL THEN 0 ELSE 1 END AS incoming_branches', 'coalesce(o.n, 0) AS outgoing_branches', 'CASE WHEN p.parent IS NULL THEN 1 ELSE 0 END AS root')}
FROM parented p LEFT JOIN (SELECT score_id, parent AS node_index, count(*) AS n FROM parented WHERE parent IS NOT NULL GROUP BY 1, 2) o USING (score_id, node_index)""",
    "cursor_onsets": with_(BASE, """
el AS (
  SELECT score_id, sec // 86400 AS m, ts, event_id, dur, event_type = 'click' AS chord, event_type = 'purchase' AND dur % 5 = 0 AS grace,
         CASE event_type WHEN 'error' THEN 'backup' WHEN 'signup' THEN 'forward' ELSE 'note' END AS tag FROM ev
),
moved AS (
  SELECT *, CASE WHEN tag = 'forward' OR (tag = 'note' AND NOT chord AND NOT grace) THEN dur WHEN tag = 'backup' THEN -dur ELSE 0 END AS delta FROM el
),
cur AS (
  SELECT *, coalesce(sum(delta) OVER (PARTITION BY score_id, m ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor_tick FROM moved
)""") + f"""
SELECT {longs('score_id', 'm AS measure_index', 'event_id', 'cursor_tick AS cursor')},
  CAST(CASE WHEN tag = 'note' THEN coalesce(last_value(CASE WHEN tag = 'note' AND NOT chord THEN cursor_tick END IGNORE NULLS) OVER w, 0) END AS BIGINT) AS onset_local,
  CAST(greatest(0, coalesce(max(CASE WHEN tag = 'forward' OR (tag = 'note' AND NOT chord AND NOT grace) THEN cursor_tick + delta END) OVER w, 0)) AS BIGINT) AS reach, tag
FROM cur WINDOW w AS (PARTITION BY score_id, m ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "ffill_state": with_(BASE) + """
SELECT CAST(score_id AS BIGINT) AS score_id, CAST(event_id AS BIGINT) AS event_id,
  CAST(coalesce(last_value(CASE WHEN event_type = 'signup' THEN dur END IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS BIGINT) AS divisions FROM ev""",
    "measure_starts": with_(BASE) + f"""
SELECT {longs('score_id', 'm AS measure_index', 'num', 'den', 'full_ticks AS full', 'start_tick AS start')} FROM meas""",
    "tie_chains": with_(BASE, TIES) + f"""
SELECT {longs('c.score_id AS score_id', 'c.event_id AS event_id', 'c.dur + CASE WHEN c.starts THEN coalesce(l.extra, 0) ELSE 0 END AS duration')}, 'attack' AS outcome
FROM closing c LEFT JOIN live l ON l.score_id = c.score_id AND l.island = c.island WHERE NOT c.stops
UNION ALL
SELECT {longs('score_id', 'event_id', 'dur AS duration')}, 'unmatched-stop' FROM closing WHERE stops AND NOT (island > 0 AND closed = 0)""",
    "layout_counters": with_(BASE, LAYOUT) + f"""
SELECT {longs('score_id', 'event_id', 'page_index', 'system_index', 'coalesce(sum(dur) OVER (PARTITION BY score_id, page_index, system_index ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x_offset', 'system_index * 220 AS down')} FROM systems""",
    "gap_clusters": with_(BASE, GAPS) + f"SELECT {longs('score_id', 'event_id', 'minute', 'cluster')} FROM clustered",
    "cluster_medoid": with_(BASE, GAPS) + f"""
SELECT {longs('score_id', 'cluster', 'arg_min(event_id, (d, event_id)) AS medoid', 'arg_min(minute, (d, event_id)) AS medoid_value', 'min(d) AS total_distance', 'count(*) AS members')}
FROM (SELECT a.score_id, a.cluster, a.event_id, a.minute, sum(abs(a.minute - b.minute)) AS d FROM clustered a JOIN clustered b USING (score_id, cluster) GROUP BY 1, 2, 3, 4)
GROUP BY score_id, cluster""",
    "centroid_columns": with_(BASE, DAYCOLS, """
walk AS (
  SELECT score_id, m, i, x, members, 0 AS col, x * members AS total, members AS n FROM daycols WHERE i = 0
  UNION ALL
  SELECT d.score_id, d.m, d.i, d.x, d.members, CASE WHEN abs(d.x - w.total / w.n) <= 90 THEN w.col ELSE w.col + 1 END,
         CASE WHEN abs(d.x - w.total / w.n) <= 90 THEN w.total + d.x * d.members ELSE d.x * d.members END,
         CASE WHEN abs(d.x - w.total / w.n) <= 90 THEN w.n + d.members ELSE d.members END
  FROM walk w JOIN daycols d ON d.score_id = w.score_id AND d.m = w.m AND d.i = w.i + 1
)""") + f"""
SELECT {longs('score_id', 'm AS measure_index', 'col AS column_index', 'min(x) AS first_value', 'max(x) AS last_value', 'sum(members) AS members')} FROM walk GROUP BY score_id, m, col""",
    "gcd_quantum": """
WITH g AS (
  SELECT l_orderkey, list_reduce(list(DISTINCT CAST(l_quantity AS BIGINT)), lambda a, b: gcd(a, b)) AS gcd, count(DISTINCT l_linenumber) AS columns, max(CAST(l_quantity AS BIGINT)) AS longest
  FROM lineitem GROUP BY 1
),
k AS (
  SELECT *, least(gcd, 32) AS q,
    (SELECT min(e) FROM range(0, 41) r(e) WHERE longest * (1 << e) // least(gcd, 32) >= columns) AS halved,
    (SELECT min(e) FROM range(0, 41) r(e) WHERE longest * (1 << e) >= columns) AS floored FROM g
),
f AS (SELECT *, CASE WHEN q < (1 << halved) THEN 1 ELSE q END AS num, 32 * (1 << CASE WHEN q < (1 << halved) THEN floored ELSE halved END) AS den FROM k)
SELECT """ + longs("l_orderkey", "gcd", "columns", "longest") + ", " + frac("num", "den") + " AS quantum FROM f",
    "anchor_chain": with_(BASE, DAYCOLS, """
usable AS (
  SELECT *, row_number() OVER (PARTITION BY score_id, m ORDER BY i) AS k
  FROM (SELECT score_id, m, i, n, (x + duration * 7) % 1440 AS j, members AS w FROM daycols) WHERE i > 0 AND j > 0 AND j >= i AND 1439 - j >= n - 1 - i
),
grown AS (
  SELECT DISTINCT score_id, m, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(i BIGINT, j BIGINT, w BIGINT, c BIGINT, p BIGINT)[]) AS done FROM usable
  UNION ALL
  SELECT score_id, m, k, list_append(done, {'i': i, 'j': j, 'w': w + coalesce(best.w, 0), 'c': 1 + coalesce(best.c, 0), 'p': coalesce(-best.q, 0)}) FROM (
    SELECT g.score_id, g.m, u.k, u.i, u.j, u.w, g.done,
      list_max([{'w': g.done[q].w, 'c': g.done[q].c, 'q': -q} FOR q IN range(1, len(g.done) + 1) IF u.j - g.done[q].j >= u.i - g.done[q].i]) AS best
    FROM grown g JOIN usable u ON u.score_id = g.score_id AND u.m = g.m AND u.k = g.k + 1)
),
whole AS (SELECT score_id, m, max_by(done, k) AS done FROM grown GROUP BY 1, 2 HAVING max(k) > 0),
walked AS (
  SELECT score_id, m, done, -list_max([{'w': done[q].w, 'c': done[q].c, 'j': -done[q].j, 'i': -done[q].i, 'q': -q} FOR q IN range(1, len(done) + 1)]).q AS q FROM whole
  UNION ALL
  SELECT score_id, m, done, done[q].p FROM walked WHERE done[q].p > 0
),
chained AS (SELECT score_id, m, done[q].i AS i, done[q].j AS j FROM walked UNION ALL SELECT DISTINCT score_id, m, 0, 0 FROM daycols)""") + f"""
SELECT {longs('score_id', 'm AS measure_index', 'i', 'j')} FROM chained""",
    "monotone_fill": with_(BASE, DAYCOLS, """
anc AS (SELECT *, CASE WHEN i % 3 = 0 THEN i + x // 20 END AS j0 FROM daycols),
firsts AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE j0 END AS j1 FROM anc),
pairs AS (
  SELECT score_id, m, i, j1, x, lag(j1) OVER w AS pj, lag(x) OVER w AS px FROM firsts WHERE j1 IS NOT NULL WINDOW w AS (PARTITION BY score_id, m ORDER BY i)
),
scales AS (
  SELECT score_id, m, list_sort(list((x - px) / (j1 - pj))) AS s FROM pairs WHERE j1 > pj AND x > px GROUP BY 1, 2
),
days AS (
  SELECT f.score_id, f.m, max(f.i) AS li, max(f.x) AS lx, min(f.x) AS fx, max(CASE WHEN j1 IS NOT NULL THEN f.i END) AS ai FROM firsts f GROUP BY 1, 2
),
tails AS (
  SELECT d.*, a.j1 AS aj, a.x AS ax,
    CASE WHEN s.s IS NOT NULL THEN s.s[len(s.s) // 2 + 1] WHEN d.li > 0 THEN greatest(1.0, (d.lx - d.fx) / greatest(1, d.li)) ELSE 1.0 END AS px
  FROM days d JOIN firsts a ON a.score_id = d.score_id AND a.m = d.m AND a.i = d.ai LEFT JOIN scales s ON s.score_id = d.score_id AND s.m = d.m
),
fixed AS (
  SELECT f.score_id, f.m, f.i, f.x, CASE WHEN f.j1 IS NOT NULL THEN f.j1
    WHEN f.i = t.li THEN least(1439, greatest(t.aj + t.li - t.ai, t.aj + greatest(t.li - t.ai, CAST(round_even((t.lx - t.ax) / greatest(t.px, 0.000001), 0) AS BIGINT)))) END AS j
  FROM firsts f JOIN tails t USING (score_id, m)
),
between_ AS (
  SELECT *, last_value(CASE WHEN j IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ai, last_value(j IGNORE NULLS) OVER b AS aj, last_value(CASE WHEN j IS NOT NULL THEN x END IGNORE NULLS) OVER b AS ax,
    first_value(CASE WHEN j IS NOT NULL THEN i END IGNORE NULLS) OVER a AS bi, first_value(j IGNORE NULLS) OVER a AS bj, first_value(CASE WHEN j IS NOT NULL THEN x END IGNORE NULLS) OVER a AS bx
  FROM fixed WINDOW b AS (PARTITION BY score_id, m ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY score_id, m ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
),
walk AS (
  SELECT score_id, m, i, x, j FROM between_ WHERE i = 0
  UNION ALL
  SELECT n.score_id, n.m, n.i, n.x, CASE WHEN n.j IS NOT NULL THEN n.j ELSE greatest(w.j + 1, least(n.bj - (n.bi - n.i),
    CAST(round_even(n.aj + (n.bj - n.aj) * CASE WHEN n.bx > n.ax THEN (n.x - n.ax) / (n.bx - n.ax) ELSE (n.i - n.ai) / (n.bi - n.ai) END, 0) AS BIGINT))) END
  FROM walk w JOIN between_ n ON n.score_id = w.score_id AND n.m = w.m AND n.i = w.i + 1
)""") + f"SELECT {longs('score_id', 'm AS measure_index', 'i', 'x', 'j')} FROM walk",
    "visual_groups": with_(BASE, """
vis AS (
  SELECT *, sec // 86400 AS m, CASE WHEN event_type <> 'signup' THEN sec % 86400 // 3600 END AS x, CASE WHEN event_type <> 'signup' THEN NULL ELSE sec // 60 END AS okey,
    CASE WHEN event_type = 'error' THEN 'grace' ELSE 'main' END AS visual_kind FROM ev
),
per_pitch AS (
  SELECT score_id, m, x, okey, visual_kind, event_type, count(*) AS n, min(event_id) AS first_id FROM vis GROUP BY ALL
),
texts AS (
  SELECT score_id, m, x, okey, visual_kind, string_agg(event_type || '*' || n, ',' ORDER BY first_id) AS pitches FROM per_pitch GROUP BY ALL
),
grouped AS (
  SELECT score_id, m, x, okey, visual_kind, arg_min(sec // 60, event_id) AS onset, arg_min(dur, event_id) AS duration, count(*) AS notes,
    bool_or(event_type = 'view') AS marked, bool_or(event_type NOT IN ('error', 'purchase')) AS sounds FROM vis GROUP BY ALL
)""") + f"""
SELECT {longs('g.score_id AS score_id', 'g.m AS measure_index', 'g.m // 7 AS layout_page', 'g.m % 7 AS layout_system', 'g.x AS layout_default_x', 'g.onset AS onset', 'g.duration AS duration', 'g.notes AS notes', 'CASE WHEN marked THEN 3 END AS tuplet_actual', 'CASE WHEN marked THEN 2 END AS tuplet_normal')},
  g.visual_kind, t.pitches, CAST(CASE WHEN sounds THEN 1 ELSE 0 END AS BIGINT) AS analyzed
FROM grouped g JOIN texts t ON t.score_id = g.score_id AND t.m = g.m AND t.x IS NOT DISTINCT FROM g.x AND t.okey IS NOT DISTINCT FROM g.okey AND t.visual_kind = g.visual_kind""",
}


FRAMEWORK = """
active AS (
  SELECT score_id, day, row_number() OVER (PARTITION BY score_id ORDER BY day) - 1 AS idx,
    CASE (day // 7) % 3 WHEN 0 THEN '4/4' WHEN 1 THEN '3/4' ELSE '6/8' END AS meter, CASE WHEN (day // 7) % 3 = 0 THEN 256 ELSE 192 END AS full_ticks
  FROM (SELECT DISTINCT score_id, sec // 86400 AS day FROM ev)
),
spans AS (
  SELECT score_id, min(day) AS first_day, max(day) AS last_day, count(*) AS measures, max(day) - min(day) + 1 + CASE WHEN score_id % 7 = 0 THEN 1 ELSE 0 END AS stacks
  FROM active GROUP BY 1
),
slots AS (
  SELECT s.score_id, d.day, a.meter, a.full_ticks,
    last_value(a.meter IGNORE NULLS) OVER (PARTITION BY s.score_id ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back,
    first_value(a.meter IGNORE NULLS) OVER (PARTITION BY s.score_id ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM spans s, LATERAL (SELECT unnest(range(s.first_day, s.last_day + 1)) AS day) d LEFT JOIN active a ON a.score_id = s.score_id AND a.day = d.day
),
verdict AS (
  SELECT s.*, CASE
    WHEN stacks <= measures THEN 'none'
    WHEN score_id % 13 = 5 THEN 'numbering-not-numeric'
    WHEN last_day - first_day <> stacks - 1 THEN 'numbering-does-not-cover-stacks'
    WHEN EXISTS (SELECT 1 FROM slots t WHERE t.score_id = s.score_id AND t.meter IS NULL AND t.back <> t.ahead) THEN 'conflicting-neighbour-meters'
    ELSE 'none' END AS rejection
  FROM spans s
),
frame AS (
  SELECT a.score_id, a.idx, CASE WHEN a.score_id % 13 = 5 THEN 'x' ELSE '' END || a.day AS measure_number, a.meter, a.full_ticks, 0 AS synthesized
  FROM active a JOIN verdict v USING (score_id) WHERE v.rejection = 'none' AND v.stacks <= v.measures
  UNION ALL
  SELECT t.score_id, t.day - v.first_day, CAST(t.day AS VARCHAR), coalesce(t.meter, t.back), CASE WHEN coalesce(t.meter, t.back) = '4/4' THEN 256 ELSE 192 END, CASE WHEN t.meter IS NULL THEN 1 ELSE 0 END
  FROM slots t JOIN verdict v USING (score_id) WHERE v.rejection = 'none' AND v.stacks > v.measures
)
"""

ANCHORS = """
minute_columns AS (
  SELECT score_id, m, (sec % 86400) * full_ticks // 86400 AS off, sec % 86400 // 60 AS col, bool_or(event_type IN ('purchase', 'click', 'view')) AS attack FROM att GROUP BY 1, 2, 3, 4
),
taken AS (
  SELECT score_id, m, off, max(col) AS col FROM minute_columns WHERE attack GROUP BY 1, 2, 3
),
heads AS (
  SELECT t.score_id, t.m, t.off, CAST(sec % 86400 AS DOUBLE) AS x, CAST(length(event_type) AS DOUBLE) AS y, event_type AS id, t.col * 60.0 + 30.0 AS cx
  FROM taken t JOIN att a ON a.score_id = t.score_id AND a.m = t.m AND (a.sec % 86400) * a.full_ticks // 86400 = t.off AND a.sec % 86400 // 60 = t.col
  WHERE event_type IN ('purchase', 'click')
),
pos AS (SELECT score_id, m, off, arg_min({'x': x, 'y': y}, (abs(x - cx), x, y, id)) AS p FROM heads GROUP BY 1, 2, 3),
anchored AS (
  SELECT b.*, CASE WHEN t.col IS NOT NULL THEN b.m // 7 END AS page_index, CASE WHEN t.col IS NOT NULL THEN b.m % 7 END AS system_index, p.p.x AS px, p.p.y AS py,
    CASE WHEN t.col IS NULL THEN 'canonical-attack-column-not-found' WHEN p.p IS NULL THEN 'exact-attacking-notehead-geometry-not-found'
         WHEN b.m // 7 = 3 THEN 'page-dimensions-unavailable' ELSE 'mapped' END AS reason
  FROM banded b LEFT JOIN taken t ON t.score_id = b.score_id AND t.m = b.m AND t.off = b.off LEFT JOIN pos p ON p.score_id = b.score_id AND p.m = b.m AND p.off = b.off
),
labels_ AS (
  SELECT score_id, m, off, reason, lowest_level AS lv FROM anchored UNION SELECT score_id, m, off, reason, height FROM anchored
)
"""

WORDS = """
hour_bits AS (
  SELECT score_id, sec // 86400 AS m, sec % 86400 // 3600 AS h, bool_or(event_type IN ('purchase', 'click')) AS lit FROM ev GROUP BY 1, 2, 3
),
day_words AS (
  SELECT d.score_id, d.m, string_agg(CASE WHEN b.lit THEN 'T' ELSE 'A' END, '' ORDER BY d.h) AS word
  FROM (SELECT score_id, m, unnest(range(0, max(h) + 1)) AS h FROM hour_bits GROUP BY 1, 2) d LEFT JOIN hour_bits b USING (score_id, m, h) GROUP BY 1, 2
),
sized AS (
  SELECT *, length(word) AS n, length(replace(word, 'A', '')) AS k FROM day_words
),
classed AS (SELECT *, CAST(factorial(CAST(n AS INTEGER)) // (factorial(CAST(k AS INTEGER)) * factorial(CAST(n - k AS INTEGER))) AS BIGINT) AS c FROM sized)
"""

ORDER_NUMBERS = """
nums AS (
  SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 7 END AS p FROM orders
)
"""

ORACLES |= {
    "framework_gaps": with_(BASE, FRAMEWORK) + f"""
SELECT {longs('score_id', 'idx AS measure_index', "split_part(meter, '/', 1) AS num", "split_part(meter, '/', 2) AS den", 'full_ticks AS full', 'coalesce(sum(full_ticks) OVER (PARTITION BY score_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start', 'synthesized')}, measure_number FROM frame""",
    "framework_verdicts": with_(BASE, FRAMEWORK) + f"""
SELECT {longs('score_id', 'stacks', 'measures', "CASE WHEN rejection = 'none' AND stacks > measures THEN stacks - measures ELSE 0 END AS synthesized")}, rejection FROM verdict""",
    "register_anchors": with_(BASE, BANDED, ANCHORS) + f"""
SELECT {longs('score_id', 'm AS measure_index', 'off AS offset', 'page_index', 'system_index', "CASE WHEN reason = 'mapped' THEN px END AS recovered_x_abs")},
  CASE WHEN reason = 'mapped' THEN px / 86400.0 END AS cx_norm, CASE WHEN reason = 'mapped' THEN py / 64.0 END AS cy_norm, reason FROM anchored""",
    "register_stats": with_(BASE, BANDED, ANCHORS) + f"""
SELECT {longs('score_id', 'coalesce(lv, 0) AS level', 'count(*) AS expected', "count(*) FILTER (reason = 'mapped') AS mapped", "count(*) FILTER (reason <> 'mapped') AS missing")}
FROM labels_ GROUP BY GROUPING SETS ((score_id, lv), (score_id))""",
    "missing_targets": with_(BASE, BANDED, ANCHORS) + f"""
SELECT {longs('score_id', 'lv AS level', 'm AS measure_index', 'off AS offset')}, reason FROM labels_ WHERE reason <> 'mapped'""",
    "branch_endpoints": with_(BASE, BANDED, TREE, """
ends AS (SELECT score_id, node_index, m // 7 AS page, m % 7 AS sys, off FROM node WHERE off % 11 <> 0),
joined AS (
  SELECT b.*, s.page AS sp, s.sys AS ss, s.off AS so, t.page AS tp, t.sys AS ts_, t.off AS t_o
  FROM branch b LEFT JOIN ends s ON s.score_id = b.score_id AND s.node_index = b.source_node_index LEFT JOIN ends t ON t.score_id = b.score_id AND t.node_index = b.target_node_index
)""") + f"""
SELECT {longs('score_id', 'branch_index', 'NULL AS page_index', 'NULL AS system_index', 'NULL AS endpoint_level', 'so AS source_x_abs', 't_o AS target_x_abs')}, 'missing' AS span_role FROM joined WHERE sp IS NULL OR tp IS NULL
UNION ALL SELECT {longs('score_id', 'branch_index', 'sp', 'ss', 'NULL AS e', 'so', 't_o')}, 'complete' FROM joined WHERE sp = tp AND ss = ts_
UNION ALL SELECT {longs('score_id', 'branch_index', 'sp', 'ss', 'source_level', 'so', 't_o')}, 'source-endpoint' FROM joined WHERE sp <> tp OR ss <> ts_
UNION ALL SELECT {longs('score_id', 'branch_index', 'tp', 'ts_', 'target_level', 'so', 't_o')}, 'target-endpoint' FROM joined WHERE sp <> tp OR ss <> ts_""",
    "pivot_anchors": with_(BASE, BANDED, pivot_sql("banded")) + f"""
SELECT {longs('score_id', 'pivot_index', 'CASE WHEN pivot_offset % 11 <> 0 THEN pivot_measure_index // 7 END AS page_index', 'CASE WHEN pivot_offset % 11 <> 0 THEN pivot_measure_index % 7 END AS system_index', 'CASE WHEN pivot_offset % 11 <> 0 THEN pivot_offset END AS recovered_x_abs')},
  CASE WHEN pivot_offset % 11 <> 0 THEN 'mapped' ELSE 'existing-wave-anchor-not-found' END AS reason FROM piv""",
    "wave_anchor_stats": with_(BASE, BANDED) + f"""
SELECT {longs('score_id', 'count(*) AS wave_expected', 'count(*) FILTER (off % 11 <> 0) AS wave_mapped', 'count(*) FILTER (off % 11 = 0) AS wave_missing', 'max(height) AS wave_max_height')} FROM banded GROUP BY score_id""",
    "nearest_anchor": f"""
SELECT {longs('p_partkey', 'l_orderkey', 'l_linenumber')} FROM (
  SELECT p_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(l_extendedprice / l_quantity - p_retailprice), l_extendedprice / l_quantity, l_orderkey, l_linenumber) AS nth
  FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE nth = 1""",
    "top_gap_systems": with_(BASE, """
mins AS (
  SELECT score_id, event_id, sec // 60 AS minute, row_number() OVER w - 1 AS idx, lead(sec // 60) OVER w - sec // 60 AS gap FROM ev WINDOW w AS (PARTITION BY score_id ORDER BY ts, event_id)
),
cuts AS (
  SELECT *, CASE WHEN gap IS NOT NULL AND row_number() OVER (PARTITION BY score_id ORDER BY gap DESC NULLS LAST, idx DESC) <= score_id % 4 THEN 1 ELSE 0 END AS cut FROM mins
)""") + f"""
SELECT {longs('score_id', 'event_id', 'coalesce(sum(cut) OVER (PARTITION BY score_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS system_index')} FROM cuts""",
    "guard_bounds": f"""
WITH boxes AS (
  SELECT year(o_orderdate) AS page, month(o_orderdate) AS system, min(dayofyear(o_orderdate)) AS top, max(dayofyear(o_orderdate)) + 5 AS bottom, min(o_totalprice) AS l, max(o_totalprice) AS r FROM orders GROUP BY 1, 2
)
SELECT {longs('page', 'system', 'top', 'bottom')}, l AS "left", r AS "right", CAST(coalesce((bottom + lead(top) OVER (PARTITION BY page ORDER BY top, system)) / 2, bottom) AS DOUBLE) AS guard_bottom FROM boxes""",
    "graph_members": f"""
SELECT 'o' || l_orderkey AS source, l_returnflag AS type, {longs('count(*) AS members', 'count(DISTINCT l_partkey) AS distinct_members', "count(*) FILTER (p_type = 'SMALL') AS small_members")}
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
    "metric_words": with_(BASE, WORDS) + f"""
SELECT {longs('score_id', 'm AS measure_index', 'n', 'k', 'c AS class_size', 'c % 3 AS binomial_mod', 'c % 3 AS lucas_mod')}, word AS metric_word,
  array_to_string(list_transform(range(0, n + 1), lambda i: length(replace(substr(word, 1, i), 'A', ''))), ',') AS path FROM classed""",
    "word_classes": with_(BASE, WORDS) + f"""
SELECT {longs('n', 'k', 'count(*) AS words', 'count(DISTINCT word) AS distinct_words', 'any_value(c) AS class_size')} FROM classed GROUP BY n, k""",
    "lucas_mod": "WITH " + ORDER_NUMBERS + f"""
, digits AS (
  SELECT o_orderkey, o_custkey, p, o_orderkey // CAST(pow(p, e) AS BIGINT) % p AS a, o_custkey // CAST(pow(p, e) AS BIGINT) % p AS b FROM nums, range(0, 40) r(e) WHERE pow(p, e) <= greatest(o_orderkey, o_custkey, 1)
),
parts AS (
  SELECT o_orderkey, any_value(o_custkey) AS o_custkey, any_value(p) AS p, CAST(product(CASE WHEN b > a THEN 0 ELSE CAST(factorial(CAST(a AS INTEGER)) // (factorial(CAST(b AS INTEGER)) * factorial(CAST(a - b AS INTEGER))) AS BIGINT) % p END) AS BIGINT) AS pr FROM digits GROUP BY 1
)
SELECT {longs('o_orderkey', 'p', 'CASE WHEN o_custkey > o_orderkey THEN 0 ELSE pr % p END AS residue', '1 AS invariant')} FROM parts""",
    "binomial_mod": f"""
WITH nums AS (SELECT o_orderkey, o_orderkey % 61 AS n, o_custkey % 61 AS k, o_orderkey % 35 + 2 AS m FROM orders),
cases AS (SELECT DISTINCT f * n AS n, f * k AS k, m FROM (SELECT n, k, m, unnest([1, m]) AS f FROM nums)),
primes AS (SELECT p FROM range(2, 2161) t(p) WHERE NOT EXISTS (SELECT 1 FROM range(2, 47) d(d) WHERE d < p AND p % d = 0)),
parts AS (
  SELECT n, k, m, p, list_sum(list_transform(range(1, 12), lambda i: n // CAST(pow(p, i) AS HUGEINT) - k // CAST(pow(p, i) AS HUGEINT) - (n - k) // CAST(pow(p, i) AS HUGEINT))) AS e
  FROM cases JOIN primes ON p <= n WHERE k <= n
),
known AS (
  SELECT n, k, m, list_reduce(list(CAST(pow(p, e) AS BIGINT) % m), lambda a, b: a * b % m) AS r FROM parts WHERE e > 0 GROUP BY n, k, m
),
residues AS (SELECT n, k, m, CASE WHEN k > n THEN 0 ELSE coalesce(r, 1) END AS r FROM cases LEFT JOIN known USING (n, k, m))
SELECT {longs('o_orderkey', 'm AS modulus', 'a.r AS residue', 'b.r AS scaled_residue', 'CASE WHEN a.r = b.r THEN 1 ELSE 0 END AS invariant')}
FROM nums JOIN residues a USING (n, k, m) JOIN residues b ON b.n = nums.m * nums.n AND b.k = nums.m * nums.k AND b.m = nums.m""",
    "class_sizes": with_(BASE, """
month_hours AS (SELECT DISTINCT score_id, sec // 2419200 AS month, sec % 2419200 // 3600 AS h FROM ev),
month_words AS (
  SELECT w.score_id, w.month, string_agg(CASE WHEN b.h IS NOT NULL THEN 'T' ELSE 'A' END, '' ORDER BY w.h) AS word
  FROM (SELECT score_id, month, unnest(range(0, max(h) + 1)) AS h FROM month_hours GROUP BY 1, 2) w LEFT JOIN month_hours b USING (score_id, month, h) GROUP BY 1, 2
),
classes AS (SELECT length(word) AS n, length(replace(word, 'A', '')) AS k, count(*) AS words, count(DISTINCT word) AS distinct_words FROM month_words GROUP BY 1, 2),
triangle AS (
  SELECT 0 AS n, ['1'::BIGNUM] AS line
  UNION ALL SELECT n + 1, list_transform(range(0, n + 2), lambda i: coalesce(line[i], '0'::BIGNUM) + coalesce(line[i + 1], '0'::BIGNUM)) FROM triangle WHERE n < 672
)""") + f"""
SELECT {longs('n', 'k', 'words', 'distinct_words', 'length(CAST(line[k + 1] AS VARCHAR)) AS digits')}, CAST(line[k + 1] AS VARCHAR) AS class_size FROM classes JOIN triangle USING (n)""",
    "boundary_seq": "WITH RECURSIVE " + ORDER_NUMBERS + f"""
, bases AS (SELECT DISTINCT p FROM nums), hi AS (SELECT max(o_orderkey) AS h FROM nums),
seq AS (SELECT p, 1 AS nth, CAST(1 AS BIGINT) AS term FROM bases UNION ALL SELECT p, nth + 1, CASE WHEN nth = 1 THEN 2 ELSE p * term - (p - 1) END FROM seq, hi WHERE term <= h + 1)
SELECT {longs('o.o_orderkey AS o_orderkey', 'o.p AS p', 'min(s.nth) AS terms', 'min(s.term) AS last_term', '1 AS closed_form_agrees')}
FROM nums o JOIN seq s ON s.p = o.p AND s.term >= o.o_orderkey + 1 GROUP BY o.o_orderkey, o.p""",
    "scale_vector": f"""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT CAST(l_linenumber + 1 AS BIGINT))) AS l FROM lineitem GROUP BY 1),
v AS (SELECT *, len(list_filter(l, lambda x: x NOT IN (2, 3, 5, 7, 11, 13))) = 0 AS ok FROM s)
SELECT {longs('l_orderkey', 'CASE WHEN ok THEN 1 ELSE 0 END AS valid')}, array_to_string(l, ',') AS schedule,
  CASE WHEN ok THEN array_to_string(list_transform(range(1, len(l) + 1), lambda i: CAST(list_product(l[1:i]) AS BIGINT)), ',') ELSE 'none' END AS scales FROM v""",
    "quality_report": with_(BASE, BANDED, ANCHORS, TIES, FRAMEWORK) + f"""
, all_ AS (
  SELECT score_id, 'timeline' AS stage, 'unmatched-tie-stop' AS code FROM closing WHERE stops AND NOT (island > 0 AND closed = 0)
  UNION ALL SELECT score_id, 'framework', CASE WHEN rejection <> 'none' THEN rejection ELSE 'measures-restored' END FROM verdict WHERE rejection <> 'none' OR stacks > measures
  UNION ALL SELECT score_id, 'registration', 'missing-label' FROM labels_ WHERE reason <> 'mapped'
)
SELECT {longs('score_id', 'count(*) AS n')}, stage, code FROM all_ GROUP BY score_id, stage, code""",
}


SCORE = """
el AS (
  SELECT score_id, event_id % 2 AS part, sec // 86400 AS m, event_id, dur, CASE event_type WHEN 'error' THEN 'backup' WHEN 'signup' THEN 'forward' ELSE 'note' END AS tag,
    event_type = 'click' AS chord, event_type = 'purchase' AND dur % 5 = 0 AS grace, event_type = 'view' AND dur % 4 = 0 AS silent,
    dur % 6 IN (1, 2) AS starts, dur % 6 IN (2, 3) AS stops, upper(event_type[1]) || (dur % 3 + 3) AS pitch,
    (dur % 8) * 24 // CASE WHEN sec // 86400 >= 5 THEN 4 ELSE 2 + event_id % 2 END AS t
  FROM ev
),
moved AS (
  SELECT *, CASE WHEN tag = 'forward' OR (tag = 'note' AND NOT chord AND NOT grace) THEN t WHEN tag = 'backup' THEN -t ELSE 0 END AS delta FROM el
),
cur AS (
  SELECT *, coalesce(sum(delta) OVER (PARTITION BY score_id, part, m ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM moved
),
timed AS (
  SELECT *, coalesce(last_value(CASE WHEN tag = 'note' AND NOT chord THEN c END IGNORE NULLS) OVER (PARTITION BY score_id, part, m ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS local_onset FROM cur
),
reach AS (
  SELECT score_id, m, greatest(0, max(CASE WHEN tag = 'forward' OR (tag = 'note' AND NOT chord AND NOT grace) THEN c + delta END)) AS actual FROM cur WHERE part = 0 GROUP BY 1, 2
),
frame_ AS (
  SELECT s.score_id, s.m, s.num, s.den, s.full_ticks * 24 // 64 AS full_24, s.start_tick * 24 // 64 AS start_24, coalesce(r.actual, 0) AS actual,
    CASE WHEN s.m = 0 AND coalesce(r.actual, 0) < s.full_ticks * 24 // 64 THEN s.full_ticks * 24 // 64 - coalesce(r.actual, 0) ELSE 0 END AS shift
  FROM meas s LEFT JOIN reach r USING (score_id, m)
),
sounding AS (
  SELECT *, sum(CASE WHEN starts AND NOT stops THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, part, pitch ORDER BY m, event_id) AS island FROM timed WHERE tag = 'note' AND NOT grace AND NOT silent
),
closing_ AS (
  SELECT *, coalesce(sum(CASE WHEN stops AND NOT starts THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, part, pitch, island ORDER BY m, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM sounding
),
held AS (
  SELECT score_id, part, pitch, island, sum(t) AS extra FROM closing_ WHERE stops AND island > 0 AND closed = 0 GROUP BY 1, 2, 3, 4
),
struck AS (
  SELECT a.score_id, a.part, a.m, a.event_id, a.pitch, f.shift + a.local_onset AS off, f.start_24 + f.shift + a.local_onset AS onset, a.t + CASE WHEN a.starts THEN coalesce(h.extra, 0) ELSE 0 END AS duration
  FROM closing_ a JOIN frame_ f ON f.score_id = a.score_id AND f.m = a.m
  LEFT JOIN held h ON h.score_id = a.score_id AND h.part = a.part AND h.pitch = a.pitch AND h.island = a.island WHERE NOT a.stops
)
"""

PAGES = """
boxes AS (
  SELECT DISTINCT score_id, sec // 86400 // 7 AS page, sec // 86400 % 7 AS d, CAST(sec % 86400 // 60 * 2 AS DOUBLE) AS x, sec // 86400 % 7 * 300.0 + length(event_type) * 12 AS y, event_type FROM ev
),
days_ AS (SELECT DISTINCT score_id, page, d FROM boxes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY score_id, page ORDER BY d) - 1 AS sys FROM days_),
heads_ AS (SELECT b.*, r.sys, b.x + 6 AS cx FROM boxes b JOIN ranked r USING (score_id, page, d)),
extent AS (SELECT score_id, page, sys, min(y) AS top, max(y + 10) AS bottom, min(x) AS l, max(x + 12) AS r FROM heads_ GROUP BY 1, 2, 3),
xs AS (SELECT score_id, page, sys, cx, count(*) AS n, row_number() OVER (PARTITION BY score_id, page, sys ORDER BY cx) AS nth FROM heads_ GROUP BY 1, 2, 3, 4),
-- tolerance max(2.5, min(0.34 * 10, 0.55 * 12)) = 3.4
walk_ AS (
  SELECT score_id, page, sys, nth, cx, n, 0 AS col, cx * n AS total, n AS members FROM xs WHERE nth = 1
  UNION ALL
  SELECT v.score_id, v.page, v.sys, v.nth, v.cx, v.n, CASE WHEN abs(v.cx - w.total / w.members) <= 3.4 THEN w.col ELSE w.col + 1 END,
    CASE WHEN abs(v.cx - w.total / w.members) <= 3.4 THEN w.total + v.cx * v.n ELSE v.cx * v.n END, CASE WHEN abs(v.cx - w.total / w.members) <= 3.4 THEN w.members + v.n ELSE v.n END
  FROM walk_ w JOIN xs v ON v.score_id = w.score_id AND v.page = w.page AND v.sys = w.sys AND v.nth = w.nth + 1
)
"""

ORACLES |= {
    "score_hits": with_(BASE, SCORE) + f"""
SELECT {longs('score_id', 'onset', 'max(duration) AS duration', 'arg_min(off, (part, m, event_id)) AS offset', 'arg_min(m, (part, m, event_id)) AS measure_index', 'count(*) AS source_count')},
  string_agg(DISTINCT pitch, ',' ORDER BY pitch) AS pitches FROM struck GROUP BY score_id, onset""",
    "score_measures": with_(BASE, SCORE) + f"""
SELECT {longs('score_id', 'm AS measure_index', 'num', 'den', 'start_24 AS start', 'full_24 AS full', 'actual', 'shift AS pickup_shift', 'm // 7 + 1 AS page_index', 'CASE WHEN m % 7 >= 3 THEN 1 ELSE 0 END AS system_index', '80 + 100 * CASE WHEN m % 7 >= 3 THEN m % 7 - 3 ELSE m % 7 END AS x_start')} FROM frame_""",
    "physical_groups": with_(BASE, PAGES) + f"""
SELECT {longs('w.score_id AS score_id', 'w.page AS page_index', 'w.sys AS system_index', 'w.col AS group_index', 'sum(w.n) AS heads', 'any_value(e.top) AS system_top', 'any_value(e.bottom) AS system_bottom', 'any_value(e.l) AS system_left', 'any_value(e.r) AS system_right')}
FROM walk_ w JOIN extent e USING (score_id, page, sys) GROUP BY w.score_id, w.page, w.sys, w.col""",
    "system_bounds": with_(BASE, PAGES) + f"""
SELECT {longs('score_id', 'page AS page_index', 'sys AS system_index', 'top * 2 AS top', 'bottom * 2 AS bottom', 'coalesce(bottom + lead(top) OVER (PARTITION BY score_id, page ORDER BY top, sys), bottom * 2) AS guard_bottom')} FROM extent""",
}

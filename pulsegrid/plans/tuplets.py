"""Levels of beats whose arities the attacks decide: the event table as scores with tuplet marks and recovered attacks.

A user is a score and a week is a measure of 60 ticks per quarter.  Views are triplet notes on thirds of a beat, clicks quintuplet notes on fifths, signups notes of a
composite sextuplet, errors triplet notes of changing length; purchases bear no mark.  Attacks of purchases and signups count as recovered without marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.functions.rational import int_div
from pulsegrid.operators.hits import merge_hits
from pulsegrid.operators.levels import refine
from pulsegrid.operators.segments import measure_starts, meter_segments, segment_hits
from pulsegrid.plans.events import day_of, read_events, seconds_since_epoch, week_of
from pulsegrid.plans.generic import LONG, as_text, longs

TPQ = 60
WEEK = 604_800
#: event type: ticks it is snapped to, tuplet (actual, normal) or none
STEPS = {"view": (20, (3, 2)), "click": (12, (5, 4)), "signup": (10, (6, 4)), "error": (6, (3, 2)), "purchase": (15, None)}


def _by_type(pick, kind: str) -> Column:
    kept = [(name, pick(step, mark)) for name, (step, mark) in STEPS.items()]
    out = F.lit(None)
    for name, value in kept:
        out = F.when(F.col("event_type") == name, F.lit(value)).otherwise(out)
    return out.cast(kind)


def _meter(week: Column) -> tuple[Column, Column, Column]:
    turn = F.pmod(week, F.lit(3))
    num, den = F.when(turn == 0, 4).when(turn == 1, 3).otherwise(6), F.when(turn == 2, 8).otherwise(4)
    return num, den, int_div(num * 4 * TPQ, den).cast(LONG)


def week_measures(events: DataFrame) -> DataFrame:
    """One measure per week of a user, from the first week or the epoch to the last."""
    week = week_of(day_of(seconds_since_epoch()))
    spans = events.groupBy(F.col("user_id").alias("score_id")).agg(F.min(week).alias("_first"), F.max(week).alias("_last"))
    weeks = spans.select("score_id", F.explode(F.sequence(F.least(F.lit(0), F.col("_first")), F.col("_last"))).alias("measure_index"))
    num, den, full = _meter(F.col("measure_index"))
    return measure_starts(weeks.select("score_id", "measure_index", num.alias("num"), den.alias("den"), full.alias("full"), F.lit(TPQ).alias("tpq")))


def marked_hits(events: DataFrame) -> DataFrame:
    """Attacks merged per (user, week, tick) with their distinct marks, then placed on the timeline."""
    sec = seconds_since_epoch()
    week = week_of(day_of(sec))
    raw = int_div((sec - week.cast(LONG) * WEEK) * _meter(week)[2], WEEK)
    step, odd = _by_type(lambda s, _: s, "bigint"), F.ceil("value").cast(LONG) % 2
    attacks = events.filter(step.isNotNull()).select(
        F.struct(F.col("user_id").alias("score_id"), week.alias("measure_index")).alias("score_id"), (raw - raw % step).alias("onset"), F.col("event_type").alias("pitch"), F.col("event_id").alias("doc_rank"),
        F.when(F.col("event_type") == "error", F.lit(10) - 5 * odd).otherwise(step).cast(LONG).alias("duration"),
        _by_type(lambda _, m: m and m[0], "int").alias("tuplet_actual"), _by_type(lambda _, m: m and m[1], "int").alias("tuplet_normal"))
    local = merge_hits(attacks).select("score_id.*", F.col("onset").alias("offset"), "duration", "source_count", "pitches", "tuplets",
                                       F.arrays_overlap("pitches", F.array(F.lit("purchase"), F.lit("signup"))).alias("canonical_recovered"))
    starts = week_measures(events).select("score_id", "measure_index", "start")
    return local.join(starts, ["score_id", "measure_index"]).withColumn("onset", F.col("start") + F.col("offset")).drop("start")


def tuplet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    return refine(segment_hits(marked_hits(events), meter_segments(week_measures(events))))


def tuplet_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels where explicit tuplets, conflicts, composite tuplets and recovered ternary splits shape the beats."""
    return tuplet_events(spark, sf_dir).select(*longs("score_id", "segment_index", "onset", "height", "density", "lowest_level"), as_text("levels").alias("levels"))


def tuplet_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the refinement reports, by segment: conflicting arities, composite tuplets, recovered ternary splits."""
    notes = tuplet_events(spark, sf_dir).select("score_id", "segment_index", F.explode("notes").alias("_note"))
    code = F.regexp_replace("_note", "^depth:.*$", "depth")
    return notes.select("score_id", "segment_index", code.alias("note")).distinct().select(*longs("score_id", "segment_index"), "note")


QUERIES = {"tuplet_levels": tuplet_levels, "tuplet_notes": tuplet_notes}

SQL_BASE = """
att AS (
  SELECT user_id AS score_id, event_type, sec // 604800 AS m, full_ticks, ceil(value) % 2 AS odd, sec % 604800 * full_ticks // 604800 AS raw,
         CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 12 WHEN 'signup' THEN 10 WHEN 'error' THEN 6 WHEN 'purchase' THEN 15 END AS step
  FROM (SELECT *, CASE WHEN sec // 604800 % 3 = 0 THEN 240 ELSE 180 END AS full_ticks FROM (
    SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 1000000 AS sec FROM events))
),
snapped AS (
  SELECT score_id, m, raw - raw % step AS off, event_type IN ('purchase', 'signup') AS recovered,
         CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 5 WHEN 'signup' THEN 6 WHEN 'error' THEN 3 END AS actual,
         CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'signup' THEN 4 WHEN 'error' THEN 2 END AS normal,
         CASE WHEN event_type = 'error' THEN 10 - 5 * odd ELSE step END AS duration
  FROM att WHERE step IS NOT NULL
),
meas AS (
  SELECT *, sum(full_ticks) OVER (PARTITION BY score_id ORDER BY m) - full_ticks AS start_tick FROM (
    SELECT score_id, m, CASE m % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 6 END AS num, CASE WHEN m % 3 = 0 THEN 240 ELSE 180 END AS full_ticks
    FROM (SELECT score_id, unnest(range(0, max(m) + 1)) AS m FROM att GROUP BY 1))
),
seg AS (
  SELECT score_id, m AS segment_index, start_tick, start_tick + full_ticks AS end_tick, CASE WHEN num = 6 THEN 90 ELSE 60 END AS width, CASE WHEN num = 3 THEN 3 ELSE 2 END AS base,
         CASE WHEN num = 6 THEN 3 ELSE 2 END AS usual
  FROM meas
),
placed AS (
  SELECT DISTINCT s.score_id, g.segment_index, g.start_tick + s.off AS onset, g.start_tick, g.width, g.base, g.usual, (g.end_tick - g.start_tick) // g.width AS beats, s.off // g.width AS beat, s.off % g.width AS rel
  FROM snapped s JOIN seg g ON g.score_id = s.score_id AND g.segment_index = s.m
)
"""

SQL_SPANS = """
inner_hits AS (SELECT score_id, segment_index, beat, width, rel FROM placed WHERE rel > 0),
recovered AS (SELECT DISTINCT s.score_id, s.m AS segment_index, s.off // g.width AS beat, s.off % g.width AS rel FROM snapped s JOIN seg g ON g.score_id = s.score_id AND g.segment_index = s.m WHERE s.recovered),
noted AS (
  SELECT DISTINCT s.score_id, s.m AS segment_index, s.off // g.width AS beat, s.off % g.width AS rel, s.actual, s.normal, s.duration
  FROM snapped s JOIN seg g ON g.score_id = s.score_id AND g.segment_index = s.m WHERE s.actual IS NOT NULL
),
gaps AS (
  SELECT score_id, segment_index, beat, width, rel - lag(rel, 1, 0) OVER w AS gap FROM inner_hits WINDOW w AS (PARTITION BY score_id, segment_index, beat ORDER BY rel)
  UNION ALL SELECT score_id, segment_index, beat, width, width - max(rel) FROM inner_hits GROUP BY score_id, segment_index, beat, width
),
caps AS (SELECT score_id, segment_index, beat, 6 + CAST(ceil(log2(width / min(gap))) AS BIGINT) AS cap FROM gaps GROUP BY score_id, segment_index, beat, width),
spans AS (
  SELECT DISTINCT p.score_id, p.segment_index, p.beat, p.width, CAST(0 AS BIGINT) AS q, CAST(1 AS BIGINT) AS s, u.lv AS parent, p.usual, c.cap, 0 AS depth
  FROM placed p JOIN caps c USING (score_id, segment_index, beat) JOIN unit_spans u ON u.base = p.base AND u.beats = p.beats AND u.pos = p.beat
  UNION ALL
  SELECT score_id, segment_index, beat, width, q * f + k, s * f, parent + least(k + 1, f - 1), 2, cap, depth + 1 FROM ({factored}) d, range(0, 5) r(k)
  WHERE k < f AND depth < cap AND EXISTS (
    SELECT 1 FROM inner_hits h WHERE h.score_id = d.score_id AND h.segment_index = d.segment_index AND h.beat = d.beat
      AND h.rel * d.s * d.f > (d.q * d.f + k) * d.width AND h.rel * d.s * d.f < (d.q * d.f + k + 1) * d.width)
)
"""

#: Spans with the arity that their votes give them.
FACTORED = """
SELECT *, CASE WHEN low = high THEN low WHEN ternary THEN 3 ELSE usual END AS f, low < high AS conflict, ternary AND coalesce(low <> high, TRUE) AS recovered_split FROM (
  SELECT v.*, v.usual = 2 AND EXISTS (
      SELECT 1 FROM recovered h WHERE h.score_id = v.score_id AND h.segment_index = v.segment_index AND h.beat = v.beat AND h.rel * v.s > v.q * v.width AND h.rel * v.s < (v.q + 1) * v.width
        AND v.width // gcd(v.width, h.rel * v.s - v.q * v.width) % 3 = 0) AS ternary
  FROM (
    SELECT score_id, segment_index, beat, width, q, s, parent, usual, cap, depth,
      CASE WHEN bool_or(filled) THEN min(actual) FILTER (filled) ELSE min(actual) FILTER (n > 1) END AS low,
      CASE WHEN bool_or(filled) THEN max(actual) FILTER (filled) ELSE max(actual) FILTER (n > 1) END AS high
    FROM (
      SELECT x.score_id, x.segment_index, x.beat, x.width, x.q, x.s, x.parent, x.usual, x.cap, x.depth, n.actual, count(DISTINCT n.rel) AS n, bool_or(n.duration * n.actual * x.s = x.width) AS filled
      FROM spans x LEFT JOIN noted n ON n.score_id = x.score_id AND n.segment_index = x.segment_index AND n.beat = x.beat AND n.actual IN (2, 3, 5, 7) AND n.rel * x.s >= x.q * x.width
        AND n.rel * x.s < (x.q + 1) * x.width AND (n.rel * x.s - x.q * x.width) * n.actual % x.width = 0
      GROUP BY x.score_id, x.segment_index, x.beat, x.width, x.q, x.s, x.parent, x.usual, x.cap, x.depth, n.actual
    ) GROUP BY score_id, segment_index, beat, width, q, s, parent, usual, cap, depth
  ) v
)"""

SQL_LEVELS = """
split AS (SELECT * FROM ({factored}) WHERE depth < cap),
stack AS (
  SELECT p.score_id, p.segment_index, p.onset, g.lv FROM placed p JOIN marks g ON g.base = p.base AND g.beats = p.beats AND p.rel = 0 AND g.pos = p.beat
  UNION
  SELECT p.score_id, p.segment_index, p.onset, s.parent + v.lv
  FROM split s JOIN (VALUES (2, 0, 1), (2, 1, 1), (2, 2, 1), (3, 0, 1), (3, 1, 1), (3, 1, 2), (3, 2, 2), (3, 3, 1), (3, 3, 2),
    (5, 0, 1), (5, 1, 1), (5, 1, 2), (5, 2, 2), (5, 2, 3), (5, 3, 3), (5, 3, 4), (5, 4, 4), (5, 5, 1), (5, 5, 2), (5, 5, 3), (5, 5, 4)) v(f, k, lv) ON v.f = s.f
  JOIN placed p ON p.score_id = s.score_id AND p.segment_index = s.segment_index AND (p.onset - p.start_tick) * s.s * s.f = (s.beat * s.s * s.f + s.q * s.f + v.k) * s.width
)
"""


def oracles(with_, longs_, grid: str) -> dict[str, str]:
    base = with_(SQL_BASE, grid, SQL_SPANS.replace("{factored}", FACTORED))
    return {
        "tuplet_levels": base.rstrip() + "," + SQL_LEVELS.replace("{factored}", FACTORED) + f"""
SELECT {longs_('p.score_id AS score_id', 'p.segment_index AS segment_index', 'p.onset AS onset', 'coalesce(max(s.lv), 0) AS height', 'count(s.lv) AS density', 'coalesce(min(s.lv), 0) AS lowest_level')},
  coalesce(string_agg(s.lv, ',' ORDER BY s.lv), '') AS levels
FROM (SELECT DISTINCT score_id, segment_index, onset FROM placed) p LEFT JOIN stack s USING (score_id, segment_index, onset) GROUP BY p.score_id, p.segment_index, p.onset""",
        "tuplet_notes": base + f"""
, decided AS ({FACTORED}),
told AS (
  SELECT score_id, segment_index, CASE WHEN depth >= cap THEN 'depth' WHEN conflict THEN 'conflict' END AS note FROM decided
  UNION SELECT score_id, segment_index, 'ternary' FROM decided WHERE depth < cap AND recovered_split
  UNION SELECT d.score_id, d.segment_index, 'composite:' || n.actual || ':' || n.normal FROM decided d JOIN noted n ON n.score_id = d.score_id AND n.segment_index = d.segment_index AND n.beat = d.beat
    AND n.actual NOT IN (2, 3, 5, 7) AND n.rel * d.s >= d.q * d.width AND n.rel * d.s < (d.q + 1) * d.width WHERE depth < cap
)
SELECT DISTINCT {longs_('score_id', 'segment_index')}, note FROM told WHERE note IS NOT NULL""",
    }

"""Meter columns: text and symbol parsing, beat properties, beat names, primality."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.functions.rational import rational_text

# Time-signature symbols that override the printed numbers.
CUT_SYMBOLS = ("cut", "cut-time", "alla-breve", "allabreve")
COMMON_SYMBOLS = ("common", "common-time")

# Names of beat units, keyed by their length in quarters.
BEAT_UNIT_NAMES = {
    "4": "whole note",
    "2": "half note",
    "1": "quarter note",
    "1/2": "eighth note",
    "1/4": "sixteenth note",
    "3/2": "dotted quarter note",
    "3": "dotted half note",
}

# The largest powers of 2 and 3 below 2^63: n is a power of the base exactly when it divides them.
_MAX_POWER = {2: 1 << 62, 3: 3**39}


def is_power_of(value: Column, base: int) -> Column:
    return (value >= 1) & (F.lit(_MAX_POWER[base]).cast("bigint") % F.greatest(value, F.lit(1)).cast("bigint") == 0)


def is_prime(value: Column) -> Column:
    trial = F.sequence(F.lit(2).cast("bigint"), F.greatest(F.lit(2).cast("bigint"), F.floor(F.sqrt(value.cast("double"))).cast("bigint")))
    return F.when(value < 2, F.lit(False)).when(value < 4, F.lit(True)).otherwise(~F.exists(trial, lambda d: value % d == 0))


def parse_meter(text: Column) -> Column:
    """``n/d`` to struct<num,den>; null for empty, ``auto``, malformed or non-positive text."""
    clean = F.lower(F.trim(text))
    parts = F.split(clean, "/", 2)
    num = F.trim(parts[0]).try_cast("int")
    den = F.trim(F.get(parts, F.lit(1))).try_cast("int")
    return F.when((clean != "auto") & (num > 0) & (den > 0), F.struct(num.alias("num"), den.alias("den")))


def normalized_meter(symbol: Column, num: Column, den: Column) -> Column:
    """Printed numbers unless a cut or common symbol says otherwise."""
    s = F.replace(F.lower(F.trim(F.coalesce(symbol, F.lit("")))), F.lit("_"), F.lit("-"))
    cut = s.isin(*CUT_SYMBOLS) | (s.contains("cut") & s.contains("time"))
    fixed = lambda n, d: F.struct(F.lit(n).cast("int").alias("num"), F.lit(d).cast("int").alias("den"))
    return F.when(cut, fixed(2, 2)).when(s.isin(*COMMON_SYMBOLS), fixed(4, 4)).otherwise(
        F.struct(num.cast("int").alias("num"), den.cast("int").alias("den"))
    )


def meter_columns(num: Column, den: Column, tpq: Column | int) -> dict[str, Column]:
    """Beat length in ticks, beats per measure, top-level base and whether the base is a fallback."""
    compound = (num > 3) & (num % 3 == 0)
    beats = F.when(compound, F.call_function("div", num, F.lit(3))).otherwise(num).cast("int")
    ticks = F.lit(tpq) if isinstance(tpq, int) else tpq
    beat_ticks = F.call_function("div", F.when(compound, F.lit(12)).otherwise(F.lit(4)) * ticks, den).cast("bigint")
    binary, ternary = is_power_of(beats, 2), is_power_of(beats, 3)
    return {
        "beat_ticks": beat_ticks,
        "beat_count": beats,
        "top_base": F.when(binary, F.lit(2)).when(ternary, F.lit(3)).otherwise(F.lit(2)),
        "compound": compound,
        "base_is_fallback": ~(binary | ternary),
    }


def beat_unit_name(beat_ticks: Column, tpq: Column | int) -> Column:
    text = rational_text(beat_ticks, F.lit(tpq) if isinstance(tpq, int) else tpq)
    names = F.create_map(*[F.lit(x) for pair in BEAT_UNIT_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, text), F.concat(text, F.lit(" quarter-note units")))

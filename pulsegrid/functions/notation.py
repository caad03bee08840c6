"""Notation columns: pitch spelling, ties, tuplets, shapes, durations from shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pulsegrid.functions.rational import power_of_two

# Accidentals by chromatic alteration.
ACCIDENTALS = {2: "##", 1: "#", 0: "", -1: "b", -2: "bb"}

# Rest shapes and their length in quarters (numerator, denominator), in matching order, and text patterns.
REST_QUARTERS = {"LONG_REST": (8, 1), "WHOLE_REST": (4, 1), "HALF_REST": (2, 1), "QUARTER_REST": (1, 1), "EIGHTH_REST": (1, 2)}
REST_FRACTION_PATTERN = r"(?:ONE_)?(\d+)(?:TH|ND|ST|RD)_REST"
FLAG_PATTERN = r"FLAG_(\d+)"
SHEET_PATTERN = r"(?i)sheet#(\d+)"
SHEET_MEMBER_PATTERN = r"(?i)sheet#\d+/sheet#\d+\.xml$"
MEASURE_NUMBER_PATTERN = r"^\s*(-?\d+)\s*$"



def pitch_text(step: Column, alter: Column, octave: Column, unpitched: Column) -> Column:
    """``C#4`` style spelling; a note with neither pitch nor unpitched mark is unknown."""
    table = F.create_map(*[F.lit(x) for pair in ACCIDENTALS.items() for x in pair])
    sign = F.coalesce(alter, F.lit(0)).cast("int")
    other = F.concat(F.lit("("), F.when(sign > 0, "+").otherwise(""), sign.cast("string"), F.lit(")"))
    spelled = F.concat(F.coalesce(step, F.lit("?")), F.coalesce(F.try_element_at(table, sign), other), F.coalesce(octave, F.lit("?")))
    has_pitch = step.isNotNull() | octave.isNotNull() | alter.isNotNull()
    return F.when(has_pitch, spelled).when(F.coalesce(unpitched, F.lit(False)), "unpitched").otherwise("unknown")


def tie_flag(tie_types: Column, kind: str) -> Column:
    return F.coalesce(F.array_contains(F.transform(tie_types, F.lower), kind), F.lit(False))


def tuplet_ratio(actual: Column, normal: Column) -> Column:
    """struct<actual,normal>, null unless actual >= 2 and normal >= 1."""
    return F.when((actual >= 2) & (normal >= 1), F.struct(actual.cast("int").alias("actual"), normal.cast("int").alias("normal")))


def clamp_unit(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def head_kind(shapes: Column) -> Column:
    """whole, half or black from the head shapes of a chord (array of text)."""
    text = F.upper(F.array_join(F.transform(shapes, lambda s: F.coalesce(s, F.lit(""))), " "))
    return F.when(text.contains("WHOLE"), "whole").when(text.contains("VOID") | text.contains("HALF"), "half").otherwise("black")


def head_quarters(kind: Column) -> Column:
    return F.when(kind == "whole", 4).when(kind == "half", 2).otherwise(1).cast("bigint")


def rest_quarters(shape: Column) -> Column:
    """Length of a rest shape in quarters as struct<num,den>; null for an unknown shape."""
    s = F.upper(F.coalesce(shape, F.lit("")))
    out = None
    for name, (num, den) in REST_QUARTERS.items():
        value = F.struct(F.lit(num).cast("bigint").alias("num"), F.lit(den).cast("bigint").alias("den"))
        out = F.when(s.contains(name), value) if out is None else out.when(s.contains(name), value)
    den = F.regexp_extract(s, REST_FRACTION_PATTERN, 1).try_cast("bigint")
    return out.when(den > 0, F.struct(F.lit(4).cast("bigint").alias("num"), den.alias("den")))


def flag_count(shape: Column) -> Column:
    """Flags named by one flag shape; a flag without a number counts once."""
    n = F.regexp_extract(F.upper(F.coalesce(shape, F.lit(""))), FLAG_PATTERN, 1).try_cast("int")
    return F.coalesce(n, F.lit(1))


def dotted(num: Column, den: Column, dots: Column) -> Column:
    """num/den lengthened by augmentation dots: times (2^(n+1) - 1) / 2^n."""
    n = F.greatest(dots, F.lit(0))
    two_n = power_of_two(n)
    return F.struct((num * (two_n * 2 - 1)).cast("bigint").alias("num"), (den * two_n).cast("bigint").alias("den"))


def chord_quarters(kind: Column, beams: Column, flags: Column, dots: Column) -> Column:
    """Length of a head chord: shape base, halved per beam or flag when the base is a quarter or less, then dots."""
    base = head_quarters(kind)
    splits = F.greatest(beams, flags).cast("int")
    den = F.when(base <= 1, power_of_two(splits)).otherwise(F.lit(1).cast("bigint"))
    return dotted(base, den, dots)


def sheet_number(member: Column) -> Column:
    return F.coalesce(F.regexp_extract(member, SHEET_PATTERN, 1).try_cast("int"), F.lit(1_000_000_000))


def measure_number(text: Column) -> Column:
    return F.regexp_extract(F.coalesce(text, F.lit("")), MEASURE_NUMBER_PATTERN, 1).try_cast("int")


def is_notehead(shape: Column) -> Column:
    return F.replace(F.lower(F.coalesce(shape, F.lit(""))), F.lit("_"), F.lit("")).contains("notehead")

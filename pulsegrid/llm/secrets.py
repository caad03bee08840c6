r"""Secret scan: fixed patterns plus a randomness test battery under length-aware false-discovery control.

Base kinds are three patterns, matched leftmost without overlap.  The battery adds a fourth kind, ``random``: runs of 20 or more
characters of the encoding alphabets that no base span touches.  For each run an encoding is inferred from its characters, and over
the positions in that encoding's alphabet three tests are made:

* chi-squared: observed against uniform use of the alphabet;
* runs: crossings of the middle of the alphabet against their number in a random sequence;
* serial correlation: neighbouring positions against independence.

A run is *plausibly random* if the three two-sided p-values, Bonferroni-combined, do not reject randomness.  Short runs pass that easily,
so it is not enough: under the null "structured text" the alphabet is used ``CONCENTRATION`` times more unevenly, and the p-value of the
chi-squared value under that null is what gets controlled.  It depends on length: short runs cannot reach a small one.  Distinct runs of the
whole corpus are counted by (encoding, length class, p-value bin); Benjamini-Hochberg in each such stratum gives the cut-off.  That table
has at most ``len(ENCODINGS) * LENGTH_CLASSES * BINS`` rows whatever the corpus, so its cut-offs may pass through the driver.

Everything is native expressions; a row stays one row and the only shuffle is that of the counts.  Null text is an empty text: no spans.
Empty tables give empty results, repeated rows are scanned one by one, other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import fresh

#: Base kinds in the order that breaks ties, their patterns, and the least length of what is kept.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
ASSIGN_HEAD = r"^[^:=]*[:=]\x20*[\"']?"
ASSIGN_VALUE = 12
#: A run that is too short has no longer run inside it, so the least length can stand in these two patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

#: Encodings by first match, with alphabet and how much more unevenly ordinary text uses it (a * sum of squared shares).
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 1.6),
    ("lower", "^[a-z]+$", LOWER, 1.7),
    ("upper", "^[A-Z]+$", UPPER, 1.7),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567", 2.1),
    ("base36", "^[a-z0-9]+$", DIGITS + LOWER, 2.3),
    ("base62", "^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 4.0),
    ("base64", "^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 4.2),
    ("base64url", "", UPPER + LOWER + DIGITS + "-_", 4.2),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LENGTH_CLASSES = 32
BINS = 300
FALSE_DISCOVERIES = 0.01
RANDOMNESS_LEVEL = 0.01

SPAN = "struct<kind:string,start:int,end:int>"


def prefix_sums(values: Column) -> Column:
    """Inclusive prefix sums of an array by doubling: O(n log n) and no growing accumulator."""
    n = F.size(values)
    widths = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda width: width < n)

    def double(x: Column, width: Column) -> Column:
        return F.zip_with(x, F.concat(F.array_repeat(F.lit(0), width), F.slice(x, F.lit(1), n - width)), lambda a, b: a + b)

    return F.aggregate(widths, values, double)


def _located(text: Column, found: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: the texts between them and their own lengths add up to their starts (in characters)."""
    n = F.size(found)
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), n)
    before = F.concat(F.array(F.lit(0)), F.slice(F.transform(found, F.length), F.lit(1), n - 1))
    starts = prefix_sums(F.zip_with(gaps, before, lambda a, b: a + b))
    spans = F.zip_with(starts, found, lambda s, m: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).alias("end")))
    return F.when(n > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _normal_tail(z: Column) -> Column:
    """P(Z > |z|) of the standard normal, by the usual five-term polynomial (fixed values), accurate to 1e-7."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi) * poly


def _by_encoding(encoding: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for (name, *_), value in reversed(list(zip(ENCODINGS[:-1], values[:-1], strict=True))):
        out = F.when(encoding == name, F.lit(value)).otherwise(out)
    return out


def assess(df: DataFrame, column: str) -> DataFrame:
    """Replace ``column``, an array of structs (span, token), by an array of (span, token, encoding, length_class, chi2, z_runs, z_serial, p_random, bin).

    ``bin`` is the whole part of -10 log10 of the p-value under the structured null, 0 to BINS - 1.  The tests run in steps, each adding
    fields to the structs, so that every value is computed once.
    """
    fields = ["span", "token"]

    def step(**added) -> None:
        nonlocal df
        old = list(fields)
        df = df.withColumn(column, F.transform(F.col(column), lambda j: F.struct(*[j[f].alias(f) for f in old], *[make(j).alias(f) for f, make in added.items()])))
        fields.extend(added)

    def total(values: Column, of) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + of(v))

    def encoding(j: Column) -> Column:
        out = F.lit(ENCODINGS[-1][0])
        for name, pattern, *_ in reversed(ENCODINGS[:-1]):
            out = F.when(j["token"].rlike(pattern), name).otherwise(out)
        return out

    def two_sided(z: Column) -> Column:
        return 2.0 * _normal_tail(z)

    def uneven(j: Column) -> Column:
        return (j["n"] - 1.0) * (_by_encoding(j["encoding"], [e[3] for e in ENCODINGS]) - 1.0)

    step(encoding=encoding)
    step(folded=lambda j: F.when(j["encoding"] == "hex", F.lower(j["token"])).otherwise(j["token"]),
         alphabet=lambda j: _by_encoding(j["encoding"], [e[2] for e in ENCODINGS]))
    step(n=lambda j: F.length(j["folded"]).cast("double"), a=lambda j: F.length(j["alphabet"]).cast("double"),
         chars=lambda j: F.filter(F.split(j["folded"], "", -1), lambda c: c != ""))
    step(squares=lambda j: total(F.array_distinct(j["chars"]), lambda c: F.pow(j["n"] - F.length(F.replace(j["folded"], c, F.lit(""))), F.lit(2))),
         x=lambda j: F.transform(j["chars"], lambda c: F.instr(j["alphabet"], c).cast("double") - (j["a"] + 1.0) / 2.0))
    step(chi2=lambda j: j["a"] / j["n"] * j["squares"] - j["n"], mean=lambda j: total(j["x"], lambda v: v) / j["n"],
         high=lambda j: total(j["x"], lambda v: F.when(v > 0, 1.0).otherwise(0.0)),
         pairs=lambda j: F.zip_with(F.slice(j["x"], F.lit(1), F.size(j["x"]) - 1), F.slice(j["x"], F.lit(2), F.size(j["x"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    step(runs=lambda j: 1.0 + total(j["pairs"], lambda p: F.when((p["a"] > 0) != (p["b"] > 0), 1.0).otherwise(0.0)),
         var=lambda j: total(j["x"], lambda v: F.pow(v - j["mean"], F.lit(2))),
         cov=lambda j: total(j["pairs"], lambda p: (p["a"] - j["mean"]) * (p["b"] - j["mean"])),
         both=lambda j: 2.0 * j["high"] * (j["n"] - j["high"]))
    step(spread=lambda j: j["both"] * (j["both"] - j["n"]) / (j["n"] * j["n"] * (j["n"] - 1.0)), shift=uneven)
    step(z_chi=lambda j: (j["chi2"] - j["a"] + 1.0) / F.sqrt(2.0 * (j["a"] - 1.0) * (j["n"] - 1.0) / j["n"]),
         z_runs=lambda j: F.when(j["spread"] > 0, (j["runs"] - 1.0 - j["both"] / j["n"]) / F.sqrt(j["spread"])).otherwise(-F.sqrt(j["n"])),
         z_serial=lambda j: F.when(j["var"] > 0, (j["cov"] / j["var"] + 1.0 / j["n"]) * F.sqrt(j["n"])).otherwise(F.sqrt(j["n"])),
         z=lambda j: (j["chi2"] - j["a"] + 1.0 - j["shift"]) / F.sqrt(2.0 * (j["a"] - 1.0) + 4.0 * j["shift"]))
    step(p_random=lambda j: F.least(F.lit(1.0), 3.0 * F.least(two_sided(j["z_chi"]), two_sided(j["z_runs"]), two_sided(j["z_serial"]))),
         bin=lambda j: F.when(j["z"] < 0, F.least(F.lit(BINS - 1), F.floor(-10.0 * F.log10(F.greatest(_normal_tail(j["z"]), F.lit(1e-300)))).cast("int"))).otherwise(F.lit(0)),
         length_class=lambda j: F.least(F.lit(LENGTH_CLASSES - 1), F.floor(2.0 * F.log2(j["n"] / 5.0)).cast("int")))
    shown = ["span", "token", "encoding", "length_class", "chi2", "z_runs", "z_serial", "p_random", "bin"]
    return df.withColumn(column, F.transform(F.col(column), lambda j: F.struct(*[j[f].alias(f) for f in shown])))


def cutoffs(df: DataFrame, text: str, rate: float = FALSE_DISCOVERIES) -> dict[tuple[str, int], int]:
    """Least p-value bin that counts as a discovery, by (encoding, length class): Benjamini-Hochberg over the distinct runs of all rows."""
    tokens = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))).alias("token")).distinct()
    runs = tokens.select(F.array(F.struct(F.lit(0).alias("span"), "token")).alias("runs"))
    counts = assess(runs, "runs").select(F.col("runs")[0].alias("r")).groupBy("r.encoding", "r.length_class", "r.bin").count().collect()
    strata: dict[tuple[str, int], dict[int, int]] = {}
    for row in counts:
        strata.setdefault((row["encoding"], row["length_class"]), {})[row["bin"]] = row["count"]
    out = {}
    for stratum, by_bin in strata.items():
        tested, reached = sum(by_bin.values()), 0
        for b in sorted(by_bin, reverse=True):
            reached += by_bin[b]
            if 10.0 ** (-b / 10.0) <= rate * reached / tested:
                out[stratum] = b
    return out


def scan(df: DataFrame, text: str = "text", out: str = "secret_spans", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Add ``out``: array of (kind, start, end), base kinds first in KINDS order, then ``random``; code points, end exclusive.

    Input columns pass through under their own names; helper columns avoid them.
    """
    cut = cutoffs(df, text, rate)
    t, found, base = fresh(df, "_scan_text"), fresh(df, "_scan_found"), fresh(df, "_scan_base")
    names = [fresh(df, f"_scan_{k}") for k in KINDS]
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    for name, pattern in zip(names, (ASSIGN, ACCESS, HEX), strict=True):
        df = df.withColumn(name, F.regexp_extract_all(F.col(t), F.lit(pattern), F.lit(0)))
    df = df.withColumn(found, F.regexp_extract_all(F.col(t), F.lit(CANDIDATE), F.lit(0)))
    long_enough = F.transform(F.col(names[0]), lambda m: F.length(F.regexp_replace(m, F.lit(ASSIGN_HEAD), F.lit(""))) >= ASSIGN_VALUE)
    assigned = F.zip_with(_located(F.col(t), F.col(names[0]), ASSIGN, "assign"), long_enough, lambda s, ok: F.when(ok, s))
    df = df.withColumn(base, F.concat(
        F.filter(assigned, lambda s: s.isNotNull()),
        _located(F.col(t), F.col(names[1]), ACCESS, "access"), _located(F.col(t), F.col(names[2]), HEX, "hex")))
    if not cut:
        return df.withColumn(out, F.col(base).cast(f"array<{SPAN}>")).drop(t, found, base, *names)
    # A run is assessed where it stands: one row per document goes in and comes out, so its tests run inside the array.
    spans = _located(F.col(t), F.col(found), CANDIDATE, "random")
    judged = F.zip_with(spans, F.col(found), lambda s, m: F.struct(s.alias("span"), m.alias("token")))
    free = F.filter(judged, lambda j: ~F.exists(F.col(base), lambda b: (b["start"] < j["span"]["end"]) & (b["end"] > j["span"]["start"])))
    df = df.withColumn(found, free)
    df = assess(df, found)
    least = F.create_map(*[F.lit(x) for (e, c), b in sorted(cut.items()) for x in (f"{e}:{c}", b)])
    stratum = lambda j: F.concat_ws(":", j["encoding"], j["length_class"].cast("string"))
    extra = F.filter(F.col(found), lambda j: (j["p_random"] >= RANDOMNESS_LEVEL) & (j["bin"] >= F.coalesce(least[stratum(j)], F.lit(BINS))))
    df = df.withColumn(out, F.concat(F.col(base), F.transform(extra, lambda j: j["span"])).cast(f"array<{SPAN}>"))
    return df.drop(t, found, base, *names)


def redact(df: DataFrame, text: str = "text", spans: str = "secret_spans", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span of the text by the mark (overlapping spans by one) and drop the span column; null text stays null."""
    ordered, done = F.array_sort(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), fresh(df, "_scan_done")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        joined = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(piece)).alias("parts"))
        within = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["start"] >= acc["at"], joined).otherwise(within)

    df = df.withColumn(done, F.when(F.size(spans) > 0, F.aggregate(ordered, start, add)))
    clean = F.concat(F.array_join(F.col(f"{done}.parts"), ""), F.substring(F.col(text), F.col(f"{done}.at") + 1, F.length(text)))
    return df.withColumn(text, F.when(F.col(done).isNotNull(), clean).otherwise(F.col(text))).drop(done, spans)


def listed(spans: Column, kinds: tuple[str, ...] = (*KINDS, "random")) -> Column:
    """kind:start:end of the spans, by start, then kind in the given order, comma-joined."""
    order = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

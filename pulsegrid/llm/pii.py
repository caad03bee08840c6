r"""Personal data with offset-preserving deobfuscation.

Base spans are what four detectors find in the text itself.  For the disguised ones, two transducers rewrite the text and remember for every character
they put out which source range it stands for:

* characters: homoglyphs and compatibility forms become ASCII, invisible characters go;
* words: ``(at)``, ``[dot]``, HTML character codes, ``name at host dot org``, ``192 dot 168 dot ...``, and runs of three or more digits spelled in English,
  French, German or Spanish, with or without ``double`` and ``triple``.  A bare address needs a known ending (any country code or a common generic one), or any
  ending of letters if its name or host is dotted or a word such as ``mail`` or ``write to`` stands right before it.

The same detectors run over the rewritten text; a span that touches a rewritten place and lies in no base span of its kind is mapped back to
the source and added.  Rewriting starts only where something in the text can be rewritten, so clean texts are left alone.

All detectors are linear in the text: no pattern can start again inside a run it has given up on.  Null text is empty; repeated rows are scanned one by one.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain: each at sign is tried once, with all of the run before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in _LOCAL_SET):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


_LOCAL_SET = frozenset(c for c in map(chr, range(128)) if re.match(_LOCAL, c))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def detect(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four kinds in a text, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_part, m[0].split(".")))]
    out += [("card", s, e) for s, e in _cards(text)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: Letters of other scripts that look like ASCII ones; compatibility forms and other digits follow from the character database.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ⅼ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
_INVISIBLE = "­​‌‍⁠﻿"


def _plain(c: str) -> str | None:
    """ASCII form of a character that only looks different; None for one that stands for itself."""
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    return form if form != c and len(form) == 1 and form.isascii() and not unicodedata.category(c) in ("No", "Lm") else None


_PLAIN = {c: p for c in map(chr, range(128, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (p := _plain(c)) is not None}
_ODD = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]")

#: Spelled digits in the languages of the corpus, words for repeated digits, and the words for the signs.
_DIGITS = ("zero oh z[éÉ]ro null cero", "one un une eins ein uno una", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro", "five cinq f[üÜ]nf fuenf cinco",
           "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve")
_SPELLED = {re.sub(r"\[(.).\]", r"\1", word): str(digit) for digit, words in enumerate(_DIGITS) for word in words.split()}
_TIMES = {"double": 2, "doppel": 2, "doble": 2, "triple": 3}
_AT, _DOT, _PLUS = "(?:at|arroba)", "(?:dot|punkt|point|punto)", "(?:plus|m[áÁ]s|mas)"
#: Endings that make ``name at host dot ending`` an address: first those that always do, then the country codes.
_CODES = """ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk
dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp ke kg kh ki km kn
kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps
pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws
ye yt za zm zw"""
_TOP = "(?:com|org|net|edu|gov|mil|info|biz|io|de|fr|es|uk|eu|ch|nl|ca|au)"
_CODE = "(?:int|name|pro|app|dev|cloud|online|shop|site|tech|cat|" + "|".join(_CODES.split()) + ")"
#: Words that are no host; with them and a code that is a word (``look at the dot in``) it is ordinary text.
_NO_HOST = r"(?!(?:the|an?|this|that|these|those|each|every|any|some|no|one|my|your|his|her|its|our|their|which|what)\x20)"
#: Words right before an address that say it is one.
_CUE = r"(?:e-?mail(?:s|ed)?|mailto|mail|contact|write\x20to|correo|courriel|escr[iíÍ]b[ea]\x20a|[éÉe]crire\x20[àa]|schreib(?:en\x20sie)?\x20an)"
_NAME = "(?:" + "|".join(sorted((w for words in _DIGITS for w in words.split()), key=lambda w: (-len(w), w))) + ")"
_MANY, _LETTER, _GAP = "(?:" + "|".join(_TIMES) + ")", "[A-Za-z\u00c0-\u024f]", r"[\x20,-]{1,3}"
_UNIT = rf"(?:{_MANY}{_GAP})?{_NAME}(?!{_LETTER})"
_RUN = rf"(?<!{_LETTER})(?:{_PLUS}{_GAP})?{_UNIT}(?:{_GAP}(?:{_DOT}{_GAP})?{_UNIT}){{2,}}+"
_DOTTED, _END = rf"\x20{{1,2}}{_DOT}\x20{{1,2}}", "(?![A-Za-z0-9-])"
_LEFT, _SIGN, _HOST = rf"{_LOCAL}++(?:{_DOTTED}{_LOCAL}++){{0,4}}", rf"\x20{{1,2}}{_AT}\x20{{1,2}}", "[A-Za-z0-9-]++"
_ANY = rf"{_DOTTED}[A-Za-z]{{2,24}}+{_END}"
_BARE = (rf"(?<!{_LOCAL})(?=(?:{_CUE}[:\x20]{{1,3}})?{_LEFT}{_SIGN}|{_LEFT}{_SIGN})(?:"
         rf"{_LEFT}{_SIGN}{_HOST}(?:{_DOTTED}{_HOST}){{0,4}}{_DOTTED}{_TOP}{_END}"
         rf"|{_CUE}[:\x20]{{1,3}}{_LEFT}{_SIGN}{_NO_HOST}{_HOST}(?:{_DOTTED}{_HOST}){{0,4}}{_ANY}"
         rf"|{_LEFT}{_SIGN}{_NO_HOST}{_HOST}(?:{_DOTTED}{_HOST}){{1,4}}{_ANY}"
         rf"|(?:(?=[A-Za-z0-9_%+-]+\.[A-Za-z0-9_%+-])|(?={_LOCAL}++{_DOTTED})){_LEFT}{_SIGN}{_NO_HOST}{_HOST}{_ANY}"
         rf"|{_LEFT}{_SIGN}{_NO_HOST}{_HOST}{_DOTTED}{_CODE}{_END})")
_WORDS = re.compile(
    rf"(?P<spelled>{_RUN})"
    rf"|(?P<at>\x20{{0,2}}[\[({{<]\x20{{0,2}}(?:{_AT}|@)\x20{{0,2}}[\])}}>]\x20{{0,2}}|&\#64;|&\#x40;|&commat;)"
    rf"|(?P<dot>\x20{{0,2}}[\[({{<]\x20{{0,2}}(?:{_DOT}|\.)\x20{{0,2}}[\])}}>]\x20{{0,2}}|&\#46;|&\#x2e;|&period;|(?<=[0-9])\x20{{1,2}}{_DOT}\x20{{1,2}}(?=[0-9]))"
    rf"|(?P<bare>{_BARE})",
    re.I | re.A)
_HINT = re.compile(rf"[\[({{<]\x20{{0,2}}(?:{_AT}|{_DOT}|@|\.)\x20{{0,2}}[\])}}>]|&\#(?:64|46|x40|x2e);|&commat;|&period;|\x20{_DOT}\x20|{_NAME}{_GAP}(?:{_DOT}{_GAP})?(?:{_MANY}{_GAP})?{_NAME}[\x20,-]", re.I | re.A)
_TOKEN = re.compile(rf"(?:(?P<many>{_MANY}){_GAP})?(?P<name>{_NAME})|{_DOT}|(?P<plus>{_PLUS})", re.I | re.A)
_BARE_SIGN = re.compile(rf"\x20{{1,2}}(?:{_AT}|{_DOT})\x20{{1,2}}", re.I | re.A)


class Rewritten:
    """Text put out by a transducer, with the source range of every character and whether it was rewritten."""

    def __init__(self, text: str, source: "Rewritten | None" = None):
        self.source, self.text, self.from_, self.to, self.new = source, text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def through(self, edits: list[tuple[int, int, str]]) -> "Rewritten":
        """Apply edits (start, end, replacement), in order and without overlap; ranges stay those of the first source."""
        out, parts, at = Rewritten("", self), [], 0
        for start, end, text in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:start], text]
            out.from_ += self.from_[at:start] + [self.from_[start]] * len(text) if text else self.from_[at:start]
            out.to += self.to[at:start] + [self.to[end - 1]] * len(text)
            out.new += self.new[at:start] + b"\1" * len(text)
            if start < end and not text and out.new:  # what has gone counts as a rewritten place of its neighbour
                out.new[-1] = 1
            at = end
        out.text = "".join(parts)
        return out

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.from_[start], self.to[end - 1]


def _character_edits(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), _PLAIN[m[0]]) for m in _ODD.finditer(text)]


def _word_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _WORDS.finditer(text):
        if m.lastgroup == "spelled":
            tokens = list(_TOKEN.finditer(text, *m.span()))
            for k, t in enumerate(tokens):  # a token takes the separators after it, so that the digits join
                end = tokens[k + 1].start() if k + 1 < len(tokens) else t.end()
                digits = _SPELLED[t["name"].lower()] * _TIMES.get((t["many"] or "").lower(), 1) if t["name"] else "+" if t["plus"] else "."
                edits.append((t.start(), end, digits))
        elif m.lastgroup == "bare":
            edits += [(*b.span(), "@" if b[0].strip().lower() in ("at", "arroba") else ".") for b in _BARE_SIGN.finditer(text, *m.span())]
        else:
            edits.append((*m.span(), "@" if m.lastgroup == "at" else "."))
    return edits


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows, in places of the source."""
    odd = not text.isascii() and _ODD.search(text)
    if not odd and not _HINT.search(text):
        return []
    out = Rewritten(text)
    if odd:
        out = out.through(_character_edits(out.text))
    out = out.through(_word_edits(out.text))
    found = []
    for kind, start, end in detect(out.text):
        if any(out.new[start:end]):
            s, e = out.span(start, end)
            if not any(k == kind and b <= s and e <= f for k, b, f in base):
                found.append((kind, s, e))
    return found


#: Necessary conditions of the detectors and of the rewriting, for a fast test of whole batches. Letters between U+00C0 and U+024F mostly stand for themselves.
_LATIN = "".join(c for c in _PLAIN if "\u00c0" <= c <= "\u024f")
_MAYBE = (r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){12}", r"\+[0-9]", rf"[\x{{80}}-\x{{BF}}{_LATIN}]|[^\x{{00}}-\x{{24F}}]", f"(?i)(?:{_HINT.pattern})")


def worth_scanning(texts: pa.Array) -> np.ndarray:
    """Rows that may hold a span; the others cannot."""
    out = np.zeros(len(texts), bool)
    for pattern in _MAYBE:
        out |= pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)
    return out


SPANS = "array<struct<kind:string,start:int,end:int,disguised:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())]))


def spans_of(text: str | None) -> list[dict]:
    base = detect(text or "")
    rows = [(k, s, e, False) for k, s, e in base] + [(k, s, e, True) for k, s, e in (disguised(text, base) if text else [])]
    rows.sort(key=lambda r: (KINDS.index(r[0]), r[1], r[2]))
    return [dict(zip(("kind", "start", "end", "disguised"), r, strict=True)) for r in rows]


def find(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add ``out``: spans (kind, start, end, disguised) by kind as listed, then start; code points, end exclusive."""

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        parts = []
        for batch in slices([pa.record_batch([texts], names=["t"])], "t"):
            found = np.empty(batch.num_rows, object)
            found[:] = [[]] * batch.num_rows
            rows = np.flatnonzero(worth_scanning(batch.column("t")))
            for row, text in zip(rows.tolist(), batch.column("t").take(pa.array(rows)).to_pylist(), strict=True):
                found[row] = spans_of(text)
            parts.append(pa.array(found.tolist(), _SPANS))
        return pa.concat_arrays(parts) if parts else pa.array([], _SPANS)

    return df.withColumn(out, scan(F.col(text)))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

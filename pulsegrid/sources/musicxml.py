"""Score files (partwise XML, plain or zipped) decoded into element, measure and layout tables.

Decoding is one task per file: the reader lists every measure child in document order, because the time cursor depends on how notes,
backups and forwards interleave.  All musical meaning is worked out afterwards on the tables.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.session import ship, write_table

ELEMENT_SCHEMA = (
    "score_id string, part_ord int, part_id string, measure_index int, doc_order int, tag string, duration_div bigint, is_chord boolean, "
    "is_grace boolean, is_rest boolean, voice string, staff string, step string, alter int, octave string, unpitched boolean, "
    "tie_types array<string>, tuplet_actual int, tuplet_normal int, default_x double, default_y double"
)
MEASURE_SCHEMA = (
    "score_id string, part_ord int, part_id string, measure_index int, number string, implicit boolean, divisions int, beats int, beat_type int, "
    "time_symbol string, staves int, width double, new_page boolean, new_system boolean, has_print boolean, system_left double, system_distance double, "
    "top_system_distance double, right_bar_style string, right_bar_repeat boolean"
)
LAYOUT_SCHEMA = (
    "score_id string, page_width double, page_height double, left_margin double, right_margin double, top_margin double, bottom_margin double, "
    "system_left double, top_system_distance double, system_distance double, staff_distance double"
)
DECODED_SCHEMA = f"score_id string, error string, elements array<struct<{{e}}>>, measures array<struct<{{m}}>>, layout struct<{{l}}>"

_CONTAINER = "META-INF/container.xml"


def _fields(schema: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.strip().split(" ", 1) for f in schema.split(", ")))


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _text(node: ElementTree.Element | None, path: str) -> str | None:
    found = None if node is None else node.find(path)
    return found.text.strip() if found is not None and found.text and found.text.strip() else None


def _whole(text: str | None) -> int | None:
    try:
        return None if text is None else int(text)
    except ValueError:
        return None


def _real(text: str | None) -> float | None:
    try:
        return None if text is None else float(text)
    except ValueError:
        return None


def score_document(path: str, content: bytes) -> ElementTree.Element:
    """Root of the score: the file itself, or the member a zipped container names (else its first score-like member)."""
    if path.lower().endswith(".mxl"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()
            member = None
            if _CONTAINER in names:
                try:
                    roots = [n for n in ElementTree.fromstring(archive.read(_CONTAINER)).iter() if _name(n) == "rootfile"]
                    member = roots[0].get("full-path") if roots else None
                except ElementTree.ParseError:
                    member = None
            if not member:
                plain = (n for n in names if n.lower().endswith((".xml", ".musicxml")) and not n.startswith("META-INF/"))
                member = next(plain, None)
            if member is None:
                raise ValueError("no score document in archive")
            content = archive.read(member)
    root = ElementTree.fromstring(content)
    if _name(root) != "score-partwise":
        raise ValueError("not a partwise score")
    if root.find("part") is None:
        raise ValueError("no parts")
    return root


def _layout_row(root: ElementTree.Element) -> dict:
    defaults = root.find("defaults")
    page = None if defaults is None else defaults.find("page-layout")
    margins = None if page is None else page.find("page-margins")
    system = None if defaults is None else defaults.find("system-layout")
    row = {f"page_{k}": _real(_text(page, f"page-{k}")) for k in ("width", "height")}
    row |= {f"{k}_margin": _real(_text(margins, f"{k}-margin")) for k in ("left", "right", "top", "bottom")}
    row["system_left"] = _real(_text(system, "system-margins/left-margin"))
    row["top_system_distance"] = _real(_text(system, "top-system-distance"))
    row["system_distance"] = _real(_text(system, "system-distance"))
    # A staff layout without a readable distance stands for the default one.
    stated = [] if defaults is None else [_real(_text(s, "staff-distance")) for s in defaults.findall("staff-layout")]
    positive = [80.0 if d is None else d for d in stated if d is None or d > 0]
    row["staff_distance"] = sum(positive) / len(positive) if positive else None
    return row


def _measure_row(part_ord: int, part_id: str, index: int, measure: ElementTree.Element) -> dict:
    attributes, printed = measure.find("attributes"), measure.find("print")
    time = None if attributes is None else attributes.find("time")
    right = [b for b in measure.findall("barline") if (b.get("location") or "right").strip().lower() == "right"]
    layout = None if printed is None else printed.find("system-layout")
    flag = lambda name: printed is not None and (printed.get(name) or "").lower() == "yes"
    return {
        "part_ord": part_ord, "part_id": part_id, "measure_index": index, "number": measure.get("number") or None,
        "implicit": (measure.get("implicit") or "").lower() == "yes", "divisions": _whole(_text(attributes, "divisions")),
        "beats": _whole(_text(time, "beats")), "beat_type": _whole(_text(time, "beat-type")), "time_symbol": None if time is None else time.get("symbol"),
        "staves": _whole(_text(attributes, "staves")), "width": _real(measure.get("width")), "new_page": flag("new-page"), "new_system": flag("new-system"),
        "has_print": printed is not None, "system_left": _real(_text(layout, "system-margins/left-margin")), "system_distance": _real(_text(layout, "system-distance")),
        "top_system_distance": _real(_text(layout, "top-system-distance")),
        "right_bar_style": _text(right[-1], "bar-style") if right else None, "right_bar_repeat": bool(right) and right[-1].find("repeat") is not None,
    }


def _element_row(part_ord: int, part_id: str, index: int, order: int, node: ElementTree.Element) -> dict:
    pitch, ratio = node.find("pitch"), node.find("time-modification")
    marks = [t.get("type") for path in ("tie", "notations/tied") for t in node.findall(path) if t.get("type")]
    return {
        "part_ord": part_ord, "part_id": part_id, "measure_index": index, "doc_order": order, "tag": _name(node), "duration_div": _whole(_text(node, "duration")) or 0,
        "is_chord": node.find("chord") is not None, "is_grace": node.find("grace") is not None, "is_rest": node.find("rest") is not None,
        "voice": _text(node, "voice"), "staff": _text(node, "staff"), "step": None if pitch is None else _text(pitch, "step") or "?",
        "alter": _whole(_text(pitch, "alter")), "octave": None if pitch is None else _text(pitch, "octave") or "?", "unpitched": node.find("unpitched") is not None,
        "tie_types": marks, "tuplet_actual": _whole(_text(ratio, "actual-notes")), "tuplet_normal": _whole(_text(ratio, "normal-notes")),
        "default_x": _real(node.get("default-x")), "default_y": _real(node.get("default-y")),
    }


def decode_score(path: str, content: bytes) -> dict:
    """All rows of one file, or its error."""
    try:
        root = score_document(path, content)
    except Exception as exc:  # a bad file becomes a report row, never a failed job
        return {"error": f"{type(exc).__name__}: {exc}", "elements": [], "measures": [], "layout": None}
    elements, measures = [], []
    for part_ord, part in enumerate(root.findall("part")):
        part_id = part.get("id") or "P?"
        for index, measure in enumerate(part.findall("measure")):
            measures.append(_measure_row(part_ord, part_id, index, measure))
            timed = (n for n in measure if _name(n) in ("note", "backup", "forward"))
            elements += [_element_row(part_ord, part_id, index, order, n) for order, n in enumerate(timed)]
    return {"error": None, "elements": elements, "measures": measures, "layout": _layout_row(root)}


def score_files(spark: SparkSession, path: str, *endings: str) -> DataFrame:
    """Files under a path with one of the endings in any case; no others are opened."""
    anycase = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in endings]
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(anycase)}}}").load(path)


def read_scores(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``elements``, ``measures``, ``layout`` and ``rejected`` of all score files under a path; the path is the score id.

    Every file is decoded once: the nested rows are written to the shared folder and the tables read from there.
    """
    files = score_files(spark, path, "mxl", "musicxml", "xml").select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # One output frame per file keeps a task's memory at the size of its largest file.
            for name, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([{"score_id": name, **decode_score(name, content)}])

    own = lambda schema: _fields(schema.split(", ", 1)[1])
    schema = DECODED_SCHEMA.format(e=own(ELEMENT_SCHEMA), m=own(MEASURE_SCHEMA), l=own(LAYOUT_SCHEMA))
    ship(spark)
    decoded = write_table(files.mapInPandas(decode, schema), "scores")
    good = decoded.filter("error IS NULL")
    return {
        "elements": good.select("score_id", F.explode("elements").alias("r")).select("score_id", "r.*"),
        "measures": good.select("score_id", F.explode("measures").alias("r")).select("score_id", "r.*"),
        "layout": good.select("score_id", "layout.*"),
        "rejected": decoded.filter("error IS NOT NULL").select("score_id", "error"),
    }


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Write decoded tables once, so that later jobs read columns instead of decoding files again."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: tuple[str, ...] = ("elements", "measures", "layout", "rejected")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}

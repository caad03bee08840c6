"""Recognised-notation projects and annotation archives (zipped XML) decoded into graph, slot and symbol tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.session import ship, write_table
from pulsegrid.sources.musicxml import score_files

from pulsegrid.functions.notation import SHEET_MEMBER_PATTERN, SHEET_PATTERN

KEY = "page_index int, system_index int"
OBJECT_FIELDS = f"{KEY}, obj_id string, tag string, shape string, staff int, x double, y double, w double, h double, p1x double, p1y double, p2x double, p2y double, tie boolean"
RELATION_FIELDS = f"{KEY}, rel_ord int, source string, target string, type string, side string"
STACK_FIELDS = f"{KEY}, stack_ord int, stack_id string, left int, right int"
SLOT_FIELDS = f"{KEY}, stack_ord int, slot_ord int, slot_id string, time_offset string, x_offset int, suspicious boolean"
CHORD_FIELDS = f"{KEY}, stack_ord int, part_ord int, chord_ord int, kind string, chord_id string"
ENTRY_FIELDS = f"{KEY}, stack_ord int, part_ord int, entry_ord int, slot_id string, chord_id string, status string"
PAGE_FIELDS = "page_index int, member string, interline double"
SYMBOL_FIELDS = "page_index int, symbol_id string, shape string, x double, y double, w double, h double, interline double"
ANNOTATION_FIELDS = "page_index int, annotation_member string, image_ref string, annotation_width double, annotation_height double"
MEMBER_FIELDS = "member_ord int, member string"

# Fixed value: interline used where a sheet states none.
DEFAULT_INTERLINE = 19.0

PROJECT_TABLES = {"objects": OBJECT_FIELDS, "relations": RELATION_FIELDS, "stacks": STACK_FIELDS, "slots": SLOT_FIELDS, "chords": CHORD_FIELDS, "entries": ENTRY_FIELDS, "sheets": PAGE_FIELDS}
ANNOTATION_TABLES = {"symbols": SYMBOL_FIELDS, "pages": ANNOTATION_FIELDS, "members": MEMBER_FIELDS}


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def _children(node: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in node if _name(c) == name]


def _real(text: object) -> float | None:
    try:
        return None if text is None else float(str(text))
    except ValueError:
        return None


def _whole(text: object) -> int | None:
    value = _real(text)
    return None if value is None else int(value)


def sheet_members(names: list[str]) -> list[str]:
    """Sheet documents of a project in sheet order."""
    number = lambda n: int(re.search(SHEET_PATTERN, n).group(1))
    return sorted((n for n in names if re.search(SHEET_MEMBER_PATTERN, n)), key=lambda n: (number(n), n.lower()))


def _box(node: ElementTree.Element) -> dict:
    found = _children(node, "bounds")
    sides = {k: _real(found[0].get(k)) if found else None for k in "xywh"}
    return sides if all(v is not None for v in sides.values()) else dict.fromkeys("xywh")


def _stem_ends(node: ElementTree.Element) -> dict:
    median = _children(node, "median")
    ends = [c for c in median[0] if _name(c) in ("p1", "p2")] if median else []
    out = dict.fromkeys(("p1x", "p1y", "p2x", "p2y"))
    if len(ends) >= 2:
        out = {f"p{i}{axis}": _real(e.get(axis)) for i, e in enumerate(ends[:2], 1) for axis in "xy"}
    return out


def _graph_rows(system: ElementTree.Element, key: dict, out: dict[str, list]) -> None:
    by_id = {e.get("id"): e for e in system.iter() if e.get("id") is not None}
    for obj_id, node in by_id.items():
        out["objects"].append({**key, "obj_id": obj_id, "tag": _name(node), "shape": node.get("shape"), "staff": _whole(node.get("staff")), **_box(node), **_stem_ends(node),
                               "tie": (node.get("tie") or "").lower() == "true"})
    relations = (e for e in system.iter() if _name(e) == "relation")
    for order, node in enumerate(relations):
        kinds = [c for c in node if _name(c)]
        side = next((c.get("side") for c in kinds if _name(c) == "slur-head"), None)
        out["relations"].append({**key, "rel_ord": order, "source": node.get("source") or "", "target": node.get("target") or "", "type": _name(kinds[0]) if kinds else "", "side": side})


def _stack_rows(system: ElementTree.Element, key: dict, out: dict[str, list]) -> None:
    parts = [_children(p, "measure") for p in _children(system, "part")]
    for order, stack in enumerate(_children(system, "stack")):
        at = {**key, "stack_ord": order}
        out["stacks"].append({**at, "stack_id": stack.get("id"), "left": _whole(stack.get("left")), "right": _whole(stack.get("right"))})
        slots = _children(stack, "slot") or [e for e in stack.iter() if _name(e) == "slot"]
        for n, slot in enumerate(slots):
            out["slots"].append({**at, "slot_ord": n, "slot_id": slot.get("id"), "time_offset": slot.get("time-offset"), "x_offset": _whole(slot.get("x-offset")),
                                 "suspicious": (slot.get("suspicious") or "").lower() in ("true", "1", "yes")})
        for part_ord, measures in enumerate(parts):
            if order < len(measures):
                _measure_rows(measures[order], {**at, "part_ord": part_ord}, out)


def _measure_rows(measure: ElementTree.Element, at: dict, out: dict[str, list]) -> None:
    for tag, kind in (("head-chords", "head"), ("rest-chords", "rest")):
        listed = _children(measure, tag)
        ids = (listed[0].text or "").split() if listed else []
        out["chords"] += [{**at, "chord_ord": n, "kind": kind, "chord_id": c} for n, c in enumerate(ids)]
    entries = [e for voice in _children(measure, "voice") for slots in _children(voice, "slots")[:1] for e in _children(slots, "entry")]
    for n, entry in enumerate(entries):
        key, value = _children(entry, "key"), _children(entry, "value")
        if key and value and (key[0].text or "").strip():
            out["entries"].append({**at, "entry_ord": n, "slot_id": key[0].text.strip(), "chord_id": value[0].get("chord"), "status": value[0].get("status") or ""})


def decode_project(content: bytes) -> dict[str, list]:
    """Rows of every sheet of a project; a page is a sheet in sheet order. An unreadable sheet refuses the project: later measures would be misnumbered."""
    out: dict[str, list] = {name: [] for name in PROJECT_TABLES}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for page, member in enumerate(sheet_members(archive.namelist())):
            try:
                root = ElementTree.fromstring(archive.read(member))
            except ElementTree.ParseError as exc:
                raise ValueError(f"sheet {page + 1} ({member}): {exc}") from exc
            lines = next((e for e in root.iter() if _name(e) == "interline"), None)
            stated = None if lines is None else _real(lines.get("main")) or _real(lines.get("min"))
            out["sheets"].append({"page_index": page, "member": member, "interline": stated or DEFAULT_INTERLINE})
            for index, system in enumerate(e for e in root.iter() if _name(e) == "system"):
                key = {"page_index": page, "system_index": index}
                _graph_rows(system, key, out)
                _stack_rows(system, key, out)
    return out


def decode_annotations(content: bytes) -> dict[str, list]:
    """Pages, noteheads and members of an annotation archive; members that are no annotation are skipped."""
    out: dict[str, list] = {name: [] for name in ANNOTATION_TABLES}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        out["members"] = [{"member_ord": n, "member": m} for n, m in enumerate(names)]
        for member in sorted((n for n in names if n.lower().endswith(".xml")), key=str.lower):
            try:
                root = ElementTree.fromstring(archive.read(member))
            except ElementTree.ParseError:
                continue
            first = lambda scope, name: next((e for e in scope.iter() if _name(e) == name), None)
            scope = first(root, "page")
            scope = root if scope is None else scope
            image, size = first(scope, "image"), first(scope, "size")
            ref = (image.text or "").strip() if image is not None else ""
            side = lambda node, *keys: next((v for v in (_real(node.get(k)) for k in keys) if v is not None), 0.0) if node is not None else 0.0
            symbols = []
            for node in (e for e in root.iter() if _name(e) == "symbol"):
                box = next(iter(_children(node, "bounds")), None)
                box = first(node, "bounds") if box is None else box
                if box is not None and "notehead" in (node.get("shape") or "").lower().replace("_", ""):
                    w, h = side(box, "w", "width"), side(box, "h", "height")
                    if w > 0 and h > 0:
                        symbols.append({"symbol_id": node.get("id") or "", "shape": node.get("shape"), "x": side(box, "x"), "y": side(box, "y"), "w": w, "h": h, "interline": side(node, "interline")})
            if ref or symbols:
                page = len(out["pages"])
                out["pages"].append({"page_index": page, "annotation_member": member, "image_ref": ref, "annotation_width": side(size, "w", "width"), "annotation_height": side(size, "h", "height")})
                out["symbols"] += [{"page_index": page, **s} for s in symbols]
    return out


def _read(spark: SparkSession, path: str, ending: str, tables: dict[str, str], decoder: Callable[[bytes], dict[str, list]]) -> dict[str, DataFrame]:
    files = score_files(spark, path, ending).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                try:
                    row = {"error": None, **decoder(content)}
                except Exception as exc:  # a bad file becomes a report row, never a failed job
                    row = {"error": f"{type(exc).__name__}: {exc}", **{t: [] for t in tables}}
                yield pd.DataFrame([{"score_id": name, **row}])

    as_fields = lambda fields: ", ".join(f.replace(" ", ":", 1) for f in fields.split(", "))
    schema = "score_id string, error string, " + ", ".join(f"{t} array<struct<{as_fields(f)}>>" for t, f in tables.items())
    ship(spark)
    decoded = write_table(files.mapInPandas(decode, schema), "projects")
    out = {t: decoded.filter("error IS NULL").select("score_id", F.explode(t).alias("r")).select("score_id", "r.*") for t in tables}
    return {**out, "rejected": decoded.filter("error IS NOT NULL").select("score_id", "error")}


def read_projects(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Graph and slot tables of all recognised-notation projects (.omr) under a path."""
    return _read(spark, path, "omr", PROJECT_TABLES, decode_project)


def read_annotations(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Page, symbol and member tables of all annotation archives (.zip) under a path."""
    return _read(spark, path, "zip", ANNOTATION_TABLES, decode_annotations)


def newest_exports(spark: SparkSession, path: str, endings: tuple[str, ...] = ("mxl", "musicxml", "xml")) -> DataFrame:
    """One file per folder: the first ending that occurs, the newest file among those; only metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    ending = F.lower(F.element_at(F.split("path", r"\."), -1))
    rank = F.array_position(F.array(*[F.lit(e) for e in endings]), ending)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    ranked = files.withColumns({"folder": folder, "_rank": rank}).filter("_rank > 0")
    best = F.min_by(F.struct("path", "modificationTime", "length"), F.struct("_rank", (-F.unix_micros("modificationTime")).alias("age"), "path"))
    return ranked.groupBy("folder").agg(best.alias("_b")).select("folder", "_b.*")


#: File names of each kind of result, best first.
RESULT_KINDS = {
    "export": (r"\.mxl$", r"\.musicxml$", r"\.xml$"),
    "project": (r"\.omr$",),
    "annotations": (r"annotations[^/]*\.zip$",),
}


def run_results(spark: SparkSession, path: str, marker: str = r"\.log$") -> DataFrame:
    """The file of each kind that a run left: best name pattern first, then the newest, then the least path.

    A run is a folder that holds a file matching ``marker``; whatever lies below belongs to its nearest run, files under no run to the folder ``path`` itself.  Runs
    are found by joining the prefixes of every file's folder with the run folders, so a tree of any shape is one pass over its listing; only metadata is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    files = files.withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
    runs = files.filter(F.col("path").rlike(f"(?i){marker}")).select(F.col("_folder").alias("_prefix")).distinct()
    kind, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, patterns in RESULT_KINDS.items():
        for i, pattern in enumerate(patterns):
            fits = F.col("path").rlike(f"(?i){pattern}")
            kind, rank = F.when(fits, name).otherwise(kind), F.when(fits, i).otherwise(rank)
    results = files.select("path", "modificationTime", "length", "_folder", kind.alias("kind"), rank.alias("_rank")).filter("kind IS NOT NULL")
    parts = F.split("_folder", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix")))
    opened = results.select("*", F.explode(prefixes).alias("_p")).select("*", F.col("_p.prefix").alias("_prefix"))
    met = opened.join(runs.withColumn("_run", F.col("_prefix")), "_prefix", "left")
    nearest = F.max(F.when(F.col("_run").isNotNull(), F.struct("_p.depth", "_run")))["_run"]
    placed = met.groupBy("path").agg(nearest.alias("run"), *[F.first(c).alias(c) for c in ("kind", "_rank", "modificationTime", "length")])
    best = F.min_by(F.struct("path", "modificationTime", "length"), F.struct("_rank", (-F.unix_micros("modificationTime")).alias("age"), "path"))
    return placed.withColumn("run", F.coalesce("run", F.lit(path.rstrip("/")))).groupBy("run", "kind").agg(best.alias("_b")).select("run", "kind", "_b.*")

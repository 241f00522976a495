"""Scripture formats (USFM, USX, USJ, OSIS) as verse and footnote units."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "source_id string, position long, kind string, book string, chapter int, verse string, text string"
NOTE = re.compile(r"\\f\s.*?\\f\*", re.S)
MARKER = re.compile(r"\\\+?[a-z]+\d*(?:\*|\s)?")
Unit = tuple[str, str, int, str, str]


def _clean(text: str) -> str:
    return " ".join(text.split())


def usfm(text: str) -> Iterator[Unit]:
    """Verses of \\id, \\c and \\v markers; footnotes come after their verse."""
    book, chapter = "", 0
    for part in re.split(r"(?=\\(?:id|c|v)\s)", text):
        if m := re.match(r"\\id\s+(\S+)", part):
            book = m[1]
        elif m := re.match(r"\\c\s+(\d+)", part):
            chapter = int(m[1])
        elif m := re.match(r"\\v\s+(\d+(?:-\d+)?)\s", part):
            body = part[m.end() :]
            yield "Verse", book, chapter, m[1], _clean(MARKER.sub("", NOTE.sub("", body)))
            for note in NOTE.findall(body):
                yield "Footnote", book, chapter, m[1], _clean(MARKER.sub("", re.sub(r"^\\f\s+\S+\s*", "", note)))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class _Verses:
    """Collects text between verse starts and ends of the XML and JSON forms."""

    def __init__(self):
        self.book, self.chapter, self.verse = "", 0, None
        self.text, self.notes, self.units = [], [], []

    def begin(self, verse: str):
        self.end()
        self.verse = verse

    def end(self):
        if self.verse is not None:
            self.units.append(("Verse", self.book, self.chapter, self.verse, _clean("".join(self.text))))
            self.units += [("Footnote", self.book, self.chapter, self.verse, n) for n in self.notes]
        self.verse, self.text, self.notes = None, [], []

    def add(self, text: str | None):
        if self.verse is not None and text:
            self.text.append(text)


def _walk_xml(node: ET.Element, v: _Verses) -> None:
    tag, a = _local(node.tag), node.attrib
    if tag == "note":
        v.notes.append(_clean("".join(node.itertext())))
    elif tag in ("book", "div") and (a.get("code") or a.get("type") == "book"):
        v.end()
        v.book = a.get("code") or a.get("osisID", "")
        for child in node if tag == "div" else ():
            _walk_xml(child, v)
    else:
        if tag == "chapter" and (n := a.get("number") or a.get("osisID", "").rpartition(".")[2]):
            v.end()
            v.chapter = int(n)
        elif tag == "verse":
            if a.get("eid") or a.get("eID"):
                v.end()
            elif n := a.get("number") or (a.get("osisID") or a.get("sID") or "").rpartition(".")[2]:
                v.begin(n)
        v.add(node.text)
        for child in node:
            _walk_xml(child, v)
        if tag == "verse" and node.text:  # a container, not a milestone
            v.end()
    v.add(node.tail)


def xml(text: str) -> Iterator[Unit]:
    """USX and OSIS, with verses as milestones or containers."""
    v = _Verses()
    _walk_xml(ET.fromstring(text), v)
    v.end()
    yield from v.units


def usj(text: str) -> Iterator[Unit]:
    v = _Verses()

    def words(node) -> str:
        return node if isinstance(node, str) else "".join(map(words, node.get("content", [])))

    def walk(node):
        if isinstance(node, str):
            v.add(node)
            return
        kind = node.get("type")
        if kind == "note":
            v.notes.append(_clean(words(node)))
            return
        if kind == "book":
            v.book = node.get("code", "")
        elif kind == "chapter":
            v.end()
            v.chapter = int(node["number"])
        elif kind == "verse":
            v.begin(node["number"])
        if kind != "book":
            for child in node.get("content", []):
                walk(child)

    walk(json.loads(text))
    v.end()
    yield from v.units


FORMATS = {"usfm": usfm, "usx": xml, "osis": xml, "usj": usj}


def parse(files: DataFrame) -> DataFrame:
    """Units of files (source_id, parser, text); a malformed file gives one unit of kind Fault."""

    def run(parts):
        for pdf in parts:
            rows = []
            for s, parser, text in zip(pdf["source_id"], pdf["parser"], pdf["text"]):
                try:
                    units = list(FORMATS[parser](text))
                except (ET.ParseError, ValueError, KeyError) as e:
                    units = [("Fault", "", 0, "", str(e))]
                rows += [(s, i, *u) for i, u in enumerate(units)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select(F.col("source_id").cast("string"), "parser", "text").filter(F.col("parser").isin(*FORMATS)).mapInPandas(run, SCHEMA)


def reference(text: Column) -> Column:
    """`Book C:V-C:V` as a struct; null where there is no chapter."""
    pattern = r"^\s*(.*?)\s+(\d+)(?::(\d+))?(?:-(?:(\d+):)?(\d+))?\s*$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    book = F.lower(F.regexp_replace(part(1), r"[.\s]+", " "))
    return F.when(text.rlike(pattern), F.struct(F.trim(book).alias("book"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("verse"), part(4).cast("int").alias("end_chapter"), part(5).cast("int").alias("end_verse")))


def looked_up(references: DataFrame, aliases: DataFrame, bounds: DataFrame) -> DataFrame:
    """References (ref_id, text) with their book's code and whether chapter and verse exist.

    aliases: alias, book; bounds: book, chapter, verses."""
    x = references.withColumn("r", reference(F.col("text"))).filter("r IS NOT NULL").select("ref_id", F.col("r.book").alias("alias"), "r.chapter", "r.verse")
    x = x.join(aliases.select(F.lower("alias").alias("alias"), "book"), "alias").join(bounds, ["book", "chapter"], "left")
    return x.select("ref_id", "book", "chapter", "verse", (F.col("verses").isNotNull() & F.coalesce(F.col("verse").between(F.lit(1), F.col("verses")), F.lit(True))).alias("exists"))

"""Markdown: headings, paragraphs, quotes, lists, code and links as units."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import heading_slug

HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
SCHEMA = "source_id string, position long, line long, kind string, level int, heading_path array<string>, slug string, text string, links array<string>"


def unique_slugs(rows: DataFrame, group: str, title: str, order: list[str]) -> DataFrame:
    """Adds `slug`: later equal slugs of a group end in -1, -2 and so on."""
    base = rows.withColumn("_slug", heading_slug(F.col(title)))
    n = F.row_number().over(Window.partitionBy(group, "_slug").orderBy(*order)) - 1
    return base.withColumn("_n", n).withColumn("slug", F.when(F.col("_n") > 0, F.concat_ws("-", "_slug", "_n")).otherwise(F.col("_slug"))).drop("_slug", "_n")


def blocks(text: str) -> list[tuple]:
    """(line, kind, level, heading path, slug, text, links) of one document."""
    out, path, seen, held, kind, start, fenced = [], [], {}, [], None, 0, False

    def flush():
        nonlocal held, kind
        if held:
            body = "\n".join(held) if kind == "code" else " ".join(x.strip() for x in held)
            out.append((start, kind, 0, [p[1] for p in path], path[-1][2] if path else None, body, [u for _, u in LINK.findall(body)]))
        held, kind = [], None

    for i, line in enumerate(text.splitlines(), 1):
        if line.lstrip().startswith("```"):
            if fenced:
                flush()
            else:
                flush()
                kind, start = "code", i
            fenced = not fenced
        elif fenced:
            held.append(line)
        elif m := HEADING.match(line):
            flush()
            level, title = len(m[1]), m[2]
            path = [p for p in path if p[0] < level]
            base = re.sub("[^a-z0-9]+", "-", title.lower()).strip("-") or "section"
            n = seen[base] = seen.get(base, -1) + 1
            slug = f"{base}-{n}" if n else base
            path.append((level, title, slug))
            out.append((i, "heading", level, [p[1] for p in path], slug, title, [u for _, u in LINK.findall(title)]))
        elif not line.strip():
            flush()
        else:
            now = "quote" if line.lstrip().startswith(">") else "list" if LIST.match(line) else kind if kind == "list" and line[:1].isspace() else "paragraph"
            if now != kind or now == "list" and LIST.match(line):
                flush()
                kind, start = now, i
            held.append(line.lstrip().lstrip(">") if now == "quote" else LIST.sub("", line) if now == "list" else line)
    flush()
    return out


def parse(files: DataFrame) -> DataFrame:
    """Units of Markdown files (source_id, text), in order, with the headings above each."""

    def run(parts):
        for pdf in parts:
            rows = [(s, k, *b) for s, t in zip(pdf["source_id"], pdf["text"]) for k, b in enumerate(blocks(t or ""))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.select(F.col("source_id").cast("string"), "text").mapInPandas(run, SCHEMA)


def with_block_hash(units: DataFrame) -> DataFrame:
    return units.withColumn("block_hash", F.sha2(F.concat_ws("\n", "kind", F.array_join("heading_path", "/"), "text"), 256))

"""Sources: files by extension, JSON flattening, canonical JSONL and packages, and writers of results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import ignored, stable_id
from quillspark.operators.ingest import paragraphs

#: Which parser reads a file of which extension.
PARSERS = {"jsonl": "canonical_jsonl", "json": "json", "md": "markdown", "markdown": "markdown", "txt": "plaintext", "text": "plaintext", "usfm": "usfm", "sfm": "usfm", "usx": "usx", "usj": "usj", "osis": "osis"}
#: Bytes of one canonical record; columns of result files.
RECORD_BYTES = 1 << 20
RESULT_COLUMNS = ["query_id", "rank", "chunk_id", "score", "source", "snippet"]

CANONICAL = T.StructType([
    T.StructField("source_profile", T.StringType()), T.StructField("work_id", T.StringType()), T.StructField("version_id", T.StringType()),
    T.StructField("components", T.ArrayType(T.StructType([T.StructField("level", T.StringType()), T.StructField("value", T.StringType()), T.StructField("ordinal", T.IntegerType())]))),
    T.StructField("display_citation", T.StringType()), T.StructField("text", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType()),
])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def parser_of(path: Column) -> Column:
    """Parser name for a path; null for an extension that none reads."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in PARSERS.items() for x in pair]), extension(path))


def discover(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """Files under root with size, parser and a hash of their bytes, without what the globs ignore."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    kept = files if not ignore else files.filter(~ignored(F.col("path"), ignore))
    return kept.select("path", F.col("length").alias("bytes"), parser_of(F.col("path")).alias("parser"), F.sha2("content", 256).alias("hash"), "content")


def read_plaintext(files: DataFrame) -> DataFrame:
    """Paragraph units of discovered files."""
    return paragraphs(files.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("text")))


def flat(value, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of each scalar that is neither null nor blank, as a.b[0]."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flat(v, f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flat(v, f"{path}[{i}]")]
    text = "" if value is None else json.dumps(value) if isinstance(value, (bool, float, int)) else str(value).strip()
    return [(path, text)] if text else []


def flattened_json(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, position, path and value of every scalar of a JSON column; malformed JSON gives no rows."""

    def run(parts):
        for pdf in parts:
            out = []
            for k, raw in zip(pdf[key], pdf[column]):
                try:
                    out += [(k, i, p, v) for i, (p, v) in enumerate(flat(json.loads(raw)))] if raw is not None else []
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=[key, "position", "path", "value"])

    return rows.select(key, column).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, position long, path string, value string")


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Units of canonical JSONL with generated ids, and what is wrong with a record, or null."""
    x = spark.read.schema(CANONICAL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    components = F.array_join(F.transform("components", lambda c: F.concat_ws("=", c["level"], c["value"])), "/")
    bad = (
        F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.octet_length("text") > RECORD_BYTES, "too_long")
        .when(F.coalesce(F.size("components"), F.lit(0)) < 1, "no_components").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no_text")
    )
    return x.select("source_profile", "work_id", "version_id", "components", "display_citation", "text", "metadata", stable_id("cjson", F.col("work_id"), F.col("version_id"), components, F.sha2("text", 256)).alias("unit_id"), bad.alias("fault"))


def package_faults(units: DataFrame, relations: DataFrame) -> DataFrame:
    """What is wrong with a canonical package: (unit_id, fault) for repeated ids, text hashes and relation ends."""
    twice = units.groupBy("unit_id").count().filter("count > 1").select("unit_id", F.lit("repeated_id").alias("fault"))
    hashes = units.filter(F.sha2("text", 256) != F.col("text_hash")).select("unit_id", F.lit("text_hash").alias("fault"))
    ends = relations.select(F.explode(F.array("from_unit_id", "to_unit_id")).alias("unit_id")).distinct().join(units.select("unit_id"), "unit_id", "left_anti").select("unit_id", F.lit("relation_end").alias("fault"))
    return twice.unionByName(hashes).unionByName(ends)


def write_results(rows: DataFrame, path: str, kind: str) -> None:
    """Results as csv, tsv, json, markdown or snippets, in order of query and rank."""
    x = rows.select(*[c for c in RESULT_COLUMNS if c in rows.columns]).orderBy("query_id", "rank")
    if kind in ("csv", "tsv"):
        x.write.option("header", "true").option("sep", "," if kind == "csv" else "\t").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    elif kind == "json":
        x.write.json(path)
    elif kind == "markdown":
        x.select(F.format_string("%s. **%s** (%s)\n   > %s", "rank", F.col("chunk_id").cast("string"), F.col("score").cast("string"), F.coalesce("snippet", F.lit(""))).alias("value")).write.text(path)
    elif kind == "snippets":
        x.select(F.concat_ws("\t", F.col("chunk_id").cast("string"), "snippet").alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown kind {kind}")

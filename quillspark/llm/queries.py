"""The queries op1 to op13 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import new_path, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.langid import fit, identify

    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs), with_spans=False)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.quality import fit_rules, judge

    docs = table(spark, sf_dir, "documents")
    out = judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source", "digest")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.warc import archive

    out = archive(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.repeats import PASSAGE, remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), words=PASSAGE)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85, bands=25, rows=5)


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.codes import compress

    return compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.bpe import decode, digests, encode

    return digests(decode(encode(table(spark, sf_dir, "documents"))))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.llm.runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quillspark.llm.codes import CODES_SQL
    from quillspark.llm.mixing import MIX_SQL
    from quillspark.llm.topk import TOP_K_SQL
    from quillspark.llm.warc import WARC_SQL

    return {"op5_warc": WARC_SQL.format(pages="pages"), "op7_topk": TOP_K_SQL.format(embeddings="embeddings"), "op11_codes": CODES_SQL.format(embeddings="embeddings"), "op3_mixing": f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL.format(documents='documents')})"}

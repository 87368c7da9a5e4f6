"""The pN_ queries over the tables of TESTDATA.md, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import glyphs, language, ocr, packing, quality, subjects, tokens, truncation

PROSE = ["text", "text_block", "content", "abstract"]


def _records(spark: SparkSession, base: str) -> DataFrame:
    """Prose blocks and documents as records of problem 1."""
    names = table(spark, base, "sources").select("source_id", "source_name").dropDuplicates(["source_id"])
    blocks = table(spark, base, "blocks").where(F.col("label").isin(PROSE)).join(names, "source_id", "left")
    lang = language.declared(F.col("lang")).alias("declared")
    b = blocks.select(
        F.lit("block").alias("rec_kind"), F.col("block_id").alias("rec_id"), F.col("source_name").alias("host"), lang,
        F.lit(None).cast("string").alias("suffix"), F.col("content").alias("text"),
    )
    d = table(spark, base, "documents").select(
        F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"), F.col("source").alias("host"), lang,
        language.suffix_of(F.transform("links", lambda x: x["url"])).alias("suffix"), "text",
    )
    return b.unionByName(d)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    records = _records(spark, base)
    return language.undeclared(records, language.fit(records))


def p1_stretches(spark: SparkSession, base: str) -> DataFrame:
    records = _records(spark, base)
    out = language.stretches(records, language.fit(records))
    return out.withColumn("confidence", F.round("confidence", 4)).dropDuplicates(["rec_kind", "rec_id", "seq"])


def _block_tables(spark: SparkSession, base: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, base, t) for t in ("blocks", "sources", "api_configs"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return truncation.deliveries(*_block_tables(spark, base), PROSE).where("cut").select("block_id").distinct()


def p2_sources(spark: SparkSession, base: str) -> DataFrame:
    return truncation.source_shares(truncation.cut_blocks(*_block_tables(spark, base), PROSE))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return glyphs.alike_pairs(table(spark, base, "blocks"))


def p3_classes(spark: SparkSession, base: str) -> DataFrame:
    return glyphs.alike_classes(table(spark, base, "blocks"))


def p3_canonical(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "blocks").select("block_id", "content")
    out = glyphs.with_canonical(rows, "content").select("block_id", "canonical", "mixed_tokens", "whole_tokens")
    return out.dropDuplicates(["block_id"])


def _page_texts(spark: SparkSession, base: str) -> DataFrame:
    """Prose blocks and page markdown as texts of problem 4; a redelivered one counts once."""
    b = table(spark, base, "blocks").where(F.col("label").isin(PROSE))
    r = table(spark, base, "parse_results")
    return b.select(F.lit("content").alias("field"), F.col("block_id").alias("rec_id"), "page_id", F.col("content").alias("text")).unionByName(
        r.select(F.lit("markdown").alias("field"), F.col("result_id").alias("rec_id"), "page_id", F.col("markdown").alias("text"))
    )


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return ocr.defects(_page_texts(spark, base), table(spark, base, "blocks"), table(spark, base, "pages_dim"))


def p4_text(spark: SparkSession, base: str) -> DataFrame:
    return ocr.repair(_page_texts(spark, base), table(spark, base, "blocks"), table(spark, base, "pages_dim"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return quality.misfits(table(spark, base, "blocks"), PROSE)


def p5_stats(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "blocks").select(F.lit("block").alias("rec_kind"), F.col("block_id").alias("rec_id"), F.col("content").alias("text"))
    d = table(spark, base, "documents").select(F.lit("document").alias("rec_kind"), F.col("doc_id").alias("rec_id"), "text")
    return quality.report(b.unionByName(d), ["rec_kind", "rec_id"], "text").dropDuplicates(["rec_kind", "rec_id"])


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode(table(spark, base, "documents"))


def p6_texts(spark: SparkSession, base: str) -> DataFrame:
    """The texts behind p6_ids: what SQL reads from the table."""
    return tokens.decode(p6_ids(spark, base))


def _filled(spark: SparkSession, base: str) -> DataFrame:
    kinds = table(spark, base, "containers")
    names = sorted(r["tokenizer"] for r in kinds.select("tokenizer").distinct().collect())  # a fixed list
    return packing.fill(packing.pieces(packing.sizes(table(spark, base, "documents"), names), kinds))


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    out = _filled(spark, base)
    return out.select("container_id", "bin", F.col("id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"))


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    return packing.report(_filled(spark, base))


def _subject_sentences(spark: SparkSession, base: str) -> DataFrame:
    names = [r["subject"] for r in table(spark, base, "subjects").select("subject").orderBy("subject").collect()]  # fixed
    lang = language.declared(F.col("lang"))
    return subjects.subject_sentences(table(spark, base, "documents"), table(spark, base, "subject_labels"), names, lang)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _subject_sentences(spark, base).where("n_sentences >= 2").select("doc_id", "subject")


def p8_composition(spark: SparkSession, base: str) -> DataFrame:
    docs = _subject_sentences(spark, base).where("n_sentences >= 2")
    return docs.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_stretches, p2_found, p2_sources, p3_found, p3_classes, p3_canonical, p4_found, p4_text, p5_found, p5_stats, p6_ids, p6_texts, p7_containers, p7_report, p8_found, p8_composition)}


def oracle_sql() -> dict[str, str]:
    return {"p6_texts": "SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents"}

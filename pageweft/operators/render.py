"""Markdown and results of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..sources import formats


def _markdown(order: str, ignored: list[str]) -> Column:
    c = F.col("content")
    piece = F.concat(c, F.when(c.endswith("\n"), "\n").otherwise("\n\n"))
    kept = ~F.coalesce(F.col("label").isin(ignored), F.lit(False)) & (F.coalesce(c, F.lit("")) != "")
    parts = F.array_sort(F.collect_list(F.when(kept, F.struct(F.col(order).alias("o"), piece.alias("t")))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), "")


def markdown(blocks: DataFrame, order: str = "pos", ignored: list[str] = L.MARKDOWN_IGNORED) -> DataFrame:
    """One text for each page: its blocks in ``order``, each ended by a line break and a blank line; ignored labels and
    empty contents are left out, and a page without any has an empty text."""
    return blocks.groupBy("page_id").agg(_markdown(order, ignored).alias("markdown"))


def block_json() -> Column:
    """A block as JSON: group_id only where it is set, ord always."""
    shared = [F.col("id"), F.col("ord").alias("order"), F.col("label"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("score"), F.col("content")]
    keep = {"ignoreNullFields": "false"}
    return F.when(F.col("group_id").isNull(), F.to_json(F.struct(*shared), keep)).otherwise(F.to_json(F.struct(*shared, F.col("group_id")), keep))


def _document_id() -> Column:
    """A random id of each run and page."""
    return F.uuid() if hasattr(F, "uuid") else F.expr("uuid()")


def stages(config) -> list[str]:
    return [s for s, on in (("doc_orientation", config.use_orientation), ("doc_unwarping", config.use_unwarping)) if on] + ["layout", "recognition"]


def _envelope(config) -> dict[str, Column]:
    version = F.lit(config.pipeline_version)
    meta = F.struct(F.lit(config.vl_model).alias("vl_model"), F.lit(config.layout_model).alias("layout_model"), F.lit(config.device).alias("device"), version.alias("pipeline_version"))
    return {"pipeline_version": version, "stages": F.array(*map(F.lit, stages(config))), "metadata": meta}


def results(blocks: DataFrame, pages: DataFrame, config) -> DataFrame:
    """One row for each page: document_id, source, stages, blocks in output order, markdown (null unless asked for), and
    metadata; status is 'ok' and error null. Pages run in batches, so that a page has no time of its own."""
    b = F.struct(
        F.col("out_pos"), F.col("id"), F.col("ord").alias("order"), "label", F.array("x1", "y1", "x2", "y2").alias("bbox"), "score", F.coalesce("content", F.lit("")).alias("content"), "group_id"
    )
    listed = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(b)).alias("blocks"), _markdown("out_pos", list(config.markdown_ignored)).alias("markdown"))
    out = pages.select("page_id", "filename", "width", "height").dropDuplicates(["page_id"]).join(listed, "page_id", "left")
    shared = _envelope(config)
    text = F.coalesce("markdown", F.lit("")) if config.include_markdown else F.lit(None).cast("string")
    return out.select(
        _document_id().alias("document_id"), "page_id", F.struct("filename", "width", "height", F.lit("rgb").alias("format")).alias("source"),
        shared["pipeline_version"].alias("pipeline_version"), shared["stages"].alias("stages"),
        F.coalesce("blocks", F.array().cast(listed.schema["blocks"].dataType)).alias("blocks"), text.alias("markdown"), shared["metadata"].alias("metadata"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
    )


def failures(pages: DataFrame, like: DataFrame, config) -> DataFrame:
    """A row of the schema of ``like`` for each page that couldn't be parsed (page_id, filename, width, height, status)."""
    shared = _envelope(config)
    return pages.select(
        _document_id().alias("document_id"), "page_id", F.struct("filename", "width", "height", F.lit("rgb").alias("format")).alias("source"),
        shared["pipeline_version"].alias("pipeline_version"), shared["stages"].alias("stages"), F.array().cast(like.schema["blocks"].dataType).alias("blocks"),
        F.lit(None).cast("string").alias("markdown"), shared["metadata"].alias("metadata"), "status", formats.error_text(formats.status_of(F.lit("image"))).alias("error"),
    )


def result_json() -> Column:
    """A result as JSON: a block's group_id only where it is set, every other field always."""
    keep = {"ignoreNullFields": "false"}
    block = lambda b: F.when(b["group_id"].isNull(), F.to_json(b.dropFields("out_pos", "group_id"), keep)).otherwise(F.to_json(b.dropFields("out_pos"), keep))
    listed = F.concat(F.lit("["), F.array_join(F.transform("blocks", block), ","), F.lit("]"))
    head = F.to_json(F.struct("document_id", "source", "pipeline_version", "stages"), keep)
    tail = F.to_json(F.struct("markdown", "metadata"), keep)
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"blocks":'), listed, F.lit(","), F.regexp_replace(tail, r"^\{", ""))

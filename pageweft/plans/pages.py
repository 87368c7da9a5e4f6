"""The page pipeline: clean-up, order, groups, recognition, Markdown, results. One shuffle on page_id serves the whole
clean-up; recognition is the only barrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions import labels as L
from ..operators import blocks as B
from ..operators import recognize, render
from ..operators import suppress as S
from ..sources import formats
from ..sources.tables import materialize


def clean_boxes(detections: DataFrame, pages: DataFrame, config: PipelineConfig) -> DataFrame:
    """Rows of labelled boxes after threshold, suppression, containment, unclipping and the overlap filter."""
    kept = S.first_delivery(detections.where(F.col("score") >= config.layout_threshold))
    arrays = S.page_boxes(kept, "score" if config.layout_nms else "id")
    size = pages.select("page_id", "width", "height").dropDuplicates(["page_id"])
    if config.layout_nms:
        arrays = S.applied(arrays, lambda b: S.nms(b, config.nms_threshold))
    arrays = S.applied(arrays, S.without_contained, S.renumbered)
    if config.layout_unclip_ratio != 1.0:
        sized = arrays.join(size, "page_id")
        arrays = S.applied(sized, lambda b: S.unclip(b, config.layout_unclip_ratio, F.col("width"), F.col("height"))).drop("width", "height")
    return S.rows(S.overlap_filter(arrays)).drop("pos")


def page_blocks(detections: DataFrame, pages: DataFrame, config: PipelineConfig) -> DataFrame:
    """Blocks in output order with crops and groups, of labelled detections."""
    boxes = B.with_fallback(clean_boxes(detections, pages, config), pages)
    cropped = B.cropped(B.reading_order(boxes), pages.na.fill(0, ["width", "height"]), config.crop_padding_ratio)
    non_merge = L.non_merge_labels(config.use_chart_recognition, config.use_seal_recognition, config.use_ocr_for_image_block)
    if config.merge_layout_blocks:
        return B.emitted(cropped, non_merge)
    return cropped.withColumns({"out_pos": F.col("pos"), "group_id": F.lit(None).cast("int"), "has_crop": F.lit(True)})


def parse_detections(detections: DataFrame, pages: DataFrame, label_dim: DataFrame, backend, config: PipelineConfig = PipelineConfig(), pixels: DataFrame | None = None) -> DataFrame:
    """One result for each page of ``pages`` from raw detections. ``backend`` makes the recogniser, which gets crops of
    ``pixels`` (page_id, height, width, rgb) where they are given."""
    # written once: recognition reads the gated blocks, and its answers join all of them
    blocks = materialize(page_blocks(L.named(detections, label_dim), pages, config), "blocks")
    return render.results(recognize.recognized(blocks, config, backend, pixels), pages, config)


def parse_pages(spark: SparkSession, path: str, label_dim: DataFrame, backend, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """One result for each image file under ``path``."""
    return parse_images(formats.images(spark, path), label_dim, backend, config)


def parse_images(pictures: DataFrame, label_dim: DataFrame, backend, config: PipelineConfig = PipelineConfig()) -> DataFrame:
    """One result for each picture; one that can't be read has the status 'invalid_image', a text of the error, no blocks
    and null markdown. Orientation, unwarping and layout run once for each picture: their outcome is written."""
    found = materialize(recognize.detected(pictures, config, backend), "pictures")
    pages = found.where("status = 'ok'").select("page_id", "filename", "width", "height")
    boxes = found.select("page_id", F.explode("found").alias("b")).select("page_id", "b.*")
    good = parse_detections(boxes, pages, label_dim, backend, config, found.where("rgb is not null"))
    bad = found.where("status <> 'ok'").select("page_id", "filename", "width", "height", "status")
    return good.unionByName(render.failures(bad, good, config))

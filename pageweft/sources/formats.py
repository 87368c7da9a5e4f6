"""Image files, formats, manifests, model settings, tensor listings and error states."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Endings in either case.
IMAGE_FILES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"


def images(spark: SparkSession, path: str) -> DataFrame:
    """page_id, filename, image of the JPEG and PNG files under ``path``; undecodable ones have height -1."""
    df = spark.read.format("image").option("pathGlobFilter", IMAGE_FILES).load(path)
    name = F.element_at(F.split("image.origin", "/"), -1)
    return df.select(F.xxhash64("image.origin").alias("page_id"), name.alias("filename"), "image")


def image_format(filename: Column, content: Column) -> Column:
    """'jpeg', 'png' or null: by the name's ending, else by the first bytes."""
    name, head = F.lower(filename), F.hex(F.substring(content, 1, 8))
    by_name = F.when(name.rlike(r"\.jpe?g$"), "jpeg").when(name.endswith(".png"), "png")
    return F.coalesce(by_name, F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E470D0A1A0A", "png"))


def admitted(uploads: DataFrame, max_mb: int) -> DataFrame:
    """``uploads`` (filename, content) with status (an HTTP code) and error; anything but 200 belongs in a dead-letter
    output."""
    size = F.coalesce(F.length("content"), F.lit(0))
    code = F.when(F.col("content").isNull(), 400).when(size > max_mb * 1024 * 1024, 413).when(image_format(F.col("filename"), F.col("content")).isNull(), 415).otherwise(200)
    return uploads.withColumn("status", code).withColumn("error", error_text(F.col("status")))


def error_text(status: Column) -> Column:
    return (
        F.when(status == 400, "missing, invalid or corrupt image data").when(status == 413, "upload too large").when(status == 415, "unsupported image format")
        .when(status == 503, "queue is full or worker unavailable; retry later").when(status >= 500, "internal error")
    )


def status_of(error: Column) -> Column:
    """HTTP status of an error kind."""
    return F.when(error.isNull(), 200).when(error.isin("image", "missing_file"), 400).when(error == "unsupported", 415).when(error.isin("queue_full", "worker_unavailable"), 503).otherwise(500)


def manifest(spark: SparkSession, rows: list[tuple[str, str, int | None]]) -> DataFrame:
    """kind, ord, path, size of required artifacts, in the order given; a null size accepts any."""
    return spark.createDataFrame([(k, i, p, n) for i, (k, p, n) in enumerate(rows)], "kind string, ord int, path string, size long")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder) and length of its files; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.select(F.regexp_replace("path", r"^.*?" + re.escape(folder.strip("/")) + "/", "").alias("path"), "length")


def json_object(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The JSON object in the file ``name`` of a folder as one row, however it is laid out."""
    return spark.read.option("multiLine", "true").json(f"{folder.rstrip('/')}/{name}")


def missing(required: DataFrame, listing: DataFrame) -> DataFrame:
    """Required artifacts (kind, ord, path, size) without a file (path, length) in the listing, in order."""
    return required.join(listing.select("path").distinct(), "path", "left_anti")


def first_missing(required: DataFrame, listing: DataFrame) -> DataFrame:
    m = missing(required, listing)
    return m.agg(F.min_by(F.struct("kind", "path"), "ord").alias("m")).select("m.kind", "m.path")


def skippable(required: DataFrame, listing: DataFrame) -> DataFrame:
    """path, skip: whether a file is there already, with the size that the manifest expects, if it expects one."""
    have = listing.groupBy("path").agg(F.max("length").alias("length"))
    joined = required.join(have, "path", "left")
    return joined.select("path", F.coalesce((F.col("length") == F.col("size")) | (F.col("length").isNotNull() & F.col("size").isNull()), F.lit(False)).alias("skip"))


def tensor_names(files: DataFrame) -> DataFrame:
    """path, name: sorted names in the headers of tensor files (path, content): a little-endian length, then JSON."""
    length = F.conv(F.concat(*[F.hex(F.substring("content", i, 1)) for i in range(8, 0, -1)]), 16, 10).cast("int")
    header = F.substring(F.col("content"), F.lit(9), length).cast("string")
    names = F.map_keys(F.from_json(header, "map<string,string>"))
    return files.select("path", F.explode(F.array_sort(F.filter(names, lambda n: n != "__metadata__"))).alias("name"))


def settings(text: Column, defaults: dict[str, tuple[str, object]]) -> Column:
    """A JSON object's fields by name (type, default); missing or null ones take the default."""
    parsed = F.from_json(text, ", ".join(f"{k} {t}" for k, (t, _) in defaults.items()))
    return F.struct(*[F.coalesce(parsed[k], F.lit(d).cast(t)).alias(k) for k, (t, d) in defaults.items()])


def dtype(name: Column, on_cpu: bool = True) -> Column:
    kind = F.when(name.isin("bfloat16", "bf16"), "bf16").when(name.isin("float16", "f16"), "f16").when(name.isin("float32", "f32"), "f32")
    return F.when(kind.isNotNull(), F.lit("f32")) if on_cpu else kind


def health() -> dict[str, object]:
    return {"status": "ok", "models_loaded": True}

"""Models behind one small interface, and the steps that call them. One backend is loaded by each Python worker, when the
first batch arrives. A stub stands in where only the steps around the models matter; it recognises nothing."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import images
from ..functions import labels as L
from . import blocks as B


class ModelBackend(Protocol):
    def orientation(self, image: np.ndarray) -> tuple[int, float]: ...
    def flow(self, image: np.ndarray) -> np.ndarray: ...
    def layout(self, image: np.ndarray) -> list[tuple[int, float, float, float, float, float, int | None]]: ...
    def recognize(self, crops: list[np.ndarray | None], keys: list[str], prompts: list[str], max_tokens: int) -> list[str]: ...


class StubBackend:
    """No recognition: upright, flat pages, one text box a page, and a text that names the prompt and the block."""

    def orientation(self, image: np.ndarray) -> tuple[int, float]:
        return 0, 1.0

    def flow(self, image: np.ndarray) -> np.ndarray:
        y, x = np.meshgrid(np.linspace(-1, 1, 9), np.linspace(-1, 1, 9), indexing="ij")
        return np.stack([x, y])

    def layout(self, image: np.ndarray):
        h, w = image.shape[:2]
        return [(22, 0.9, 0.0, 0.0, float(w), float(h), 0)]

    def recognize(self, crops: list[np.ndarray | None], keys: list[str], prompts: list[str], max_tokens: int) -> list[str]:
        return [" ".join(f"{p} {k}".split()[:max_tokens]) for k, p in zip(keys, prompts)]


_LOADED: dict[bytes, ModelBackend] = {}


def loaded(make: bytes) -> ModelBackend:
    """The worker's backend, made on first use. It is kept by the pickled factory, so that two factories never share one."""
    if make not in _LOADED:
        _LOADED[make] = cloudpickle.loads(make)()
    return _LOADED[make]


def asked(blocks: DataFrame, config) -> DataFrame:
    """page_id, asked: what of each page is to be recognised, an array of pos, prompt, canvas_w and parts (rectangles of
    the page and their offset on the canvas). A group is one canvas with its blocks' crops below each other. Blocks that
    the gate keeps from recognition, or that have no crop, aren't listed."""
    gate = L.gate(F.col("label"), config.use_chart_recognition, config.use_seal_recognition, config.use_ocr_for_image_block)
    rows = blocks
    if "link" in blocks.columns:
        at = B.stacked(blocks.where("group_id is not null")).select("page_id", "pos", "x_off", "canvas_w")
        rows = blocks.join(at, ["page_id", "pos"], "left")
    else:
        rows = blocks.withColumns({"x_off": F.lit(0), "canvas_w": F.lit(None).cast("int")})
    own = gate & F.col("has_crop")
    part = F.struct("pos", F.coalesce("x_off", F.lit(0)).alias("x_off"), "crop_x", "crop_y", "crop_w", "crop_h")
    units = rows.groupBy("page_id", F.coalesce("group_id", "pos").alias("head")).agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.max(F.coalesce("canvas_w", "crop_w")).alias("canvas_w"), F.max(F.when(own, L.prompt(F.col("label")))).alias("prompt")
    )
    units = units.where("prompt is not null").select("page_id", F.struct(F.col("head").cast("int").alias("pos"), "prompt", F.col("canvas_w").cast("int").alias("canvas_w"), "parts").alias("u"))
    return units.groupBy("page_id").agg(F.array_sort(F.collect_list("u")).alias("asked"))


def recognized(blocks: DataFrame, config, make: Callable[[], ModelBackend], pixels: DataFrame | None = None) -> DataFrame:
    """``blocks`` with content: gated blocks with a crop go to the backend, the others stay empty. Only pages with such
    blocks reach Python. With ``pixels`` (page_id, height, width, rgb) the backend gets each crop, of a group the stacked
    ones; without, None."""
    limit, code = config.max_tokens, cloudpickle.dumps(make)

    def run(batches):
        import pyarrow as pa

        backend = loaded(code)
        for b in batches:
            ids, pos, said = [], [], []
            for i in range(b.num_rows):  # a page at a time: its pixels are the largest thing here
                row = {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}
                page = np.frombuffer(row["rgb"], np.uint8).reshape(row["height"], row["width"], 3) if row.get("rgb") is not None else None
                units = row["asked"]
                crops = [None if page is None else _canvas(page, u) for u in units]
                text = backend.recognize(crops, [f"{row['page_id']}-{u['pos']}" for u in units], [u["prompt"] for u in units], limit)
                ids += [row["page_id"]] * len(units)
                pos += [u["pos"] for u in units]
                said += [t.strip() for t in text]
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(said, pa.string())], names=["page_id", "pos", "content"])

    rows = asked(blocks, config).withColumn("page_id", F.col("page_id").cast("long"))
    if pixels is not None:
        rows = rows.join(pixels.select("page_id", "height", "width", "rgb"), "page_id")
    text = rows.mapInArrow(run, "page_id long, pos int, content string")
    return blocks.drop("content").join(text, ["page_id", "pos"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def _canvas(page: np.ndarray, unit: dict) -> np.ndarray:
    crops = [images.crop(page, p["crop_x"], p["crop_y"], p["crop_w"], p["crop_h"]) for p in unit["parts"]]
    return crops[0] if len(crops) == 1 else images.stack(crops, [p["x_off"] for p in unit["parts"]], unit["canvas_w"])


def _pixels(row) -> np.ndarray:
    """An image-source row (BGR or grey bytes) as RGB."""
    img = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return np.repeat(img, 3, 2) if row["nChannels"] == 1 else img[..., 2::-1]


def detected(pictures: DataFrame, config, make: Callable[[], ModelBackend]) -> DataFrame:
    """page_id, filename, width, height, status, found (boxes in the model's order, numbered) and rgb (pixels) of each
    picture (page_id, filename, image of the image source): turned upright and flattened as configured, then laid out. A
    picture that can't be decoded has the status 'invalid_image' and neither boxes nor pixels."""
    code = cloudpickle.dumps(make)

    def run(batches):
        import pyarrow as pa

        backend = loaded(code)
        for b in batches:
            for i in range(b.num_rows):
                page, name, im = (c[0].as_py() for c in b.slice(i, 1).columns)
                row = (page, name, None, None, "invalid_image", [], None)
                if im is not None and im["height"] > 0:
                    img = _pixels(im)
                    if config.use_orientation:
                        img = images.rotate(img, backend.orientation(img)[0])
                    if config.use_unwarping:
                        planes = img[..., ::-1].transpose(2, 0, 1) / 255.0
                        img = images.to_bytes(images.rectify(planes, backend.flow(img)) + 1e-6)
                    order = sorted(backend.layout(img), key=lambda x: (x[6] is None, x[6]))
                    boxes = [dict(zip(("label_id", "score", "x1", "y1", "x2", "y2", "ord"), x), id=k) for k, x in enumerate(order)]
                    row = (page, name, img.shape[1], img.shape[0], "ok", boxes, np.ascontiguousarray(img).tobytes())
                yield pa.RecordBatch.from_pylist([dict(zip(("page_id", "filename", "width", "height", "status", "found", "rgb"), row))], schema=schema)

    import pyarrow as pa

    box = pa.struct([("id", pa.int32()), ("label_id", pa.int32()), ("score", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("x2", pa.float64()), ("y2", pa.float64()), ("ord", pa.int32())])
    schema = pa.schema([("page_id", pa.int64()), ("filename", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("status", pa.string()), ("found", pa.list_(box)), ("rgb", pa.binary())])
    ddl = "page_id long, filename string, width int, height int, status string, found array<struct<id:int,label_id:int,score:double,x1:double,y1:double,x2:double,y2:double,ord:int>>, rgb binary"
    return pictures.select(F.col("page_id").cast("long").alias("page_id"), "filename", "image").mapInArrow(run, ddl)

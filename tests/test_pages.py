import os
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageweft.config import PipelineConfig, device, env_file, from_env
from pageweft.functions import images as I
from pageweft.functions import labels as L
from pageweft.operators import blocks as B
from pageweft.operators import recognize, render
from pageweft.operators import suppress as S
from pageweft.plans import pages as plan
from pageweft.sources import formats, tables
from pageweft.streaming import pages as stream

SCHEMA = "page_id long, id int, ord int, label string, score double, x1 double, y1 double, x2 double, y2 double"


def _df(spark, pages):
    rows = [(p, i, b[6] if len(b) > 6 else i, b[0], b[1], *map(float, b[2:6])) for p, boxes in enumerate(pages) for i, b in enumerate(boxes)]
    return spark.createDataFrame(rows, SCHEMA)


def _iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    cut = max(w, 0) * max(h, 0)
    total = sum((x[4] - x[2]) * (x[5] - x[3]) for x in (a, b)) - cut
    return cut / total if total > 0 else 0


def _visits(boxes, threshold):
    left, out = sorted(boxes, key=lambda b: -b[1]), []
    while left:
        head, last = left[0], left.pop()
        if left:
            left[0] = last
        left = [b for b in left if _iou(head, b) < threshold]
        out.append(head)
    return out


def test_suppression_order(spark):
    hand = [
        [("text", 0.9, 0, 0, 10, 10), ("text", 0.5, 1, 1, 11, 11), ("text", 0.8, 50, 50, 60, 60)],
        [("text", 0.9, 100, 100, 110, 110), ("text", 0.8, 0, 0, 10, 10), ("text", 0.5, 1, 1, 10, 10)],
    ]
    r = random.Random(1)
    for _ in range(60):
        page = []
        for _ in range(r.randint(1, 12)):
            x, y = r.randint(0, 40), r.randint(0, 40)
            page.append(("text", r.random(), x, y, x + r.randint(5, 30), y + r.randint(5, 30)))
        hand.append(page)
    got = {}
    for x in S.rows(S.applied(S.page_boxes(_df(spark, hand), "score"), lambda b: S.nms(b, 0.5))).collect():
        got.setdefault(x.page_id, []).append((x.pos, x.id, x.score))
    for p, page in enumerate(hand):
        assert [v[2] for v in sorted(got[p])] == [b[1] for b in _visits(page, 0.5)]
        assert [v[1] for v in sorted(got[p])] == list(range(len(got[p])))
    assert {v[2] for v in got[1]} == {0.9, 0.5}  # a weak box takes a stronger one with it


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ([("text", 1.0, 0, 0, 5, 5)], set()),
        ([("reference", 1.0, 0, 0, 50, 50), ("text", 1.0, 10, 10, 40, 40)], {1}),
        ([("text", 1.0, 0, 0, 100, 100), ("inline_formula", 1.0, 10, 10, 90, 90)], {0}),
        ([("image", 1.0, 0, 0, 100, 100), ("table", 1.0, 10, 10, 90, 90)], {0, 1}),
        ([("text", 1.0, 0, 0, 100, 100), ("text", 1.0, 10, 10, 30, 30)], {0}),
        ([("inline_formula", 1.0, 0, 0, 50, 50), ("inline_formula", 1.0, 1, 1, 50, 50)], set()),
        ([(None, 1.0, 0, 0, 50, 50), (None, 1.0, 1, 1, 50, 50)], {0}),
    ],
)
def test_overlap(spark, page, kept):
    assert {x.id for x in S.rows(S.overlap_filter(S.page_boxes(_df(spark, [page])))).collect()} == kept


def test_containment(spark):
    pages = [[("text", 1.0, 10, 10, 20, 20), ("formula", 1.0, 0, 0, 100, 100)], [("text", 1.0, 0, 0, 10, 10), ("table", 1.0, 1, 1, 9, 9)], [("formula", 1.0, 2, 2, 9, 9), ("chart", 1.0, 0, 0, 10, 10)]]
    want = {(0, 1), (1, 0), (1, 1), (2, 0), (2, 1)}
    df = _df(spark, pages)
    assert {(x.page_id, x.id) for x in S.contained_rows(df).collect()} == want
    assert {(x.page_id, x.id) for x in S.rows(S.applied(S.page_boxes(df), S.without_contained)).collect()} == want
    both = _df(spark, [[("text", 1.0, 0, 0, 100, 100), ("text", 1.0, 10, 10, 20, 20)]])
    assert [x.id for x in S.contained_by_mode(both, lambda c: F.lit("large")).collect()] == [0]
    assert [x.id for x in S.contained_by_mode(both, lambda c: F.lit("small")).collect()] == [1]
    assert S.contained_by_mode(both, lambda c: F.lit("union")).count() == 2


def test_tall_group_is_given_up_and_spans_move_others_behind(spark):
    rows = [(1, i, i, i, "text", 0.0, 10.0 * i, 50.0 - 10 * i, 10.0 * i + 9, 50, 9, "a") for i in range(2)]
    rows.append((1, 2, 2, 2, "image", 20.0, 5.0, 30.0, 30.0, 10, 25, ""))
    df = spark.createDataFrame(rows, "page_id long, pos int, id int, ord int, label string, x1 double, y1 double, x2 double, y2 double, crop_w int, crop_h int, content string")
    out = {r.pos: r for r in B.emitted(df, L.non_merge_labels()).collect()}
    assert out[0].group_id == 0 and out[1].group_id == 0 and out[0].has_crop and not out[1].has_crop and out[2].group_id is None
    tall = B.emitted(df.withColumn("crop_h", F.lit(200)), L.non_merge_labels()).collect()
    assert all(r.group_id is None for r in tall)


def test_markdown_and_fallback(spark):
    rows = [(1, 0, "text", "hello"), (1, 1, "number", "99"), (1, 2, "text", "world\n"), (1, 3, "text", None), (2, 0, "header", "x")]
    md = {r.page_id: r.markdown for r in render.markdown(spark.createDataFrame(rows, "page_id long, pos int, label string, content string")).collect()}
    assert md == {1: "hello\n\nworld\n\n", 2: ""}
    pages = spark.createDataFrame([(0, "a", 10, 20), (7, None, None, None), (7, None, None, None)], "page_id long, filename string, width int, height int")
    out = {r.page_id: r for r in B.with_fallback(_df(spark, [[("text", 1.0, 0, 0, 5, 5)]]), pages).collect()}
    assert out[7].label == "text" and out[7].x2 == 0.0 and out[0].x2 == 5.0 and len(out) == 2


def test_empty_tables_and_extra_columns(spark):
    pages = spark.createDataFrame([(0, "a", 10, 20)], "page_id long, filename string, width int, height int")
    dim = spark.createDataFrame([(22, "text")], "label_id int, label string")
    det = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, 8.0, 8.0, None, None, 5)], "page_id long, id int, score double, x1 double, y1 double, x2 double, y2 double, label_id int, ord int, width int")
    got = plan.parse_detections(det.unionByName(det), pages, dim, recognize.StubBackend).collect()
    assert len(got) == 1 and got[0].blocks[0].label == "unknown" and got[0].markdown.startswith("OCR:")
    bare = plan.parse_detections(det.limit(0), pages, dim, recognize.StubBackend).collect()
    assert bare[0].blocks[0].bbox == [0.0, 0.0, 10.0, 20.0]
    assert plan.parse_detections(det, pages.limit(0), dim, recognize.StubBackend).count() == 0


def _png(path, img):
    raw = b"".join(b"\0" + row.tobytes() for row in img)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def _sizes(calls):
    class Sizes:
        """Two text boxes that continue each other in the next column; tells of each crop its size and mean."""

        def _called(self, what):
            with open(f"{calls}/{what}", "a") as f:
                f.write("x")

        def orientation(self, image):
            self._called("orientation")
            return 0, 1.0

        def flow(self, image):
            y, x = np.meshgrid(np.linspace(-1, 1, 5), np.linspace(-1, 1, 5), indexing="ij")
            return np.stack([x, y])

        def layout(self, image):
            self._called("layout")
            return [(22, 0.9, 16.0, 0.0, 26.0, 12.0, 1), (22, 0.8, 0.0, 0.0, 14.0, 20.0, 0)]

        def recognize(self, crops, keys, prompts, max_tokens):
            return [f"{c.shape[1]}x{c.shape[0]} {c.mean():.1f}" for c in crops]

    return Sizes


def test_images_in_batch_and_stream(spark, tmp_path):
    folder, calls = tmp_path / "in", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    for i in range(6):
        _png(folder / f"{i}.PNG", np.full((40, 30, 3), 20 * i, np.uint8))
    (folder / "broken.png").write_bytes(b"no image")
    dim = spark.createDataFrame([(22, "text")], "label_id int, label string")
    rows = {r.source.filename: r for r in plan.parse_pages(spark, str(folder), dim, _sizes(str(calls))).collect()}
    assert len(rows) == 7 and rows["broken.png"].status == "invalid_image" and rows["broken.png"].blocks == [] and rows["broken.png"].error
    assert {(calls / n).read_text() for n in ("orientation", "layout")} == {"x" * 6}
    for i in range(6):
        r = rows[f"{i}.PNG"]
        # the group is one canvas: as wide as its widest crop, as tall as both, white where the narrow one ends
        mean = (20 * i * (14 * 20 + 10 * 12) + 255 * 4 * 12) / (14 * 32)
        assert (r.source.width, r.source.height, r.status) == (30, 40, "ok") and [b.content for b in r.blocks] == [f"14x32 {mean:.1f}", ""]
        assert [b.group_id for b in r.blocks] == [0, 0] and r.metadata.device == "cpu" and len(r.document_id) == 36
    bare = plan.parse_pages(spark, str(folder), dim, _sizes(str(calls)), PipelineConfig(merge_layout_blocks=False, include_markdown=False)).where("status = 'ok'").collect()
    assert {tuple(b.content.split()[0] for b in r.blocks) for r in bare} == {("14x20", "10x12")} and all(r.markdown is None for r in bare)
    q = stream.parse_stream(spark, str(folder), dim, str(tmp_path / "out"), str(tmp_path / "check"), recognize.StubBackend)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_backends_of_one_name_do_not_share_a_model():
    from pyspark import cloudpickle

    made = [cloudpickle.dumps(lambda n=n: [n]) for n in (1, 2)]
    assert [recognize.loaded(m) for m in made] == [[1], [2]] and recognize.loaded(made[0]) is recognize.loaded(made[0])


def _overlap_brute(page):
    page = [(i, b) for i, b in enumerate(page) if b[0] != "reference"]
    area = lambda b: max(b[4] - b[2], 0) * max(b[5] - b[3], 0)
    gone = set()
    for n, (i, a) in enumerate(page):
        if a[4] - a[2] < 6 or a[5] - a[3] < 6:
            gone.add(i)
        for j, b in page[n + 1 :]:
            if i in gone or j in gone or min(area(a), area(b)) <= 0:
                continue
            cut = max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0) / min(area(a), area(b))
            if "inline_formula" in (a[0], b[0]):
                if cut > 0.5:
                    gone |= {k for k, x in ((i, a), (j, b)) if x[0] == "inline_formula"}
            elif cut > 0.7 and not (a[0] != b[0] and {a[0], b[0]} <= set(L.OVERLAP_EXEMPT)):
                gone.add(j if area(a) >= area(b) else i)
    return {i for i, _ in page} - gone


def test_overlap_on_full_pages(spark):
    r = random.Random(8)
    pages = []
    for _ in range(4):
        page = []
        for _ in range(300):
            x, y = r.randint(0, 400), r.randint(0, 400)
            page.append((r.choice(["text", "table", "image", "inline_formula", "reference", "chart"]), 1.0, x, y, x + r.randint(3, 60), y + r.randint(3, 60)))
        pages.append(page)
    got = {p: set() for p in range(4)}
    began = time.time()
    for x in S.rows(S.overlap_filter(S.page_boxes(_df(spark, pages)))).collect():
        got[x.page_id].add(x.id)
    took = time.time() - began
    assert [got[p] for p in range(4)] == [_overlap_brute(p) for p in pages]
    assert took < 20


def test_kernels():
    img = np.arange(24, dtype=np.uint8).reshape(4, 2, 3)
    assert I.rotate(img, 90).shape == (2, 4, 3) and (I.rotate(I.rotate(img, 90), 270) == img).all() and I.rotate(img, 45) is img
    assert I.reflect_pad(np.arange(12.0).reshape(1, 3, 4), 2, 2)[0, 0, 0] == 10
    flat = np.full((5, 7, 3), 9, np.uint8)
    assert all((I.resize(flat, 11, 3, n) == 9).all() for n in I.FILTERS)
    p = np.random.default_rng(0).random((2, 5, 6))
    y, x = np.meshgrid(np.linspace(-1, 1, 5), np.linspace(-1, 1, 6), indexing="ij")
    assert np.allclose(I.rectify(p, np.stack([x, y])), p) and np.allclose(I.upsample(p, 9, 11, True)[:, ::2, ::2], p[:, :, ::1])
    assert I.max_pool(np.arange(25.0).reshape(1, 5, 5), 2, 2).shape == (1, 2, 2)
    assert I.center_crop(img, 6, 5).shape == (6, 5, 3)
    patches = np.arange(16).reshape(16, 1)
    assert I.merge_patches(patches, 1, 2, 2)[0].tolist() == [0, 1, 4, 5]


def test_env_file_never_overrides(tmp_path):
    path = tmp_path / ".env"
    path.write_text('# settings\nexport MAX_TOKENS=7\nMODELS_DIR="a b" \nBIND_ADDR=x # local\n')
    assert env_file(str(path)) == {"MAX_TOKENS": "7", "MODELS_DIR": "a b", "BIND_ADDR": "x"} and env_file(str(tmp_path / "none")) == {}
    c = from_env({"MODELS_DIR": "m"}, dotenv=str(path))
    assert (c.models_dir, c.pipeline.max_tokens) == ("m", 7)


def test_settings_and_formats(spark, tmp_path):
    c = from_env({"LAYOUT_NMS": "yes", "LAYOUT_THRESHOLD": "0.5", "MAX_UPLOAD_MB": "x", "USE_DOC_UNWARPING": "TRUE"})
    assert not c.pipeline.layout_nms and c.pipeline.layout_threshold == 0.5 and c.max_upload_mb == 20 and c.pipeline.use_unwarping
    assert PipelineConfig().layout_threshold == 0.3
    assert from_env({"MAX_TOKENS": "-5"}).pipeline.max_tokens == 4096
    assert (device(None), device(" CPU "), device("auto"), device("auto", ("cpu", "metal"))) == ("cpu", "cpu", "cpu", "metal")
    for wrong in ("tpu", "cuda"):
        with pytest.raises(ValueError, match="BACKEND"):
            device(wrong)
    head = b'{"b":{},"a":{},"__metadata__":{}}'
    files = spark.createDataFrame([("m", bytearray(struct.pack("<Q", len(head)) + head + b"xx"))], "path string, content binary")
    assert [r.name for r in formats.tensor_names(files).collect()] == ["a", "b"]
    need = spark.createDataFrame([("k", 1, "x", 2), ("k", 2, "y", 3), ("k", 3, "z", None)], "kind string, ord int, path string, size long")
    have = spark.createDataFrame([("x", 2), ("y", 2)], "path string, length long")
    assert formats.first_missing(need, have).collect()[0].path == "z"
    assert {r.path for r in formats.skippable(need, have).where("skip").collect()} == {"x"}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.json").write_text('{\n "a": 1\n}')
    assert [tuple(r) for r in formats.listing(spark, str(tmp_path)).collect()] == [("sub/c.json", 11)]
    assert formats.json_object(spark, f"{tmp_path}/sub/", "c.json").collect()[0].a == 1
    assert [tuple(r) for r in formats.manifest(spark, [("k", "x", None), ("k", "y", 3)]).collect()] == [("k", 0, "x", None), ("k", 1, "y", 3)]
    up = spark.createDataFrame([("a.jpg", bytearray(b"x")), ("a.bin", bytearray(b"\xff\xd8\xff\xe0")), ("b.bin", bytearray(b"zz")), (None, None)], "filename string, content binary")
    assert [r.status for r in formats.admitted(up, 1).collect()] == [200, 200, 415, 400]
    s = spark.createDataFrame([('{"a": 5}',), (None,)], "t string").select(formats.settings(F.col("t"), {"a": ("int", 1), "b": ("double", 0.5)}).alias("s")).collect()
    assert [tuple(r.s) for r in s] == [(5, 0.5), (1, 0.5)]


def test_admission_against_simulation(spark):
    r = random.Random(4)
    rows = [(k, i, r.random() * 50) for k in range(3) for i in range(80)]
    got = {(x.server, x.seq): x.admitted for x in stream.admissions(spark.createDataFrame(rows, "server int, seq long, at double"), 2, 2.0).collect()}
    for k in range(3):
        ends = []
        for _, seq, at in sorted((x for x in rows if x[0] == k), key=lambda x: (x[2], x[1])):
            busy = [e for e in ends if e > at]
            assert got[k, seq] == (len(busy) < 3)
            if len(busy) < 3:
                ends.append(max([at, *busy]) + 2.0)


def test_written_tables_can_be_dropped(spark):
    df = tables.materialize(spark.range(3), "kept")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 3 and os.path.isdir(path)
    assert tables.drop_written(spark) >= 1 and not os.path.exists(path) and tables.drop_written(spark) == 0


def test_plans(spark):
    df = _df(spark, [[("text", 1.0, 0, 0, 5, 5)]])
    text = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text(S.contained_rows(df)) and "NestedLoop" not in text(S.contained_rows(df))
    chain = text(S.overlap_filter(S.applied(S.page_boxes(df, "score"), S.nms, S.without_contained)))
    assert chain.count("Exchange hashpartitioning") == 1 and "Python" not in chain

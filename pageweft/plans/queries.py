"""Named queries over the tables of the test data, each through its operator, and the same result in SQL where SQL can
express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..functions import geometry as G
from ..functions import labels as L
from ..operators import blocks as B
from ..operators import detect as D
from ..operators import recognize, render
from ..operators import sequences as Q
from ..operators import suppress as S
from ..sources import formats
from ..sources.tables import table
from ..streaming.pages import admissions
from . import pages as plan

CONFIG = PipelineConfig()
NON_MERGE = L.non_merge_labels()
PLACEHOLDER = 5


def boxes(spark: SparkSession, base: str) -> DataFrame:
    return L.named(S.first_delivery(table(spark, base, "detections")), table(spark, base, "label_dim")).select("page_id", *S.BOX)


def page_sizes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "pages_dim").select("page_id", "filename", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))


def blocks(spark: SparkSession, base: str) -> DataFrame:
    b = table(spark, base, "blocks").select("block_id", "page_id", "pos", "id", "ord", "label", "score", *G.SIDES, "crop_w", "crop_h", "content")
    return b.dropDuplicates(["block_id"])


def logits(spark: SparkSession, base: str) -> DataFrame:
    cells = table(spark, base, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode(F.slice("embedding", 1, 64)).alias("k", "v"))
    return cells.select("page_id", F.floor(F.col("k") / 8).cast("int").alias("query"), (F.col("k") % 8).alias("class"), F.col("v").cast("double").alias("logit"))


def tokens(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kind = F.when(F.col("event_type") == "error", PLACEHOLDER).otherwise(F.length("event_type") + 10)
    return e.select(F.col("user_id").alias("seq_id"), pos.alias("pos"), kind.alias("token"), F.col("value"))


def span_grids(spark: SparkSession, base: str, frames: bool = False) -> DataFrame:
    sp = Q.spans(tokens(spark, base), PLACEHOLDER)
    n = F.col("stop") - F.col("start")
    two = n % 2 == 0
    t = F.when(two & F.lit(frames), 2).otherwise(1)
    h = F.when(two & ~F.lit(frames), 2).otherwise(1)
    return sp.select("seq_id", "span", t.alias("grid_t"), h.alias("grid_h"), (n / t / h).cast("int").alias("grid_w"))


def sizes(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "part")
    return p.select("p_partkey", (F.col("p_size") * 37 % 1500 + 1).alias("h"), ((F.col("p_partkey") * 53) % 2700 + 1).cast("int").alias("w"))


def _measured(measure, least, strict=False):
    def run(spark, base):
        return S.pairs(boxes(spark, base), measure, least, strict).withColumn("value", F.round("value", 6))

    return run


def _arrays(step, order="id"):
    def run(spark, base):
        pages = S.page_boxes(boxes(spark, base), order)
        return S.rows(step(pages) if step is S.overlap_filter else S.applied(pages, step))

    return run


def _ids(df: DataFrame) -> DataFrame:
    return df.select("page_id", "id", "label")


def _emitted(spark, base):
    return B.emitted(blocks(spark, base), NON_MERGE)


def _softmax(spark, base):
    w = Window.partitionBy("page_id", "query")
    return logits(spark, base).withColumn("p", F.round(D.softmax(F.col("logit"), w), 6)).select("page_id", "query", "class", "p")


def _parts(spark, base):
    x = logits(spark, base)
    g = x.groupBy(F.col("page_id").alias("seq_id"), "query").agg(F.max("logit").alias("m"), F.collect_list(F.struct("class", "logit")).alias("c"))
    e = lambda f: F.aggregate("c", F.lit(0.0), lambda s, v: s + F.exp(v["logit"] - F.col("m")) * f(v))
    return g.select("seq_id", "m", e(lambda v: F.lit(1.0)).alias("s"), e(lambda v: v["class"].cast("double")).alias("o"))


def _markdown(spark, base):
    return render.markdown(blocks(spark, base))


def _resize(spark, base):
    r = sizes(spark, base).withColumn("r", Q.smart_resize(F.col("h"), F.col("w")))
    return r.select("p_partkey", "r.height", "r.width", "r.status")


def _grid(spark, base):
    r = _resize(spark, base).where("status = 'ok'").withColumn("g", Q.grid(F.col("height"), F.col("width")))
    return r.select("p_partkey", F.col("g.h").alias("grid_h"), F.col("g.w").alias("grid_w"), F.col("g.n_tokens").alias("n_tokens"))


def _prompts(spark, base):
    lab = table(spark, base, "label_dim")
    return lab.select("label", L.task(F.col("label")).alias("task"), F.md5(Q.prompt_text(L.prompt(F.col("label")), F.length("label"))).alias("prompt_md5"))


def _needed(spark, base):
    """Page files as required artifacts; every fifth may have any size, and every fourth file isn't there."""
    p = table(spark, base, "pages_dim").where("filename is not null")
    size = F.when(F.col("page_id") % 5 > 0, F.col("page_id") % 7)
    need = p.select(F.lit("page").alias("kind"), F.col("page_id").alias("ord"), F.concat_ws("/", "filename", F.col("page_id").cast("string")).alias("path"), size.alias("size"))
    have = need.where(F.col("ord") % 4 > 0).select("path", (F.col("ord") % 3).alias("length"))
    return need, have


def _verify(spark, base):
    return formats.missing(*_needed(spark, base)).select("ord", "path")


def _trimmed_ids(spark, base):
    ids = tokens(spark, base).groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("ids"))
    return ids.select("seq_id", F.array_join(Q.ids_before_end(F.col("ids"), PLACEHOLDER), " ").alias("ids"))


def _detections(spark, base):
    top = D.top_detections(logits(spark, base), 8, 8).select("page_id", "rank", F.col("query").alias("i"))
    votes = D.order_votes(logits(spark, base).select("page_id", F.col("query").alias("i"), F.col("class").alias("j"), "logit"))
    return D.detection_order(top.join(votes, ["page_id", "i"])).select("page_id", "rank", F.col("i").alias("query"), "id")


def _listed(spark, base):
    """The blocks of the test table as results."""
    b = blocks(spark, base).withColumns({"out_pos": F.col("pos"), "group_id": F.lit(None).cast("int")})
    return render.results(b, page_sizes(spark, base), CONFIG)


def _admission(spark, base):
    e = table(spark, base, "events").select((F.col("user_id") % 20).alias("server"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return admissions(e.withColumn("at", F.col("at") / 1e6), 2, 600.0).select("server", "seq", "admitted")


def _result(spark, base):
    dets, pages = table(spark, base, "detections"), table(spark, base, "pages_dim")
    r = plan.parse_detections(dets, pages, table(spark, base, "label_dim"), recognize.StubBackend, CONFIG)  # a stub: its texts name the blocks
    return r.select("page_id", "source.filename", F.size("blocks").alias("n_blocks"), "markdown")


def _blocks_json(spark, base):
    """Blocks as JSON and read again."""
    b = _emitted(spark, base).withColumn("j", render.block_json())
    read = F.from_json("j", "id int, `order` int, label string, bbox array<double>, score double, content string, group_id int")
    b = b.withColumn("r", read).withColumn("fields", F.array_join(F.json_object_keys("j"), ","))
    sides = [F.col("r.bbox")[i].alias(s) for i, s in enumerate(G.SIDES)]
    return b.select("block_id", "out_pos", "fields", "r.id", F.col("r.order").alias("ord"), "r.label", *sides, "r.score", F.md5("r.content").alias("content_md5"), "r.group_id")


def _image_prep(spark, base):
    """Each embedding's first 48 values as a 4 by 4 picture through the pixel kernels."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from ..functions import images as I

        for b in batches:
            pics = [np.clip(np.array(v[:48]) * 64 + 128, 0, 255).astype(np.uint8).reshape(4, 4, 3) for v in b.column(1).to_pylist()]
            turned = [I.rotate(p, 90) for p in pics]
            ready = [I.normalize(t, (0.5,) * 3, (0.25,) * 3, bgr=True) for t in turned]
            wide = [I.max_pool(I.reflect_pad(r, 1, 1), 2, 2) for r in ready]
            cols = [[int(t[0, 0, 0]) for t in turned], [int(p[3, 0, 0]) for p in pics], [float(r[0].mean()) for r in ready], [float(w.max()) for w in wide]]
            yield pa.record_batch([b.column(0), *[pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.float64()))]], names=["vec_id", "corner", "was", "mean", "top"])

    return table(spark, base, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, corner int, was int, mean double, top double").withColumns({"mean": F.round("mean", 3), "top": F.round("top", 3)})


def _config(spark, base):
    s = formats.settings(F.col("props"), {"k": ("int", -1), "hidden_size": ("int", 1024), "rescale": ("double", 0.5)})
    return table(spark, base, "events").select("event_id", s.alias("s")).select("event_id", "s.*")


QUERIES = {
    "flt_score": lambda s, b: boxes(s, b).where(F.col("score") >= CONFIG.layout_threshold).select("page_id", "id", "score"),
    "flt_ref": lambda s, b: _ids(boxes(s, b).where("label <> 'reference'")),
    "flt_tiny": lambda s, b: _ids(boxes(s, b).where((F.col("x2") - F.col("x1") < S.TINY) | (F.col("y2") - F.col("y1") < S.TINY))),
    "prj_label": lambda s, b: _ids(boxes(s, b)),
    "prj_area": lambda s, b: boxes(s, b).select("page_id", "id", G.area(G.box()).alias("area")),
    "prj_task": lambda s, b: boxes(s, b).select("page_id", "id", L.task(F.col("label")).alias("task"), L.prompt(F.col("label")).alias("prompt")),
    "prj_gate": lambda s, b: boxes(s, b).select("page_id", "id", L.gate(F.col("label")).alias("run")),
    "prj_mergemode": lambda s, b: boxes(s, b).select("page_id", "id", L.merge_mode(F.col("label")).alias("mode"), F.col("label").isin(NON_MERGE).alias("non_merge")),
    "prj_unclip": lambda s, b: boxes(s, b).select("page_id", "id", *[F.round(v, 6).alias(k) for k, v in G.unclipped(G.box(), 1.2).items()]),
    "prj_clamp": lambda s, b: boxes(s, b).join(page_sizes(s, b), "page_id").select("page_id", "id", *[v.alias(k) for k, v in G.clamped(G.box(), F.col("width"), F.col("height")).items()]),
    "prj_crop": lambda s, b: B.cropped(boxes(s, b), page_sizes(s, b), 0.02).select("page_id", "id", "crop_x", "crop_y", "crop_w", "crop_h"),
    "prj_reid": lambda s, b: B.renumber(boxes(s, b).withColumn("old", F.col("id")), F.desc("score"), "old").select("page_id", "old", "id"),
    "prj_fallback": lambda s, b: B.with_fallback(boxes(s, b).where("score >= 0.9"), page_sizes(s, b)).select("page_id", "id", "label", *G.SIDES),
    "prj_proj": _measured(lambda a, b: G.projection(a, b, True), 0.5),
    "prj_align": lambda s, b: boxes(s, b).alias("a").join(boxes(s, b).alias("c"), (F.col("a.page_id") == F.col("c.page_id")) & (F.col("a.id") + 1 == F.col("c.id"))).select(
        F.col("a.page_id").alias("page_id"), F.col("a.id").alias("id"), G.alignment({k: F.col(f"a.{k}") for k in G.SIDES}, {k: F.col(f"c.{k}") for k in G.SIDES}).alias("align")
    ),
    "prj_labelparse": lambda s, b: table(s, b, "label_dim").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.when(F.col("label_id") % 5 == 4, F.concat(F.lit("x"), "label_id")).otherwise(F.col("label_id").cast("string")), "label")))).alias("j")).select(F.explode(L.parse_id2label(F.col("j"))).alias("p")).select("p.label_id", "p.label"),
    "jon_iou": _measured(G.iou, 0.5),
    "jon_iomin": _measured(G.iomin, 0.7, True),
    "jon_contain": lambda s, b: _ids(S.contained_rows(boxes(s, b))),
    "jon_contain_mode": lambda s, b: _ids(S.contained_by_mode(boxes(s, b), lambda c: F.when(c.isin("table", "text"), "large").when(c == "image", "small").otherwise("union"))),
    "agg_nms": lambda s, b: _arrays(lambda x: S.nms(x, 0.5), "score")(s, b).select("page_id", F.col("pos").alias("new_id"), "label", "score", *G.SIDES),
    "agg_overlap": lambda s, b: _ids(_arrays(S.overlap_filter)(s, b)),
    "jon_contain_array": lambda s, b: _ids(_arrays(S.without_contained)(s, b)),
    "pipe_post": lambda s, b: plan.clean_boxes(boxes(s, b), page_sizes(s, b), CONFIG).select("page_id", "id", "label", "score", *G.SIDES),
    "srt_read": lambda s, b: B.reading_order(boxes(s, b)).select("page_id", "id", "pos"),
    "win_link": lambda s, b: B.linked(blocks(s, b), NON_MERGE).select("block_id", "mergeable", "link"),
    "win_group": lambda s, b: B.grouped(blocks(s, b), NON_MERGE).select("block_id", "head"),
    "agg_groupdim": lambda s, b: B.group_sizes(B.grouped(blocks(s, b), NON_MERGE)).select("block_id", "max_w", "sum_h"),
    "win_emit": lambda s, b: _emitted(s, b).select("block_id", "out_pos", "group_id", "has_crop"),
    "win_offset": lambda s, b: B.stacked(B.grouped(blocks(s, b), NON_MERGE)),
    "agg_md": _markdown,
    "snk_json": _blocks_json,
    "page_results": _result,
    "top_det": lambda s, b: D.top_detections(logits(s, b), 8, 8).select("page_id", "rank", "query", "label_id", F.round("score", 6).alias("score")),
    "jon_gather": lambda s, b: D.gathered(D.top_detections(logits(s, b), 8, 8).select("page_id", "rank", "query"), D.class_max(logits(s, b))).select("page_id", "rank", "query", F.round("best", 6).alias("best")),
    "agg_clsmax": lambda s, b: D.class_max(logits(s, b)).withColumn("best", F.round("best", 6)),
    "agg_sigmoid": lambda s, b: logits(s, b).select("page_id", "query", "class", F.round(D.sigmoid(F.col("logit")), 6).alias("p"), F.round(D.inverse_sigmoid(D.sigmoid(F.col("logit"))), 5).alias("back")),
    "agg_softmax": _softmax,
    "agg_argmax": lambda s, b: D.argmax(logits(s, b), ["page_id", "query"], "class", "logit").withColumn("logit", F.round("logit", 6)),
    "agg_order": lambda s, b: D.order_votes(logits(s, b).select("page_id", F.col("query").alias("i"), F.col("class").alias("j"), "logit")).withColumn("votes", F.round("votes", 6)),
    "agg_online": lambda s, b: Q.online_softmax(_parts(s, b)).withColumn("value", F.round("value", 6)),
    "prj_box": lambda s, b: D.to_pixels(logits(s, b).groupBy("page_id", "query").agg(*[F.max(F.when(F.col("class") == i, D.sigmoid(F.col("logit")))).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))]), page_sizes(s, b)).select("page_id", "query", *[F.round(k, 5).alias(k) for k in G.SIDES]),
    "agg_maskbox": lambda s, b: D.mask_boxes(logits(s, b).select("page_id", F.lit(0).alias("query"), F.col("class").alias("x"), F.col("query").alias("y"), "logit"), 8, 8),
    "flt_anchor": lambda s, b: D.anchors(s, [(80, 80), (40, 40), (20, 20), (100, 1)]),
    "win_spans": lambda s, b: Q.spans(tokens(s, b), PLACEHOLDER),
    "win_mrope": lambda s, b: Q.positions(tokens(s, b), span_grids(s, b), PLACEHOLDER),
    "win_mropev": lambda s, b: Q.positions(tokens(s, b), span_grids(s, b, True), PLACEHOLDER, 1.0, first_only=True),
    "agg_mropedelta": lambda s, b: Q.position_delta(Q.positions(tokens(s, b), span_grids(s, b), PLACEHOLDER)),
    "jon_inject": lambda s, b: Q.injected(tokens(s, b), Q.spans(tokens(s, b), PLACEHOLDER).select("seq_id", F.explode(F.sequence("start", F.col("stop") - 1)).alias("p")).select("seq_id", F.row_number().over(Window.partitionBy("seq_id").orderBy("p")).alias("k")).select("seq_id", (F.col("k") - 1).alias("k"), (-F.col("k")).cast("double").alias("value")), PLACEHOLDER),
    "win_cuseq": lambda s, b: Q.cumulative_lengths(span_grids(s, b, True).withColumnRenamed("span", "k")),
    "agg_reppen": lambda s, b: Q.penalised(logits(s, b).groupBy(F.col("page_id").alias("seq_id"), F.col("class").alias("token")).agg(F.max("logit").alias("logit")), logits(s, b).where("logit > 0").select(F.col("page_id").alias("seq_id"), F.col("class").alias("token"))).withColumn("logit", F.round("logit", 6)),
    "lim_maxtok": lambda s, b: Q.decoded(tokens(s, b), PLACEHOLDER, 6).select("seq_id", "pos", "token"),
    "prj_resize28": _resize,
    "prj_grid": _grid,
    "prj_prompt": _prompts,
    "prj_divis": lambda s, b: sizes(s, b).select("p_partkey", Q.make_divisible(F.col("h") * 0.35, 8).alias("channels")),
    "img_reflect": lambda s, b: sizes(s, b).select("p_partkey", Q.reflect(F.col("h") - 700, 97).alias("i")),
    "src_format": lambda s, b: table(s, b, "pages_dim").select("page_id", formats.image_format(F.col("filename"), F.unhex(F.when(F.col("page_id") % 2 == 0, "FFD8FFE0").otherwise("89504E470D0A1A0A"))).alias("format")),
    "src_verify": _verify,
    "src_skip": lambda s, b: formats.skippable(*_needed(s, b)),
    "srt_det": _detections,
    "top_enc": lambda s, b: D.top_anchors(logits(s, b), 3),
    "agg_meanpool": lambda s, b: D.mean_pool(logits(s, b).select("page_id", F.col("class").alias("channel"), F.col("logit").alias("value"))).withColumn("mean", F.round("mean", 6)),
    "prj_ids": _trimmed_ids,
    "prj_meta": lambda s, b: _listed(s, b).select("page_id", "source.filename", "source.width", "source.height", "pipeline_version", F.array_join("stages", ",").alias("stages"), F.col("metadata.device").alias("device"), F.md5("markdown").alias("markdown_md5"), "status"),
    "snk_err": lambda s, b: table(s, b, "events").select("event_id", formats.status_of(F.when(F.col("event_type") == "error", "queue_full").when(F.col("event_type") == "click", "image")).alias("status")),
    "str_queue": _admission,
    "src_modelcfg": _config,
    "prj_angle": lambda s, b: table(s, b, "label_dim").select("label_id", L.angle(F.when(F.col("label_id") % 3 == 0, F.col("label")).otherwise((F.col("label_id") * 90).cast("string"))).alias("angle")),
    "prj_maxtok": lambda s, b: table(s, b, "api_configs").select("api_id", Q.token_limit(F.col("max_tokens"), 1024).alias("limit")),
    "prj_dtype": lambda s, b: table(s, b, "label_dim").select("label_id", formats.dtype(F.element_at(F.array(*map(F.lit, ("bfloat16", "float16", "float32", "int8"))), F.col("label_id") % 4 + 1), False).alias("dtype")),
    "prj_trim": lambda s, b: blocks(s, b).select("block_id", F.md5(Q.trimmed(F.col("content"))).alias("text_md5")),
    "agg_result": lambda s, b: _listed(s, b).select("page_id", F.posexplode("blocks").alias("n", "v")).select("page_id", "n", F.col("v.out_pos").alias("pos"), "v.label", F.col("v.bbox")[0].alias("x1"), F.md5("v.content").alias("content_md5")),
    "agg_countchk": lambda s, b: Q.count_check(tokens(s, b), span_grids(s, b).where("grid_w <> 3 or seq_id % 2 = 0").withColumn("grid_w", F.col("grid_w") + F.when(F.col("seq_id") % 3 == 0, 1).otherwise(0)), PLACEHOLDER),
    "img_prep": _image_prep,
}

_BOX = """box AS (SELECT d.page_id, d.id, d.ord, coalesce(l.label, 'unknown') AS label, d.score, d.x1, d.y1, d.x2, d.y2
 FROM (SELECT DISTINCT page_id, id, score, x1, y1, x2, y2, label_id, ord FROM detections) d LEFT JOIN label_dim l USING (label_id)),
 pg AS (SELECT page_id, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM pages_dim)"""
_PAIR = """pair AS (SELECT a.page_id, a.id AS ia, b.id AS ib, a.label AS la, b.label AS lb, a.score AS sa,
 greatest(a.x2-a.x1,0)*greatest(a.y2-a.y1,0) AS aa, greatest(b.x2-b.x1,0)*greatest(b.y2-b.y1,0) AS ab,
 greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) AS cut,
 least(a.x2,b.x2)-greatest(a.x1,b.x1) AS over_x, greatest(a.x2,b.x2)-least(a.x1,b.x1) AS hull_x
 FROM box a JOIN box b ON a.page_id = b.page_id AND a.id <> b.id)"""
_LARGE = "('" + "', '".join(L.LARGE_LABELS) + "')"
_BLK = """blk AS (SELECT DISTINCT ON (block_id) block_id, page_id, pos, id, ord, label, score, x1, y1, x2, y2, crop_w, crop_h, content FROM blocks)"""
_LINKED = """m AS (SELECT *, label NOT IN ('image', 'header_image', 'footer_image', 'table') AS mergeable FROM blk),
 p AS (SELECT *, last_value(CASE WHEN mergeable THEN {'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'label': label} END IGNORE NULLS)
  OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM m),
 o AS (SELECT p.block_id, bool_or(least(greatest(p.x2, p.q.x2), n.x2) > greatest(least(p.x1, p.q.x1), n.x1) AND least(greatest(p.y2, p.q.y2), n.y2) > greatest(least(p.y1, p.q.y1), n.y1)) AS obst
  FROM p JOIN m n ON n.page_id = p.page_id AND NOT n.mergeable GROUP BY p.block_id),
 k AS (SELECT p.*, coalesce(obst, false) AS obst, least(x2, q.x2) - greatest(x1, q.x1) AS ov FROM p LEFT JOIN o USING (block_id)),
 lk AS (SELECT *, CASE WHEN mergeable AND q IS NOT NULL AND label = 'text' AND q.label = 'text' THEN
  CASE WHEN ov <= 0 AND x1 > q.x2 AND y1 < q.y2 AND x1 - q.x2 < 0.3 * greatest(q.x2 - q.x1, x2 - x1) THEN 'center'
   WHEN ov > 0 AND y2 >= q.y1 AND abs(y1 - q.y2) < 0.5 * greatest(q.y2 - q.y1, y2 - y1) AND (abs(x1 - q.x1) <= 5) <> (abs(x2 - q.x2) <= 5) AND obst
   THEN CASE WHEN abs(x1 - q.x1) <= 5 THEN 'left' ELSE 'right' END END END AS link FROM k),
 gr AS (SELECT *, CASE WHEN mergeable THEN last_value(CASE WHEN mergeable AND link IS NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) END AS head FROM lk),
 dims AS (SELECT *, max(crop_w) OVER (PARTITION BY page_id, head) AS mw, sum(crop_h) OVER (PARTITION BY page_id, head) AS sh, max(pos) OVER (PARTITION BY page_id, head) AS ge FROM gr),
 em AS (SELECT *, last_value(CASE WHEN mergeable THEN head END IGNORE NULLS) OVER w AS g0, last_value(CASE WHEN mergeable THEN ge END IGNORE NULLS) OVER w AS e0 FROM dims
  WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 fin AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN mergeable THEN head WHEN pos <= e0 THEN g0 ELSE pos END, CASE WHEN NOT mergeable AND pos <= e0 THEN 1 ELSE 0 END, pos) - 1 AS out_pos,
  CASE WHEN head IS NOT NULL AND mw > 0 AND sh / mw < 3.0 THEN head END AS grp FROM em)"""
_LINK = f"{_BLK}, {_LINKED}"
_LOGITS = """lg AS (SELECT page_id, CAST((k - 1) // 8 AS INT) AS query, CAST((k - 1) % 8 AS INT) AS class, CAST(embedding[k] AS DOUBLE) AS logit
 FROM (SELECT vec_id AS page_id, embedding, unnest(range(1, 65)) AS k FROM embeddings))"""
_TOK = """tok AS (SELECT user_id AS seq_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
 CASE WHEN event_type = 'error' THEN 5 ELSE length(event_type) + 10 END AS token, value FROM events),
 sp AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY min(pos)) - 1 AS span, min(pos) AS start, max(pos) + 1 AS stop FROM
  (SELECT seq_id, pos, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM tok WHERE token = 5) GROUP BY seq_id, g)"""


def _rope(frames: bool) -> str:
    t = "CASE WHEN (stop - start) % 2 = 0 THEN 2 ELSE 1 END"
    gt, gh = (t, "1") if frames else ("1", t)
    step = 1 if frames else 0
    return _TOK + f""", gd AS (SELECT seq_id, start, stop, {gt} AS gt, {gh} AS gh, (stop - start) // {t} AS gw FROM sp),
 rc AS (SELECT *, greatest((gt - 1) * {step}, gh - 1, gw - 1) + 1 AS reach FROM gd),
 ba AS (SELECT t.seq_id, t.pos, t.token, coalesce(sum((CASE WHEN token <> 5 THEN 1 ELSE 0 END) + coalesce(reach, 0)) OVER (PARTITION BY t.seq_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
  FROM tok t LEFT JOIN rc ON rc.seq_id = t.seq_id AND rc.start = t.pos),
 ps AS (SELECT b.seq_id, b.pos, CASE WHEN b.token = 5 THEN s.base + ((b.pos - r.start) // (gh * gw)) * {step} ELSE b.base END AS t,
  CASE WHEN b.token = 5 THEN s.base + (b.pos - r.start) % (gh * gw) // gw ELSE b.base END AS h,
  CASE WHEN b.token = 5 THEN s.base + (b.pos - r.start) % (gh * gw) % gw ELSE b.base END AS w, 'ok' AS status
  FROM ba b LEFT JOIN rc r ON r.seq_id = b.seq_id AND b.pos >= r.start AND b.pos < r.stop LEFT JOIN ba s ON s.seq_id = r.seq_id AND s.pos = r.start)"""


_SIZE = """sz AS (SELECT p_partkey, CAST(p_size * 37 % 1500 + 1 AS DOUBLE) AS h, CAST((p_partkey * 53) % 2700 + 1 AS DOUBLE) AS w FROM part),
 s1 AS (SELECT p_partkey, greatest(h, 28.0) AS h1, CASE WHEN h < 28 THEN floor(w * 28 / h + 0.5) ELSE w END AS w1 FROM sz),
 s2 AS (SELECT p_partkey, CASE WHEN w1 < 28 THEN floor(h1 * 28 / w1 + 0.5) ELSE h1 END AS h2, greatest(w1, 28.0) AS w2 FROM s1),
 s3 AS (SELECT *, greatest(h2, w2) / least(h2, w2) <= 200 AS ok, floor(h2 / 28 + 0.5) * 28 AS rh, floor(w2 / 28 + 0.5) * 28 AS rw, sqrt(h2 * w2 / 1003520) AS dn, sqrt(112896 / (h2 * w2)) AS up FROM s2),
 rs AS (SELECT p_partkey, CASE WHEN ok THEN CAST(greatest(CASE WHEN rh * rw > 1003520 THEN floor(h2 / dn / 28) * 28 WHEN rh * rw < 112896 THEN ceil(h2 * up / 28) * 28 ELSE rh END, 28) AS INT) END AS height,
  CASE WHEN ok THEN CAST(greatest(CASE WHEN rh * rw > 1003520 THEN floor(w2 / dn / 28) * 28 WHEN rh * rw < 112896 THEN ceil(w2 * up / 28) * 28 ELSE rw END, 28) AS INT) END AS width, CASE WHEN ok THEN 'ok' ELSE 'invalid_aspect' END AS status FROM s3)"""

_TASK = "CASE label WHEN 'table' THEN 'table' WHEN 'formula' THEN 'formula' WHEN 'display_formula' THEN 'formula' WHEN 'inline_formula' THEN 'formula' WHEN 'chart' THEN 'chart' WHEN 'seal' THEN 'seal' ELSE 'ocr' END"
_PROMPT = f"CASE {_TASK} WHEN 'table' THEN 'Table Recognition:' WHEN 'formula' THEN 'Formula Recognition:' WHEN 'chart' THEN 'Chart Recognition:' WHEN 'seal' THEN 'Seal Recognition:' ELSE 'OCR:' END"
_WHITE = r"[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_UNCLIP = {"x1": "x1 + w/2 - w*1.2/2", "y1": "y1 + h/2 - h*1.2/2", "x2": "x1 + w/2 + w*1.2/2", "y2": "y1 + h/2 + h*1.2/2"}



def _nms(src: str) -> str:
    """Suppression over ``src``: st, whose rows from i = 0 on are the kept boxes in order."""
    area = lambda b: f"greatest({b}.x2-{b}.x1,0)*greatest({b}.y2-{b}.y1,0)"
    cut = "greatest(least(b.x2,rem[1].x2)-greatest(b.x1,rem[1].x1),0)*greatest(least(b.y2,rem[1].y2)-greatest(b.y1,rem[1].y1),0)"
    all_ = f"({area('b')} + {area('rem[1]')} - {cut})"
    return f"""st AS (
 SELECT page_id, list({{'label': label, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'ord': ord}} ORDER BY score DESC, id) AS rem, {{'label': '', 'score': 0::DOUBLE, 'x1': 0::DOUBLE, 'y1': 0::DOUBLE, 'x2': 0::DOUBLE, 'y2': 0::DOUBLE, 'ord': 0::INT}} AS kept, -1 AS i FROM {src} GROUP BY page_id
 UNION ALL SELECT page_id, list_filter(CASE WHEN len(rem) > 2 THEN list_concat([rem[len(rem)]], rem[2:len(rem)-1]) ELSE rem[2:] END, lambda b: CASE WHEN {all_} <= 0 THEN true ELSE {cut} / {all_} < 0.5 END),
  rem[1], i + 1 FROM st WHERE len(rem) > 0)"""


def _overlap(src: str) -> str:
    """The overlap filter over ``src``: clear, the boxes that are left."""
    return f"""bx AS (SELECT * FROM {src} WHERE label <> 'reference'),
 ev AS (SELECT page_id, id AS i, -1 AS j, 0 AS kind FROM bx WHERE x2 - x1 < 6 OR y2 - y1 < 6 UNION ALL
  SELECT a.page_id, a.id, b.id, CASE WHEN a.label = 'inline_formula' AND b.label = 'inline_formula' THEN 3 WHEN a.label = 'inline_formula' THEN 1 WHEN b.label = 'inline_formula' THEN 2
   WHEN (a.x2-a.x1)*(a.y2-a.y1) >= (b.x2-b.x1)*(b.y2-b.y1) THEN 2 ELSE 1 END
  FROM bx a JOIN bx b ON a.page_id = b.page_id AND a.id < b.id
  WHERE least(greatest(a.x2-a.x1,0)*greatest(a.y2-a.y1,0), greatest(b.x2-b.x1,0)*greatest(b.y2-b.y1,0)) > 0 AND
   greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) / least(greatest(a.x2-a.x1,0)*greatest(a.y2-a.y1,0), greatest(b.x2-b.x1,0)*greatest(b.y2-b.y1,0)) >
   CASE WHEN a.label = 'inline_formula' OR b.label = 'inline_formula' THEN 0.5 WHEN a.label <> b.label AND a.label IN ('image','table','seal','chart') AND b.label IN ('image','table','seal','chart') THEN 9 ELSE 0.7 END),
 sq AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i, j) AS n FROM ev),
 run AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS dr FROM sq UNION ALL
  SELECT s.page_id, s.n, CASE WHEN s.kind = 0 THEN list_append(dr, s.i::BIGINT) WHEN list_contains(dr, s.i::BIGINT) OR list_contains(dr, s.j::BIGINT) THEN dr
   WHEN s.kind = 1 THEN list_append(dr, s.i::BIGINT) WHEN s.kind = 2 THEN list_append(dr, s.j::BIGINT) ELSE list_append(list_append(dr, s.i::BIGINT), s.j::BIGINT) END
  FROM run r JOIN sq s ON s.page_id = r.page_id AND s.n = r.n + 1),
 last_ AS (SELECT page_id, arg_max(dr, n) AS dr FROM run GROUP BY page_id),
 clear AS (SELECT b.* FROM bx b LEFT JOIN last_ f USING (page_id) WHERE f.dr IS NULL OR NOT list_contains(f.dr, b.id::BIGINT))"""


#: The whole clean-up of labelled boxes: threshold, suppression, containment, overlap.
_POST = f"""sure AS (SELECT * FROM box WHERE score >= 0.3), {_nms('sure')},
 kept_ AS (SELECT page_id, i AS id, kept.ord AS ord, kept.label AS label, kept.score AS score, kept.x1 AS x1, kept.y1 AS y1, kept.x2 AS x2, kept.y2 AS y2 FROM st WHERE i >= 0),
 swal AS (SELECT DISTINCT a.page_id, a.id FROM kept_ a JOIN kept_ b ON a.page_id = b.page_id AND a.id <> b.id WHERE b.label IN {_LARGE} AND NOT (a.label = 'formula' AND b.label <> 'formula')
  AND (a.x2-a.x1) > 0 AND (a.y2-a.y1) > 0 AND greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) / ((a.x2-a.x1)*(a.y2-a.y1)) >= 0.9),
 outer_ AS (SELECT * REPLACE ((row_number() OVER (PARTITION BY page_id ORDER BY id) - 1)::INT AS id) FROM kept_ WHERE (page_id, id) NOT IN (SELECT page_id, id FROM swal)), {_overlap('outer_')}"""

ORACLE = {
    "flt_score": f"WITH {_BOX} SELECT page_id, id, score FROM box WHERE score >= 0.3",
    "flt_ref": f"WITH {_BOX} SELECT page_id, id, label FROM box WHERE label <> 'reference'",
    "flt_tiny": f"WITH {_BOX} SELECT page_id, id, label FROM box WHERE x2 - x1 < 6 OR y2 - y1 < 6",
    "prj_label": f"WITH {_BOX} SELECT page_id, id, label FROM box",
    "prj_area": f"WITH {_BOX} SELECT page_id, id, greatest(x2-x1,0)*greatest(y2-y1,0) AS area FROM box",
    "prj_task": f"WITH {_BOX} SELECT page_id, id, {_TASK} AS task, {_PROMPT} AS prompt FROM box",
    "prj_gate": f"WITH {_BOX} SELECT page_id, id, label NOT IN ('chart', 'seal', 'image', 'header_image', 'footer_image') AS run FROM box",
    "prj_mergemode": f"WITH {_BOX} SELECT page_id, id, CASE WHEN label IN {_LARGE} THEN 'large' ELSE 'union' END AS mode, label IN ('image', 'header_image', 'footer_image', 'table') AS non_merge FROM box",
    "prj_unclip": f"WITH {_BOX}, s AS (SELECT *, greatest(x2-x1,0) AS w, greatest(y2-y1,0) AS h FROM box) SELECT page_id, id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _UNCLIP.items()) + " FROM s",
    "prj_clamp": f"WITH {_BOX} SELECT page_id, id, least(greatest(x1,0),width::DOUBLE) AS x1, least(greatest(y1,0),height::DOUBLE) AS y1, least(greatest(x2,0),width::DOUBLE) AS x2, least(greatest(y2,0),height::DOUBLE) AS y2 FROM box JOIN pg USING (page_id)",
    "prj_crop": f"""WITH {_BOX}, p AS (SELECT page_id, id, floor(greatest(x1 - greatest(x2-x1,1)*0.02, 0)) AS l, floor(greatest(y1 - greatest(y2-y1,1)*0.02, 0)) AS t,
 ceil(least(x2 + greatest(x2-x1,1)*0.02, width)) AS r, ceil(least(y2 + greatest(y2-y1,1)*0.02, height)) AS b FROM box JOIN pg USING (page_id))
 SELECT page_id, id, l::INT AS crop_x, t::INT AS crop_y, greatest(r-l,1)::INT AS crop_w, greatest(b-t,1)::INT AS crop_h FROM p""",
    "prj_reid": f"WITH {_BOX} SELECT page_id, id AS old, (row_number() OVER (PARTITION BY page_id ORDER BY score DESC, id) - 1)::INT AS id FROM box",
    "prj_fallback": f"WITH {_BOX}, k AS (SELECT * FROM box WHERE score >= 0.9) SELECT page_id, id, label, x1, y1, x2, y2 FROM k UNION ALL SELECT page_id, 0, 'text', 0, 0, width::DOUBLE, height::DOUBLE FROM pg WHERE page_id NOT IN (SELECT page_id FROM k)",
    "prj_proj": f"WITH {_BOX}, {_PAIR} SELECT page_id, ia AS id_a, ib AS id_b, round(over_x / hull_x, 6) AS value FROM pair WHERE ia < ib AND over_x > 0 AND hull_x > 0 AND over_x / hull_x >= 0.5",
    "prj_align": f"WITH {_BOX} SELECT a.page_id, a.id, CASE WHEN abs(a.x1-c.x1) <= 5 THEN 'left' WHEN abs(a.x2-c.x2) <= 5 THEN 'right' ELSE 'center' END AS align FROM box a JOIN box c ON a.page_id = c.page_id AND c.id = a.id + 1",
    "prj_labelparse": "SELECT label_id, label FROM label_dim WHERE label_id % 5 <> 4",
    "jon_iou": f"WITH {_BOX}, {_PAIR} SELECT page_id, ia AS id_a, ib AS id_b, round(cut / (aa+ab-cut), 6) AS value FROM pair WHERE ia < ib AND aa+ab-cut > 0 AND cut / (aa+ab-cut) >= 0.5",
    "jon_iomin": f"WITH {_BOX}, {_PAIR} SELECT page_id, ia AS id_a, ib AS id_b, round(cut / least(aa,ab), 6) AS value FROM pair WHERE ia < ib AND least(aa,ab) > 0 AND cut / least(aa,ab) > 0.7",
    "jon_contain": f"WITH {_BOX}, {_PAIR} SELECT page_id, id, label FROM box x WHERE NOT EXISTS (SELECT 1 FROM pair p WHERE p.page_id = x.page_id AND p.ia = x.id AND lb IN {_LARGE} AND NOT (la = 'formula' AND lb <> 'formula') AND aa > 0 AND cut / aa >= 0.9)",
    "jon_contain_mode": f"""WITH {_BOX}, {_PAIR}, hit AS (SELECT page_id, ia, ib, la, lb FROM pair WHERE NOT (la = 'formula' AND lb <> 'formula') AND aa > 0 AND cut / aa >= 0.9),
 gone AS (SELECT page_id, ia AS id FROM hit WHERE lb IN ('table', 'text') UNION SELECT page_id, ib FROM hit h WHERE la = 'image' AND NOT EXISTS (SELECT 1 FROM hit g WHERE g.page_id = h.page_id AND g.ia = h.ib AND g.la = 'image'))
 SELECT page_id, id, label FROM box WHERE (page_id, id) NOT IN (SELECT page_id, id FROM gone)""",
    "agg_nms": f"WITH RECURSIVE {_BOX}, {_nms('box')} SELECT page_id, i AS new_id, kept.label AS label, kept.score AS score, kept.x1 AS x1, kept.y1 AS y1, kept.x2 AS x2, kept.y2 AS y2 FROM st WHERE i >= 0",
    "agg_overlap": f"WITH RECURSIVE {_BOX}, {_overlap('box')} SELECT page_id, id, label FROM clear",
    "pipe_post": f"WITH RECURSIVE {_BOX}, {_POST} SELECT page_id, id, label, score, x1, y1, x2, y2 FROM clear",
    "page_results": f"""WITH RECURSIVE {_BOX}, {_POST},
 full_ AS (SELECT page_id, id, ord, label, score, x1, y1, x2, y2 FROM clear UNION ALL SELECT page_id, 0, 0, 'text', 1.0, 0, 0, width::DOUBLE, height::DOUBLE FROM pg WHERE page_id NOT IN (SELECT page_id FROM clear)),
 rect AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord ASC NULLS LAST, id) - 1 AS pos, floor(greatest(x1, 0)) AS l, floor(greatest(y1, 0)) AS t, ceil(least(x2, width)) AS r, ceil(least(y2, height)) AS b FROM full_ JOIN pg USING (page_id)),
 blk AS (SELECT row_number() OVER () AS block_id, page_id, pos, id, ord, label, score, x1, y1, x2, y2, greatest(r - l, 1)::INT AS crop_w, greatest(b - t, 1)::INT AS crop_h FROM rect), {_LINKED},
 said AS (SELECT page_id, out_pos, label, CASE WHEN label NOT IN ('chart', 'seal', 'image', 'header_image', 'footer_image') AND (grp IS NULL OR grp = pos) THEN {_PROMPT} || ' ' || page_id || '-' || pos ELSE '' END AS content FROM fin)
 SELECT s.page_id, p.filename, count(*) AS n_blocks, coalesce(string_agg(CASE WHEN label NOT IN ('number', 'footnote', 'header', 'header_image', 'footer', 'footer_image', 'aside_text') AND content <> '' THEN content || chr(10) || chr(10) END, '' ORDER BY out_pos), '') AS markdown
 FROM said s JOIN pages_dim p USING (page_id) GROUP BY ALL""",
    "srt_read": f"WITH {_BOX} SELECT page_id, id, (row_number() OVER (PARTITION BY page_id ORDER BY ord ASC NULLS LAST, id) - 1)::INT AS pos FROM box",
    "win_link": f"WITH {_LINK} SELECT block_id, mergeable, link FROM lk",
    "win_group": f"WITH {_LINK} SELECT block_id, head FROM gr",
    "agg_groupdim": f"WITH {_LINK} SELECT block_id, CASE WHEN head IS NOT NULL THEN mw END AS max_w, CASE WHEN head IS NOT NULL THEN sh END AS sum_h FROM dims",
    "win_emit": f"WITH {_LINK} SELECT block_id, out_pos, grp AS group_id, grp IS NULL OR grp = pos AS has_crop FROM fin",
    "agg_md": f"""WITH {_BLK} SELECT page_id, coalesce(string_agg(CASE WHEN label NOT IN ('number', 'footnote', 'header', 'header_image', 'footer', 'footer_image', 'aside_text') AND coalesce(content, '') <> ''
 THEN content || CASE WHEN ends_with(content, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END END, '' ORDER BY pos), '') AS markdown FROM blk GROUP BY page_id""",
    "top_det": f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY logit DESC, query*8+class) - 1 AS rank FROM lg) SELECT page_id, rank, query, class AS label_id, round(1/(1+exp(-logit)), 6) AS score FROM r WHERE rank < 8",
    "jon_gather": f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY logit DESC, query*8+class) - 1 AS rank FROM lg), m AS (SELECT page_id, query, max(logit) AS best FROM lg GROUP BY ALL) SELECT page_id, rank, query, round(best, 6) AS best FROM r JOIN m USING (page_id, query) WHERE rank < 8",
    "agg_clsmax": f"WITH {_LOGITS} SELECT page_id, query, round(max(logit), 6) AS best FROM lg GROUP BY ALL",
    "agg_sigmoid": f"WITH {_LOGITS}, p AS (SELECT *, 1/(1+exp(-logit)) AS s FROM lg) SELECT page_id, query, class, round(s, 6) AS p, round(ln(greatest(s, 1e-5)/greatest(1-s, 1e-5)), 5) AS back FROM p",
    "agg_softmax": f"WITH {_LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY page_id, query)) AS e FROM lg) SELECT page_id, query, class, round(e / sum(e) OVER (PARTITION BY page_id, query), 6) AS p FROM e",
    "agg_argmax": f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, query ORDER BY logit DESC, class DESC) AS n FROM lg) SELECT page_id, query, class, round(logit, 6) AS logit FROM r WHERE n = 1",
    "agg_order": f"""WITH {_LOGITS}, v AS (SELECT page_id, query AS i, 1/(1+exp(-logit)) AS v FROM lg WHERE query < class UNION ALL SELECT page_id, class, 1 - 1/(1+exp(-logit)) FROM lg WHERE query < class UNION ALL SELECT page_id, query, 0 FROM lg),
 t AS (SELECT page_id, i, sum(v) AS votes FROM v GROUP BY ALL) SELECT page_id, i, round(votes, 6) AS votes, row_number() OVER (PARTITION BY page_id ORDER BY round(votes, 9) DESC, i) - 1 AS ord FROM t""",
    "agg_online": f"WITH {_LOGITS} SELECT page_id AS seq_id, round(sum(class * exp(logit)) / sum(exp(logit)), 6) AS value FROM lg GROUP BY ALL",
    "prj_box": f"""WITH {_LOGITS}, c AS (SELECT page_id, query, max(CASE WHEN class=0 THEN 1/(1+exp(-logit)) END) AS cx, max(CASE WHEN class=1 THEN 1/(1+exp(-logit)) END) AS cy, max(CASE WHEN class=2 THEN 1/(1+exp(-logit)) END) AS w, max(CASE WHEN class=3 THEN 1/(1+exp(-logit)) END) AS h FROM lg GROUP BY ALL)
 SELECT c.page_id, query, round((cx - w*0.5)*width, 5) AS x1, round((cy - h*0.5)*height, 5) AS y1, round((cx + w*0.5)*width, 5) AS x2, round((cy + h*0.5)*height, 5) AS y2 FROM c JOIN (SELECT page_id, coalesce(width, 0) AS width, coalesce(height, 0) AS height FROM pages_dim) USING (page_id)""",
    "agg_maskbox": f"""WITH {_LOGITS}, m AS (SELECT page_id, min(CASE WHEN logit > 0 THEN class END) AS a, max(CASE WHEN logit > 0 THEN class END) + 1 AS b, min(CASE WHEN logit > 0 THEN query END) AS c, max(CASE WHEN logit > 0 THEN query END) + 1 AS d FROM lg GROUP BY ALL)
 SELECT page_id, 0 AS query, coalesce((a+b)/16.0, 0) AS cx, coalesce((c+d)/16.0, 0) AS cy, coalesce((b-a)/8.0, 0) AS w, coalesce((d-c)/8.0, 0) AS h FROM m""",
    "flt_anchor": """WITH l AS (SELECT * FROM (VALUES (0, 80, 80), (1, 40, 40), (2, 20, 20), (3, 100, 1)) v(level, h, w)), c AS (SELECT level, h, w, unnest(range(h*w)) AS k FROM l),
 g AS (SELECT level, CAST(k // w AS INT) AS y, CAST(k % w AS INT) AS x, (k % w + 0.5::DOUBLE) / w AS cx, (k // w + 0.5::DOUBLE) / h AS cy FROM c) SELECT *, cx > 0.01 AND cx < 1 - 0.01 AND cy > 0.01 AND cy < 1 - 0.01 AS valid FROM g""",
    "win_spans": f"WITH {_TOK} SELECT seq_id, span, start, stop FROM sp",
    "win_mrope": f"WITH {_rope(False)} SELECT * FROM ps",
    "win_mropev": f"""WITH {_TOK}, gd AS (SELECT seq_id, start, stop, CASE WHEN (stop - start) % 2 = 0 THEN 2 ELSE 1 END AS gt FROM sp WHERE span = 0),
 v AS (SELECT tok.*, gt, (stop - start) // gt AS gw, start, stop, coalesce(tok.pos >= start AND tok.pos < stop, false) AS inside FROM tok LEFT JOIN gd USING (seq_id))
 SELECT seq_id, pos, CASE WHEN inside THEN start + (pos - start) // gw WHEN pos >= stop THEN start + greatest(gt, gw) + pos - stop ELSE pos END AS t,
  CASE WHEN inside THEN start WHEN pos >= stop THEN start + greatest(gt, gw) + pos - stop ELSE pos END AS h,
  CASE WHEN inside THEN start + (pos - start) % gw WHEN pos >= stop THEN start + greatest(gt, gw) + pos - stop ELSE pos END AS w, 'ok' AS status FROM v""",
    "agg_mropedelta": f"WITH {_rope(False)} SELECT seq_id, max(greatest(t, h, w)) + 1 - count(*) AS delta FROM ps GROUP BY seq_id",
    "jon_inject": f"WITH {_TOK} SELECT seq_id, pos, CASE WHEN token = 5 THEN -sum(CASE WHEN token = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY pos)::DOUBLE ELSE value END AS value, 'ok' AS status FROM tok",
    "win_cuseq": f"""WITH {_TOK}, f AS (SELECT seq_id, span, unnest(range(CASE WHEN (stop-start) % 2 = 0 THEN 2 ELSE 1 END)) AS f, (stop-start) // CASE WHEN (stop-start) % 2 = 0 THEN 2 ELSE 1 END AS n FROM sp)
 SELECT seq_id, row_number() OVER w AS i, sum(n) OVER w AS length FROM f WINDOW w AS (PARTITION BY seq_id ORDER BY span, f) UNION ALL SELECT DISTINCT seq_id, 0, 0 FROM sp""",
    "agg_reppen": f"""WITH {_LOGITS}, b AS (SELECT page_id AS seq_id, class AS token, max(logit) AS l, count(*) FILTER (WHERE logit > 0) AS n FROM lg GROUP BY ALL)
 SELECT seq_id, token, round(CASE WHEN l > 0 THEN l / pow(1.1::DOUBLE, n) ELSE l * pow(1.1::DOUBLE, n) END, 6) AS logit FROM b""",
    "lim_maxtok": f"WITH {_TOK} SELECT seq_id, pos, token FROM tok t WHERE pos < 6 AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.seq_id = t.seq_id AND sp.start <= t.pos)",
    "prj_resize28": f"WITH {_SIZE} SELECT * FROM rs",
    "prj_grid": f"WITH {_SIZE} SELECT p_partkey, height // 14 AS grid_h, width // 14 AS grid_w, (height // 14 // 2) * (width // 14 // 2) AS n_tokens FROM rs WHERE status = 'ok'",
    "prj_prompt": f"SELECT label, {_TASK} AS task, md5('<|begin_of_sentence|>User: <|IMAGE_START|>' || repeat('<|IMAGE_PLACEHOLDER|>', length(label)) || '<|IMAGE_END|>' || {_PROMPT} || chr(10) || 'Assistant:' || chr(10)) AS prompt_md5 FROM label_dim",
    "prj_divis": "WITH v AS (SELECT p_partkey, (p_size * 37 % 1500 + 1) * 0.35::DOUBLE AS v FROM part), n AS (SELECT *, greatest(floor((v + 4) / 8) * 8, 8) AS d FROM v) SELECT p_partkey, CAST(CASE WHEN d < 0.9 * v THEN d + 8 ELSE d END AS INT) AS channels FROM n",
    "img_reflect": "WITH v AS (SELECT p_partkey, ((p_size * 37 % 1500 + 1 - 700) % 192 + 192) % 192 AS r FROM part) SELECT p_partkey, CASE WHEN r < 97 THEN r ELSE 192 - r END AS i FROM v",
    "src_format": "SELECT page_id, CASE WHEN regexp_matches(lower(filename), '\\.jpe?g$') THEN 'jpeg' WHEN ends_with(lower(filename), '.png') THEN 'png' WHEN page_id % 2 = 0 THEN 'jpeg' ELSE 'png' END AS format FROM pages_dim",
    "src_verify": "SELECT page_id AS ord, filename || '/' || page_id AS path FROM pages_dim WHERE filename IS NOT NULL AND page_id % 4 = 0",
    "src_skip": "SELECT filename || '/' || page_id AS path, page_id % 4 > 0 AND (page_id % 5 = 0 OR page_id % 7 = page_id % 3) AS skip FROM pages_dim WHERE filename IS NOT NULL",
    "srt_det": f"""WITH {_LOGITS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY logit DESC, query*8+class) - 1 AS rank FROM lg),
 v AS (SELECT page_id, query AS i, 1/(1+exp(-logit)) AS v FROM lg WHERE query < class UNION ALL SELECT page_id, class, 1 - 1/(1+exp(-logit)) FROM lg WHERE query < class UNION ALL SELECT page_id, query, 0 FROM lg),
 o AS (SELECT page_id, i, row_number() OVER (PARTITION BY page_id ORDER BY round(sum(v), 9) DESC, i) AS ord FROM v GROUP BY page_id, i)
 SELECT r.page_id, rank, query, row_number() OVER (PARTITION BY r.page_id ORDER BY ord, rank) - 1 AS id FROM r JOIN o ON o.page_id = r.page_id AND o.i = r.query WHERE rank < 8""",
    "top_enc": f"WITH {_LOGITS}, m AS (SELECT page_id, query, max(logit) AS best FROM lg GROUP BY ALL), r AS (SELECT page_id, query, row_number() OVER (PARTITION BY page_id ORDER BY best DESC, query) - 1 AS rank FROM m) SELECT page_id, rank, query FROM r WHERE rank < 3",
    "agg_meanpool": f"WITH {_LOGITS} SELECT page_id, class AS channel, round(avg(logit), 6) AS mean FROM lg GROUP BY ALL",
    "prj_ids": f"WITH {_TOK} SELECT t.seq_id, coalesce(string_agg(CASE WHEN t.pos < coalesce(f.at, 1e15) THEN token END, ' ' ORDER BY t.pos), '') AS ids FROM tok t LEFT JOIN (SELECT seq_id, min(start) AS at FROM sp GROUP BY seq_id) f USING (seq_id) GROUP BY t.seq_id",
    "prj_meta": f"""WITH {_BLK}, md AS (SELECT page_id, string_agg(CASE WHEN label NOT IN ('number', 'footnote', 'header', 'header_image', 'footer', 'footer_image', 'aside_text') AND coalesce(content, '') <> ''
 THEN content || CASE WHEN ends_with(content, chr(10)) THEN chr(10) ELSE chr(10) || chr(10) END END, '' ORDER BY pos) AS markdown FROM blk GROUP BY page_id)
 SELECT page_id, filename, coalesce(width, 0) AS width, coalesce(height, 0) AS height, 'v1.6' AS pipeline_version, 'doc_orientation,doc_unwarping,layout,recognition' AS stages, 'cpu' AS device, md5(coalesce(markdown, '')) AS markdown_md5, 'ok' AS status FROM pages_dim LEFT JOIN md USING (page_id)""",
    "win_offset": f"""WITH {_LINK}, c AS (SELECT page_id, head, pos, crop_w, crop_h, coalesce(link, 'center') AS how, row_number() OVER k - 1 AS i, max(crop_w) OVER (k ROWS UNBOUNDED PRECEDING) AS w FROM gr WHERE head IS NOT NULL WINDOW k AS (PARTITION BY page_id, head ORDER BY pos)),
 d AS (SELECT *, w - coalesce(lag(w) OVER k, w) AS grew, w - crop_w AS gap FROM c WINDOW k AS (PARTITION BY page_id, head ORDER BY pos)),
 e AS (SELECT *, CASE how WHEN 'center' THEN grew // 2 WHEN 'right' THEN grew ELSE 0 END AS pushed, CASE WHEN i = 0 THEN 0 WHEN how = 'center' THEN gap // 2 WHEN how = 'right' THEN gap ELSE 0 END AS own FROM d)
 SELECT page_id, head, i, pos, own + coalesce(sum(pushed) OVER (k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS x_off, coalesce(sum(crop_h) OVER (k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y_off,
  max(w) OVER (PARTITION BY page_id, head) AS canvas_w, sum(crop_h) OVER (PARTITION BY page_id, head) AS canvas_h FROM e WINDOW k AS (PARTITION BY page_id, head ORDER BY pos)""",
    "snk_json": f"WITH {_LINK} SELECT block_id, out_pos, 'id,order,label,bbox,score,content' || CASE WHEN grp IS NULL THEN '' ELSE ',group_id' END AS fields, id, ord, label, x1, y1, x2, y2, score, md5(content) AS content_md5, grp AS group_id FROM fin",
    "str_queue": """WITH RECURSIVE ar AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY came, seq) AS n FROM (SELECT user_id % 20 AS server, event_id AS seq, epoch_us(ts) / 1e6 AS came FROM events)),
 go AS (SELECT DISTINCT server, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST([] AS DOUBLE[]) AS busy, true AS admitted FROM ar UNION ALL
  SELECT server, n, seq, CASE WHEN len(b) < 3 THEN list_append(b, coalesce(b[len(b)], came) + 600) ELSE b END, len(b) < 3
  FROM (SELECT a.server, a.n, a.seq, a.came, list_filter(g.busy, lambda t: t > a.came) AS b FROM go g JOIN ar a ON a.server = g.server AND a.n = g.n + 1))
 SELECT server, seq, admitted FROM go WHERE n > 0""",
    "img_prep": """WITH p AS (SELECT vec_id, unnest(range(48)) AS k, embedding FROM embeddings), v AS (SELECT vec_id, k, trunc(greatest(least(CAST(embedding[k + 1] AS DOUBLE) * 64 + 128, 255), 0)) AS v FROM p)
 SELECT vec_id, max(CASE WHEN k = 36 THEN v END)::INT AS corner, max(CASE WHEN k = 36 THEN v END)::INT AS was, round((avg(CASE WHEN k % 3 = 2 THEN v END) / 255 - 0.5) / 0.25, 3) AS mean, round((max(v) / 255 - 0.5) / 0.25, 3) AS top FROM v GROUP BY vec_id""",
    "snk_err": "SELECT event_id, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 400 ELSE 200 END AS status FROM events",
}
ORACLE |= {
    "src_modelcfg": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, 1024 AS hidden_size, 0.5::DOUBLE AS rescale FROM events",
    "prj_angle": "SELECT label_id, CASE WHEN label_id % 3 = 0 THEN 0 ELSE label_id * 90 END AS angle FROM label_dim",
    "prj_maxtok": "SELECT api_id, least(max_tokens, 1024) AS limit FROM api_configs",
    "prj_dtype": "SELECT label_id, CASE label_id % 4 WHEN 0 THEN 'bf16' WHEN 1 THEN 'f16' WHEN 2 THEN 'f32' END AS dtype FROM label_dim",
    "prj_trim": f"WITH {_BLK} SELECT block_id, md5(regexp_replace(content, '^{_WHITE}+|{_WHITE}+$', '', 'g')) AS text_md5 FROM blk",
    "agg_result": f"WITH {_BLK} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n, pos, label, x1, md5(coalesce(content, '')) AS content_md5 FROM blk JOIN pages_dim USING (page_id)",
    "agg_countchk": f"""WITH {_TOK}, g AS (SELECT *, stop - start AS n, CASE WHEN (stop - start) % 2 = 0 THEN 2 ELSE 1 END AS gh FROM sp), h AS (SELECT *, n // gh AS gw FROM g),
 c AS (SELECT *, CASE WHEN gw <> 3 OR seq_id % 2 = 0 THEN gh * (gw + CASE WHEN seq_id % 3 = 0 THEN 1 ELSE 0 END) END AS cells FROM h)
 SELECT seq_id, sum(n) AS n_tokens, coalesce(sum(cells), 0) AS n_grid, count(n) AS n_spans, count(cells) AS n_grids, CASE WHEN bool_and(coalesce(n = cells, false)) THEN 'ok' ELSE 'mismatch' END AS status FROM c GROUP BY seq_id""",
}
ORACLE["jon_contain_array"] = ORACLE["jon_contain"]

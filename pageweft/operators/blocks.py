"""From clean boxes to ordered blocks: fallback, reading order, crops, text groups, emission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L



def page_window():
    return Window.partitionBy("page_id")



def with_fallback(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """``boxes`` and, for each page without any, one text block that covers the page. Unknown sizes count as 0."""
    size = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    every = pages.select("page_id", size("width").alias("__w"), size("height").alias("__h"), F.lit(True).alias("__page")).dropDuplicates(["page_id"])
    names = ["id", "ord", "label", "score", *G.SIDES]
    rows = boxes.select("page_id", *names, F.lit(True).alias("__box")).join(every, "page_id", "full")
    whole = {"id": F.lit(0), "ord": F.lit(0), "label": F.lit("text"), "score": F.lit(1.0), "x1": F.lit(0.0), "y1": F.lit(0.0), "x2": F.col("__w"), "y2": F.col("__h")}
    return rows.select("page_id", *[F.when(F.col("__box"), F.col(k)).otherwise(v).alias(k) for k, v in whole.items()])


def reading_order(boxes: DataFrame) -> DataFrame:
    """``boxes`` with pos from 0: by ord, nulls last, then id."""
    return boxes.withColumn("pos", F.row_number().over(page_window().orderBy(F.asc_nulls_last("ord"), "id")) - 1)


def renumber(boxes: DataFrame, *order) -> DataFrame:
    return boxes.withColumn("id", F.row_number().over(page_window().orderBy(*order)) - 1)


def cropped(boxes: DataFrame, pages: DataFrame, padding: float = 0.0) -> DataFrame:
    """``boxes`` with crop_x, crop_y, crop_w, crop_h within their page."""
    size = pages.select("page_id", "width", "height").dropDuplicates(["page_id"])
    return boxes.join(size, "page_id").withColumns(G.crop_rect(G.box(), F.col("width"), F.col("height"), padding)).drop("width", "height")


def _links(b: dict[str, Column], p: dict[str, Column], obstacle: Column) -> Column:
    """'center' for text that goes on in the next column, 'left' or 'right' for aligned text around an obstacle."""
    across = G.projection(b, p, True)
    wide, tall = F.greatest(p["x2"] - p["x1"], b["x2"] - b["x1"]), F.greatest(p["y2"] - p["y1"], b["y2"] - b["y1"])
    text = (b["label"] == "text") & (p["label"] == "text")
    cross = (across == 0) & (b["x1"] > p["x2"]) & (b["y1"] < p["y2"]) & (b["x1"] - p["x2"] < 0.3 * wide)
    one_edge = G.aligned(b["x1"], p["x1"]) != G.aligned(b["x2"], p["x2"])
    updown = (across > 0) & (b["y2"] >= p["y1"]) & (F.abs(b["y1"] - p["y2"]) < 0.5 * tall) & one_edge & obstacle
    return F.when(text & cross, "center").when(text & updown, G.alignment(b, p))


def linked(blocks: DataFrame, non_merge: list[str]) -> DataFrame:
    """``blocks`` with mergeable and link, the alignment by which a block joins the mergeable block before it (null: it
    doesn't)."""
    b = blocks.withColumn("mergeable", ~F.coalesce(F.col("label").isin(non_merge), F.lit(False)))
    sides = F.struct(*G.SIDES, "label")
    prev = F.last(F.when(F.col("mergeable"), sides), True).over(page_window().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    fixed = F.collect_list(F.when(~F.col("mergeable"), F.struct(*G.SIDES))).over(page_window())
    b = b.withColumn("__prev", prev).withColumn("__fixed", fixed)
    me, p = G.box() | {"label": F.col("label")}, {s: F.col("__prev")[s] for s in [*G.SIDES, "label"]}
    hull = {"x1": F.least(me["x1"], p["x1"]), "y1": F.least(me["y1"], p["y1"]), "x2": F.greatest(me["x2"], p["x2"]), "y2": F.greatest(me["y2"], p["y2"])}
    obstacle = F.exists("__fixed", lambda o: G.iou(hull, o) > 0)
    link = F.when(F.col("mergeable") & F.col("__prev").isNotNull(), _links(me, p, obstacle))
    return b.withColumn("link", link).drop("__prev", "__fixed")


def grouped(blocks: DataFrame, non_merge: list[str]) -> DataFrame:
    """``linked`` blocks with head: pos of the first block of the run of linked blocks; null for blocks that never merge."""
    b = linked(blocks, non_merge)
    start = F.when(F.col("mergeable") & F.col("link").isNull(), F.col("pos"))
    head = F.last(start, True).over(page_window().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("head", F.when(F.col("mergeable"), head))


def group_sizes(blocks: DataFrame) -> DataFrame:
    """``grouped`` blocks with max_w, sum_h and ratio of their group; the ratio is infinite for a group without width."""
    w = Window.partitionBy("page_id", "head")
    b = blocks.withColumns({"max_w": F.max("crop_w").over(w), "sum_h": F.sum("crop_h").over(w)})
    ratio = F.when(F.col("max_w") > 0, F.col("sum_h") / F.col("max_w")).otherwise(F.lit(float("inf")))
    own = F.col("head").isNotNull()
    return b.withColumns({"ratio": F.when(own, ratio), "max_w": F.when(own, F.col("max_w")), "sum_h": F.when(own, F.col("sum_h"))})


def emitted(blocks: DataFrame, non_merge: list[str], max_ratio: float = 3.0) -> DataFrame:
    """Blocks in output order (out_pos) with group_id and has_crop: groups together, blocks that stand within a group's
    span after it. A group as tall as ``max_ratio`` of its width is given up; of a kept group only the head has a crop."""
    g = group_sizes(grouped(blocks, non_merge))
    kept = F.col("head").isNotNull() & (F.col("ratio") < max_ratio)
    before = F.last(F.when(F.col("mergeable"), F.col("head")), True).over(page_window().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("__g", before).withColumn("__end", F.max("pos").over(Window.partitionBy("page_id", "head")))
    ends = F.last(F.when(F.col("mergeable"), F.col("__end")), True).over(page_window().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("__ge", ends)
    inside = ~F.col("mergeable") & (F.col("pos") <= F.col("__ge"))
    at = F.when(F.col("mergeable"), F.col("head")).when(inside, F.col("__g")).otherwise(F.col("pos"))
    late = F.when(F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    out = g.withColumns({"__at": at, "__late": late}).withColumn("out_pos", F.row_number().over(page_window().orderBy("__at", "__late", "pos")) - 1)
    out = out.withColumn("group_id", F.when(kept, F.col("head")))
    has = F.col("group_id").isNull() | (F.col("group_id") == F.col("pos"))
    return out.withColumn("has_crop", has).drop("__g", "__ge", "__end", "__at", "__late")


def stacked(groups: DataFrame) -> DataFrame:
    """page_id, head, i, pos, x_off, y_off, canvas_w, canvas_h: where each crop of a group lies on its white canvas."""
    rows = groups.where(F.col("head").isNotNull()).groupBy("page_id", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "crop_w", "crop_h", "link"))).alias("c"))
    state = F.struct(F.element_at("c", F.lit(1))["crop_w"].alias("w"), F.array(F.lit(0)).alias("x"))

    def step(s: Column, b: Column) -> Column:
        wide = F.greatest(s["w"], b["crop_w"])
        how = F.coalesce(b["link"], F.lit("center"))
        shift = lambda gap: F.when(how == "center", F.floor(gap / 2)).when(how == "right", gap).otherwise(0).cast("int")
        old, new = shift(wide - s["w"]), shift(wide - b["crop_w"])
        return F.struct(wide.alias("w"), F.concat(F.transform(s["x"], lambda x: x + old), F.array(new)).alias("x"))

    rows = rows.withColumn("s", F.aggregate(F.slice("c", F.lit(2), F.size("c")), state, step))
    out = rows.select("page_id", "head", F.col("s.w").alias("canvas_w"), F.posexplode(F.arrays_zip("c", F.col("s.x").alias("x"))).alias("i", "b"))
    w = Window.partitionBy("page_id", "head").orderBy("i")
    h = F.col("b.c.crop_h")
    out = out.withColumn("y_off", F.coalesce(F.sum(h).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    out = out.withColumn("canvas_h", F.sum(h).over(Window.partitionBy("page_id", "head")).cast("int"))
    return out.select("page_id", "head", "i", F.col("b.c.pos").alias("pos"), F.col("b.x").alias("x_off"), "y_off", "canvas_w", "canvas_h")

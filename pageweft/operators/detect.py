"""Detector heads in long form: logits to boxes, labels, scores and reading order.

``logits``: page_id, query, class, logit. ``boxes``: page_id, query, cx, cy, w, h in shares of the page. ``pair_logits``:
page_id, i, j, logit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(x: Column, eps: float = 1e-5) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.log(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))


def softmax(x: Column, window) -> Column:
    e = F.exp(x - F.max(x).over(window))
    return e / F.sum(e).over(window)


def top_detections(logits: DataFrame, n_classes: int, n_queries: int) -> DataFrame:
    """page_id, rank, query, label_id, score: the best ``n_queries`` of a page's (query, class) cells. Ties go to the
    smaller cell; a query may appear under several classes."""
    cell = F.col("query") * n_classes + F.col("class")
    w = Window.partitionBy("page_id").orderBy(F.desc("logit"), cell)
    top = logits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_queries)
    return top.select("page_id", (F.col("rank") - 1).alias("rank"), "query", F.col("class").alias("label_id"), sigmoid(F.col("logit")).alias("score"))


def gathered(top: DataFrame, boxes: DataFrame) -> DataFrame:
    """The boxes of the chosen queries; a query chosen twice keeps both rows."""
    return top.join(boxes, ["page_id", "query"])


def detection_order(boxes: DataFrame) -> DataFrame:
    """``boxes`` (page_id, rank, ord) with id from 0: by ord, nulls last, of equals the better rank first."""
    w = Window.partitionBy("page_id").orderBy(F.asc_nulls_last("ord"), "rank")
    return boxes.withColumn("id", F.row_number().over(w) - 1)


def top_anchors(logits: DataFrame, n: int) -> DataFrame:
    """page_id, rank, query: the ``n`` anchors of each page with the largest class logit; ties go to the smaller anchor."""
    w = Window.partitionBy("page_id").orderBy(F.desc("best"), "query")
    top = class_max(logits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.select("page_id", (F.col("rank") - 1).alias("rank"), "query")


def mean_pool(planes: DataFrame) -> DataFrame:
    """The mean of each channel's values (page_id, channel, value)."""
    return planes.groupBy("page_id", "channel").agg(F.avg("value").alias("mean"))


def class_max(logits: DataFrame) -> DataFrame:
    return logits.groupBy("page_id", "query").agg(F.max("logit").alias("best"))


def argmax(values: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """The index of the largest value of each key; of equals the last."""
    return values.groupBy(*keys).agg(F.max_by(index, F.struct(value, index)).alias(index), F.max(value).alias(value))


def to_pixels(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """x1 … y2 of centre-size boxes in shares of their page."""
    size = pages.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h")).dropDuplicates(["page_id"])
    b = boxes.join(size, "page_id")
    side = {"x1": ("cx", "w", -0.5, "__w"), "y1": ("cy", "h", -0.5, "__h"), "x2": ("cx", "w", 0.5, "__w"), "y2": ("cy", "h", 0.5, "__h")}
    return b.withColumns({k: (F.col(c) + F.col(s) * f) * F.col(e) for k, (c, s, f, e) in side.items()}).drop("__w", "__h")


def order_votes(pair_logits: DataFrame) -> DataFrame:
    """page_id, i, votes, ord: each later pair (i, j) votes for i to come first, and against j; most votes come first."""
    p = sigmoid(F.col("logit"))
    upper = pair_logits.where("i < j")
    votes = upper.select("page_id", "i", p.alias("v")).unionByName(upper.select("page_id", F.col("j").alias("i"), (1 - p).alias("v")))
    everyone = pair_logits.select("page_id", "i", F.lit(0.0).alias("v"))
    total = votes.unionByName(everyone).groupBy("page_id", "i").agg(F.sum("v").alias("votes"))
    w = Window.partitionBy("page_id").orderBy(F.desc(F.round("votes", 9)), "i")
    return total.withColumn("ord", F.row_number().over(w) - 1)


def mask_boxes(mask: DataFrame, width: int, height: int) -> DataFrame:
    """page_id, query, cx, cy, w, h of the set cells (logit > 0) of each mask in shares; zeros where none is set."""
    on = F.col("logit") > 0
    ends = mask.groupBy("page_id", "query").agg(
        F.min(F.when(on, F.col("x"))).alias("a"), (F.max(F.when(on, F.col("x"))) + 1).alias("b"), F.min(F.when(on, F.col("y"))).alias("c"), (F.max(F.when(on, F.col("y"))) + 1).alias("d")
    )
    share = lambda c: F.coalesce(c, F.lit(0.0))
    return ends.select(
        "page_id", "query", share((F.col("a") + F.col("b")) / (2.0 * width)).alias("cx"), share((F.col("c") + F.col("d")) / (2.0 * height)).alias("cy"),
        share((F.col("b") - F.col("a")) / (1.0 * width)).alias("w"), share((F.col("d") - F.col("c")) / (1.0 * height)).alias("h"),
    )


def anchors(spark, levels: list[tuple[int, int]], eps: float = 0.01) -> DataFrame:
    """level, y, x, cx, cy, valid: grid centres of the feature levels; valid within (eps, 1 - eps) on both axes."""
    out = None
    for k, (h, w) in enumerate(levels):
        rows = spark.range(h * w).select(
            F.lit(k).alias("level"), F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"),
            ((F.col("id") % w + 0.5) / w).alias("cx"), ((F.floor(F.col("id") / w) + 0.5) / h).alias("cy"),
        )
        out = rows if out is None else out.unionByName(rows)
    inside = lambda c: (F.col(c) > eps) & (F.col(c) < 1 - eps)
    return out.withColumn("valid", inside("cx") & inside("cy"))

"""Clean-up of detected boxes: suppression, containment, overlap. All work page by page, on at most a few hundred boxes.

Boxes are rows of page_id, id, ord, label, score, x1, y1, x2, y2; ids are unique within a page. ``page_boxes`` gathers
them once, so that a whole chain of steps costs one shuffle on page_id; the row forms below it are for single steps.
Null scores sort last. A null or unknown label is a label like any other. Pages without boxes don't appear.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L

BOX = ["id", "ord", "label", "score", "x1", "y1", "x2", "y2"]
TINY, INLINE_OVERLAP, DROP_OVERLAP = 6.0, 0.5, 0.7


def first_delivery(detections: DataFrame) -> DataFrame:
    """One row for each (page_id, id), however often a box was delivered."""
    return detections.dropDuplicates(["page_id", "id"])


def page_boxes(boxes: DataFrame, order: str = "id") -> DataFrame:
    """page_id, boxes: each page's boxes by ``order``: 'id', or 'score' (descending, then id)."""
    first = [F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("k")] if order == "score" else []
    rows = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(*first, *BOX))).alias("boxes"))
    return rows.withColumn("boxes", F.transform("boxes", lambda b: F.struct(*[b[c].alias(c) for c in BOX])))


def applied(pages: DataFrame, *steps) -> DataFrame:
    """``pages`` with boxes put through the steps (column to column), each evaluated once for each page: without the
    Generate between them the optimizer would copy a step's whole expression into every use by the next."""
    for step in steps:
        pages = pages.select(*[c for c in pages.columns if c != "boxes"], F.explode(F.array(step(F.col("boxes")))).alias("boxes"))
    return pages


def nms(boxes: Column, threshold: float = 0.5) -> Column:
    """The boxes that survive, in visit order and renumbered: the first is taken, the last takes its place, and whatever
    overlaps the taken one by ``threshold`` or more is dropped, until none is left. ``boxes`` must be sorted by score."""
    empty = F.slice(boxes, F.lit(1), F.lit(0))
    start = F.struct(boxes.alias("left"), empty.alias("kept"))

    def step(s: Column, _: Column) -> Column:
        left = s["left"]
        head = F.element_at(left, F.lit(1))
        rest = F.when(F.size(left) > 2, F.concat(F.slice(left, F.lit(-1), F.lit(1)), F.slice(left, F.lit(2), F.greatest(F.size(left) - 2, F.lit(0))))).otherwise(
            F.slice(left, F.lit(2), F.lit(1))
        )
        taken = F.struct(F.filter(rest, lambda b: G.iou(head, b) < threshold).alias("left"), F.concat(s["kept"], F.array(head)).alias("kept"))
        return F.when(F.size(left) > 0, taken).otherwise(s)

    kept = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(boxes), F.lit(1))), start, step)["kept"]
    return renumbered(kept)


def renumbered(boxes: Column) -> Column:
    return F.transform(boxes, lambda b, i: F.struct(i.alias("id"), *[b[c].alias(c) for c in BOX[1:]]))


def swallowed(inner: Column, outer: Column) -> Column:
    """Whether ``outer`` is of a kind that absorbs ``inner``; a formula only yields to a formula."""
    formula = (inner["label"] == "formula") & (outer["label"] != "formula")
    return outer["label"].isin(L.LARGE_LABELS) & ~F.coalesce(formula, F.lit(False)) & G.contained(inner, outer)


def without_contained(boxes: Column) -> Column:
    """The boxes that no other box of the page absorbs, judged against all boxes of the page at once."""
    return F.filter(boxes, lambda b: ~F.exists(boxes, lambda o: (o["id"] != b["id"]) & F.coalesce(swallowed(b, o), F.lit(False))))


def unclip(boxes: Column, ratio: float, width: Column, height: Column) -> Column:
    """The boxes scaled about their centres and clamped to the page; unchanged for ratio 1."""
    if ratio == 1.0:
        return boxes

    def one(b: Column) -> Column:
        c = G.clamped(G.unclipped(b, ratio), width, height)
        return F.struct(*[b[k].alias(k) for k in BOX[:4]], *[c[k].alias(k) for k in BOX[4:]])

    return F.transform(boxes, one)


def without_references(boxes: Column) -> Column:
    return F.filter(boxes, lambda b: F.coalesce(b["label"] != "reference", F.lit(True)))


def overlap_filter(pages: DataFrame) -> DataFrame:
    """Drops references, tiny boxes and the smaller of two that overlap, in the given order. A tiny box may still drop a
    later one before it, and two inline formulas that overlap both go."""
    return applied(pages, without_references, _measured, _with_clashes, _without_losers)


def _measured(boxes: Column) -> Column:
    """The boxes with what the overlap rules ask of each."""
    is_ = lambda test: F.coalesce(test, F.lit(False))
    return F.transform(boxes, lambda b, i: F.struct(
        (i + 1).alias("i"), b.alias("box"), G.area(b).alias("area"), is_(b["label"] == "inline_formula").alias("inline"), is_(b["label"].isin(L.OVERLAP_EXEMPT)).alias("exempt"),
        ((b["x2"] - b["x1"] < TINY) | (b["y2"] - b["y1"] < TINY)).alias("tiny"),
    ))


def _with_clashes(boxes: Column) -> Column:
    """The boxes beside what may drop them, in order: a tiny box itself (j = 0), and pairs i < j that overlap too much.
    lose_i, lose_j: whom it drops."""
    n = F.size(boxes)

    def against(a: Column) -> Column:
        later = F.slice(boxes, a["i"] + 1, n)
        near = F.filter(later, lambda b: G.intersection(a["box"], b["box"]) > F.least(a["area"], b["area"]) * INLINE_OVERLAP)
        near = F.filter(near, lambda b: F.when(a["inline"] | b["inline"], G.iomin(a["box"], b["box"]) > INLINE_OVERLAP).otherwise(
            (G.iomin(a["box"], b["box"]) > DROP_OVERLAP) & ~F.coalesce((a["box"]["label"] != b["box"]["label"]) & a["exempt"] & b["exempt"], F.lit(False))
        ))
        pairs = F.transform(near, lambda b: F.struct(
            a["i"].alias("i"), b["i"].alias("j"), F.when(a["inline"] | b["inline"], a["inline"]).otherwise(a["area"] < b["area"]).alias("lose_i"),
            F.when(a["inline"] | b["inline"], b["inline"]).otherwise(a["area"] >= b["area"]).alias("lose_j"),
        ))
        own = F.array(F.struct(a["i"].alias("i"), F.lit(0).alias("j"), F.lit(True).alias("lose_i"), F.lit(False).alias("lose_j")))
        return F.when(a["tiny"], F.concat(own, pairs)).otherwise(pairs)

    return F.struct(boxes.alias("b"), F.flatten(F.transform(boxes, against)).alias("clashes"))


def _without_losers(state: Column) -> Column:
    """The boxes that are left when each clash in turn, unless one of its boxes is gone, drops whom it drops."""

    def step(gone: Column, e: Column) -> Column:
        lost = F.concat(F.when(e["lose_i"], F.array(e["i"])).otherwise(none), F.when(e["lose_j"], F.array(e["j"])).otherwise(none))
        return F.when((e["j"] > 0) & (F.array_contains(gone, e["i"]) | F.array_contains(gone, e["j"])), gone).otherwise(F.concat(gone, lost))

    none = F.array().cast("array<int>")
    gone = F.aggregate(state["clashes"], none, step)
    return F.transform(F.filter(state["b"], lambda b: ~F.array_contains(gone, b["i"])), lambda b: b["box"])


def rows(pages: DataFrame) -> DataFrame:
    """One row for each box again, with its place as ``pos``."""
    out = pages.select(*[c for c in pages.columns if c != "boxes"], F.posexplode("boxes").alias("pos", "b"))
    return out.select("*", *[F.col("b")[c].alias(c) for c in BOX]).drop("b")


def pairs(boxes: DataFrame, measure, least: float, strict: bool = False) -> DataFrame:
    """page_id, id_a, id_b, value: pairs of a page's boxes (id_a < id_b) whose ``measure`` reaches ``least``."""
    a, b = boxes.alias("a"), boxes.alias("b")
    side = lambda t: {s: F.col(f"{t}.{s}") for s in G.SIDES}
    value = measure(side("a"), side("b"))
    out = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.id") < F.col("b.id")))
    out = out.select(F.col("a.page_id").alias("page_id"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), value.alias("value"))
    return out.where(F.col("value") > least if strict else F.col("value") >= least)


def contained_rows(boxes: DataFrame) -> DataFrame:
    """The row form of ``without_contained``: an anti join on the page."""
    i, j = boxes.alias("i"), boxes.alias("j")
    side = lambda t: {s: F.col(f"{t}.{s}") for s in [*G.SIDES, "label"]}
    on = (F.col("i.page_id") == F.col("j.page_id")) & (F.col("i.id") != F.col("j.id")) & F.coalesce(swallowed(side("i"), side("j")), F.lit(False))
    return i.join(j, on, "left_anti")


def contained_by_mode(boxes: DataFrame, mode_of) -> DataFrame:
    """The general form: ``mode_of`` maps a label column to 'large', 'small' or 'union'. A large label's boxes absorb
    what they contain; of a small label's boxes, those that lie within another do so to the box around them."""
    i, j = boxes.alias("i"), boxes.alias("j")
    side = lambda t: {s: F.col(f"{t}.{s}") for s in [*G.SIDES, "label"]}
    a, b = side("i"), side("j")
    formula = F.coalesce((a["label"] == "formula") & (b["label"] != "formula"), F.lit(False))
    hit = i.join(j, (F.col("i.page_id") == F.col("j.page_id")) & (F.col("i.id") != F.col("j.id")) & ~formula & G.contained(a, b))
    hit = hit.select(F.col("i.page_id").alias("page_id"), F.col("i.id").alias("inner"), F.col("j.id").alias("outer"), a["label"].alias("li"), b["label"].alias("lj"))
    large = hit.where(mode_of(F.col("lj")) == "large").select("page_id", F.col("inner").alias("id"))
    small = hit.where(mode_of(F.col("li")) == "small")
    within = small.select("page_id", F.col("inner").alias("id"), F.col("li").alias("cat"))
    around = small.select("page_id", F.col("outer").alias("id"), F.col("li").alias("cat")).join(within, ["page_id", "id", "cat"], "left_anti")
    gone = large.unionByName(around.select("page_id", "id")).distinct()
    return boxes.join(gone, ["page_id", "id"], "left_anti")

"""Token sequences in long form (seq_id, pos, token): spans, positions in three dimensions, injection, decoding rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def in_sequence():
    return Window.partitionBy("seq_id").orderBy("pos")



def spans(tokens: DataFrame, token: int) -> DataFrame:
    """seq_id, span, start, stop (exclusive): runs of ``token``."""
    hits = tokens.where(F.col("token") == token)
    runs = hits.withColumn("g", F.col("pos") - F.row_number().over(in_sequence()))
    ends = runs.groupBy("seq_id", "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"))
    span = F.row_number().over(Window.partitionBy("seq_id").orderBy("start")) - 1
    return ends.select("seq_id", span.alias("span"), "start", "stop")


def positions(tokens: DataFrame, grids: DataFrame, token: int, step: float = 0.0, first_only: bool = False) -> DataFrame:
    """seq_id, pos, t, h, w, status of each token: text counts on in all three; the k-th span of ``token`` takes the
    rows and columns of its grid (seq_id, span, grid_t, grid_h, grid_w) from where the text stopped, and frames that
    advance by ``step``; text goes on after the largest position used. status is 'mismatch' for a sequence whose spans
    and grids differ in number or size, and its positions are null. ``first_only``, as for a video: only the first span of
    a sequence has a grid, and later placeholders count as text."""
    found = spans(tokens, token)
    if first_only:
        found, grids = found.where("span = 0"), grids.where("span = 0")
    sp = found.join(grids, ["seq_id", "span"], "full")
    size = F.col("grid_t") * F.col("grid_h") * F.col("grid_w")
    bad = sp.where(F.coalesce(F.col("stop") - F.col("start") != size, F.lit(True))).select("seq_id").distinct()
    frame = lambda t: F.floor(t * step).cast("int")
    reach = F.greatest(frame(F.col("grid_t") - 1), F.col("grid_h") - 1, F.col("grid_w") - 1) + 1
    sp = sp.select("seq_id", "start", "stop", "grid_h", "grid_w", reach.alias("reach"))
    at = tokens.join(sp, (tokens["seq_id"] == sp["seq_id"]) & (tokens["pos"] == sp["start"]), "left").select(tokens["seq_id"], "pos", "token", "start", "stop", "grid_h", "grid_w", "reach")
    past = in_sequence().rowsBetween(Window.unboundedPreceding, -1)
    now = in_sequence().rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("inside", (F.col("token") == token) & (F.col("pos") < F.coalesce(F.last("stop", True).over(now), F.lit(0 if first_only else 1 << 62))))
    text = F.when(F.col("inside"), 0).otherwise(1)
    base = F.coalesce(F.sum(text + F.coalesce(F.col("reach"), F.lit(0))).over(past), F.lit(0))
    rows = at.withColumn("base", base).withColumn("g", F.last(F.when(F.col("start").isNotNull(), F.struct("start", "grid_h", "grid_w", "base")), True).over(now))
    k = F.col("pos") - F.col("g.start")
    cell, vision = F.col("g.grid_h") * F.col("g.grid_w"), F.col("inside")
    t = F.col("g.base") + frame(F.floor(k / cell))
    h = F.col("g.base") + F.floor((k % cell) / F.col("g.grid_w"))
    w = F.col("g.base") + (k % cell) % F.col("g.grid_w")
    out = rows.select("seq_id", "pos", *[F.when(vision, v).otherwise(F.col("base")).cast("int").alias(n) for n, v in (("t", t), ("h", h), ("w", w))])
    bad = bad.withColumn("status", F.lit("mismatch"))
    out = out.join(bad, "seq_id", "left").withColumn("status", F.coalesce("status", F.lit("ok")))
    ok = F.col("status") == "ok"
    return out.select("seq_id", "pos", *[F.when(ok, F.col(c)).alias(c) for c in ("t", "h", "w")], "status")


def position_delta(pos: DataFrame) -> DataFrame:
    """seq_id, delta: largest position + 1 - length of the sequence."""
    return pos.groupBy("seq_id").agg((F.max(F.greatest("t", "h", "w")) + 1 - F.count("*")).alias("delta"))


def injected(tokens: DataFrame, vision: DataFrame, token: int) -> DataFrame:
    """seq_id, pos, value, status: each placeholder's value replaced by the next of its sequence's vision rows (seq_id, k,
    value). status is 'mismatch' where their numbers differ; the values are then left alone."""
    n = F.sum(F.when(F.col("token") == token, 1).otherwise(0))
    held = tokens.withColumn("k", F.when(F.col("token") == token, n.over(in_sequence()) - 1)).withColumn("want", n.over(Window.partitionBy("seq_id")))
    have = vision.groupBy("seq_id").agg(F.count("*").alias("have"))
    rows = held.join(vision.withColumnRenamed("value", "new"), ["seq_id", "k"], "left").join(have, "seq_id", "left")
    ok = F.col("want") == F.coalesce("have", F.lit(0))
    return rows.select("seq_id", "pos", F.when(ok & F.col("k").isNotNull(), F.col("new")).otherwise(F.col("value")).alias("value"), F.when(ok, "ok").otherwise("mismatch").alias("status"))


def cumulative_lengths(grids: DataFrame) -> DataFrame:
    """i, length: running sums of grid_h * grid_w, one for each frame of each grid in order of ``k``, after a leading 0."""
    frames = grids.select("seq_id", "k", (F.col("grid_h") * F.col("grid_w")).alias("n"), F.explode(F.sequence(F.lit(1), F.col("grid_t"))).alias("f"))
    w = Window.partitionBy("seq_id").orderBy("k", "f")
    rows = frames.select("seq_id", F.row_number().over(w).alias("i"), F.sum("n").over(w).alias("length"))
    return rows.unionByName(grids.select("seq_id", F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("length")).distinct())


def penalised(logits: DataFrame, generated: DataFrame, penalty: float = 1.1) -> DataFrame:
    """Logits of tokens already generated, once for each time: divided by the penalty above 0, else multiplied by it."""
    n = generated.groupBy("seq_id", "token").agg(F.count("*").alias("n"))
    f = F.pow(F.lit(penalty), F.coalesce("n", F.lit(0)))
    return logits.join(n, ["seq_id", "token"], "left").select("seq_id", "token", F.when(F.col("logit") > 0, F.col("logit") / f).otherwise(F.col("logit") * f).alias("logit"))


def decoded(tokens: DataFrame, eos: int, max_new: int) -> DataFrame:
    """The tokens before the first end token, at most ``max_new`` of them; a limit of 0 still lets one through."""
    end = F.coalesce(F.max(F.when(F.col("token") == eos, 1).otherwise(0)).over(in_sequence()), F.lit(0))
    rows = tokens.withColumn("__end", end).where("__end = 0").withColumn("__i", F.row_number().over(in_sequence()))
    return rows.where(F.col("__i") <= max(max_new, 1)).drop("__end", "__i")


def token_limit(asked: Column, model_limit: int) -> Column:
    """How many tokens may be generated: what was asked for, as far as the model's own limit goes."""
    return F.least(asked, F.lit(model_limit))


def ids_before_end(ids: Column, eos: int) -> Column:
    """The ids before the first end token; all where there is none."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def trimmed(text: Column) -> Column:
    """The text without white space, of any kind, at either end."""
    return F.regexp_replace(text, r"^[\p{IsWhite_Space}]+|[\p{IsWhite_Space}]+$", "")


def count_check(tokens: DataFrame, grids: DataFrame, token: int) -> DataFrame:
    """seq_id, n_tokens, n_grid, n_spans, n_grids, status: placeholders against the cells of the grids (seq_id, span,
    grid_t, grid_h, grid_w); 'mismatch' where a sequence's totals or any of its spans differ."""
    cells = F.col("grid_t") * F.col("grid_h") * F.col("grid_w")
    both = spans(tokens, token).join(grids.select("seq_id", "span", cells.alias("cells")), ["seq_id", "span"], "full")
    n = F.col("stop") - F.col("start")
    bad = F.max(F.when(n == F.col("cells"), 0).otherwise(1))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy("seq_id").agg(
        none(n).alias("n_tokens"), none(F.col("cells")).alias("n_grid"), F.count("stop").alias("n_spans"), F.count("cells").alias("n_grids"), F.when(bad == 0, "ok").otherwise("mismatch").alias("status")
    )


def online_softmax(parts: DataFrame) -> DataFrame:
    """seq_id, value: softmax-weighted sum merged from tiles (m: maximum, s: sum of exp(x - m), o: weighted sum)."""
    top = F.max("m").over(Window.partitionBy("seq_id"))
    scaled = parts.withColumn("f", F.exp(F.col("m") - top))
    return scaled.groupBy("seq_id").agg((F.sum(F.col("o") * F.col("f")) / F.sum(F.col("s") * F.col("f"))).alias("value"))


def smart_resize(h: Column, w: Column, factor: int = 28, low: int = 112_896, high: int = 1_003_520) -> Column:
    """Struct of height, width (multiples of ``factor`` whose product lies within the bounds) and status; sides that
    differ more than 200 to 1, or aren't positive, give nulls."""
    h, w = h.cast("double"), w.cast("double")
    whole = lambda x: F.floor(x + 0.5)
    w1, h1 = F.when(h < factor, whole(w * factor / F.when(h > 0, h))).otherwise(w), F.greatest(h, F.lit(float(factor)))
    h2, w2 = F.when(w1 < factor, whole(h1 * factor / F.when(w1 > 0, w1))).otherwise(h1), F.greatest(w1, F.lit(float(factor)))
    long, short = F.greatest(h2, w2), F.least(h2, w2)
    ok = (h > 0) & (w > 0) & (long / short <= 200)
    rh, rw = whole(h2 / factor) * factor, whole(w2 / factor) * factor
    area = h2 * w2
    shrink, grow = F.sqrt(area / high), F.sqrt(low / area)
    pick = lambda r, side: F.when(rh * rw > high, F.floor(side / shrink / factor) * factor).when(rh * rw < low, F.ceil(side * grow / factor) * factor).otherwise(r)
    out = lambda r, side: F.when(ok, F.greatest(pick(r, side), F.lit(factor))).cast("int")
    return F.struct(out(rh, h2).alias("height"), out(rw, w2).alias("width"), F.when(ok, "ok").otherwise("invalid_aspect").alias("status"))


def grid(height: Column, width: Column) -> Column:
    gh, gw = (height / 14).cast("int"), (width / 14).cast("int")
    return F.struct(F.lit(1).alias("t"), gh.alias("h"), gw.alias("w"), ((gh / 2).cast("int") * (gw / 2).cast("int")).alias("n_tokens"))


def prompt_text(prompt: Column, n_tokens: Column) -> Column:
    return F.concat(F.lit("<|begin_of_sentence|>User: <|IMAGE_START|>"), F.repeat(F.lit("<|IMAGE_PLACEHOLDER|>"), n_tokens), F.lit("<|IMAGE_END|>"), prompt, F.lit("\nAssistant:\n"))


def make_divisible(v: Column, divisor: int) -> Column:
    d = max(divisor, 1)
    near = F.greatest(F.floor((v + d / 2) / d) * d, F.lit(d))
    return F.when(near < 0.9 * v, near + d).otherwise(near).cast("int")


def reflect(i: Column, n: int) -> Column:
    """The index within 0 … n-1 that ``i`` mirrors into, the edges not repeated."""
    if n == 1:
        return F.lit(0)
    r = F.pmod(i, F.lit(2 * (n - 1)))
    return F.when(r < n, r).otherwise(2 * (n - 1) - r).cast("int")

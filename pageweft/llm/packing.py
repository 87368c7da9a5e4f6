"""Problem 7: texts into containers of fixed capacity, with little room left.

Partitions of bounded size are packed by best-fit decreasing. Lower bounds from dual feasible functions certify a
partition whose number of containers can't be lowered; the others, and the containers with gaps of certified ones,
exchange their texts in fewer and larger pools, which are packed again as long as that saves containers; a pool keeps
what it had where packing again would need more. A text is split only where it alone exceeds the capacity: into full
pieces, which need a container each, and a rest.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import tokens

#: Items packed in one task at first; how often that may double from round to round; the share of its capacity that a
#: container of a certified partition may leave empty without being packed again.
ITEMS_PER_PARTITION, DOUBLINGS, GAP = 50_000, 3, 0.02

_COUNTERS: dict[str, object] = {}


def counter(name: str, folder: str | None = None):
    """A function from texts to their numbers of tokens by the public tokenizer ``name``, kept by the Python worker."""
    key = f"{folder}/{name}"
    if key not in _COUNTERS:
        find = lambda end: f"{folder}/{name}{end}" if folder else tokens.tokenizer_path(name + end)
        if os.path.exists(find(".tiktoken")):
            enc = tokens.bpe(find(".tiktoken"))
            _COUNTERS[key] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
        elif os.path.exists(find(".model")):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=find(".model"))
            _COUNTERS[key] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(find(".json"))
            t.encode_special_tokens = True
            _COUNTERS[key] = lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    return _COUNTERS[key]


def sizes(docs: DataFrame, names: list[str], id_col: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """id, tokenizer, size: tokens of each document by each of the tokenizers; a null text has none."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for name in names:
                n = [k for i in range(0, len(texts), 500) for k in counter(name, folder)(texts[i : i + 500])]
                yield pa.record_batch([b.column(0), pa.array([name] * len(n)), pa.array(n, pa.int32())], names=["id", "tokenizer", "size"])

    return docs.select(F.col(id_col).alias("id"), text).mapInArrow(run, "id long, tokenizer string, size int")


def pieces(sized: DataFrame, containers: DataFrame) -> DataFrame:
    """container_id, capacity, id, piece, size: what has to be placed. Only a text beyond the capacity has more than one
    piece."""
    rows = sized.join(F.broadcast(containers.select("container_id", "tokenizer", "capacity")), "tokenizer")  # a fixed list
    n = F.greatest(F.ceil(F.col("size") / F.col("capacity")).cast("int"), F.lit(1))
    rows = rows.select("container_id", "capacity", "id", F.col("size").alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    rest = F.col("whole") - F.col("piece") * F.col("capacity")
    return rows.select("container_id", "capacity", "id", "piece", F.least(rest, F.col("capacity")).cast("int").alias("size"))


def best_fit_decreasing(size: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; ``size`` must be in descending order."""
    out = np.zeros(len(size), int)
    rooms: list[int] = []  # different amounts of room, ascending
    having: dict[int, list[int]] = {}
    n = 0
    for i, s in enumerate(size.tolist()):
        at = bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            bins = having[room]
            b = bins.pop()
            if not bins:
                del having[room]
                rooms.pop(at)
        else:
            b, room = n, capacity
            n += 1
        out[i] = b
        left = room - s
        if left not in having:
            having[left] = []
            insort(rooms, left)
        having[left].append(b)
    return out


def lower_bound(size: np.ndarray, capacity: int) -> int:
    """No packing needs fewer containers: the best of the total size and of two families of dual feasible functions."""
    size = size[size > 0]
    if not len(size):
        return 0
    best = -(-int(size.sum()) // capacity)
    n = np.bincount(size, minlength=capacity + 1)
    many, weight = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(capacity + 1))])
    k = np.flatnonzero(n[: capacity // 2 + 1])
    if len(k):  # items above capacity - k fill a container, those below k are left out
        big = many[-1] - many[capacity - k + 1]
        middle = weight[capacity - k + 1] - weight[k]
        best = max(best, int((big + -(-middle // capacity)).max()))
    x = np.arange(capacity + 1)
    for m in range(1, 21):  # rounding to m-ths
        y = (m + 1) * x
        f = np.where(y % capacity == 0, x * m, (y // capacity) * capacity)
        best = max(best, -(-int((n * f).sum()) // (m * capacity)))
    return best


def _pack(round_no: int):
    def run(key, t):
        import pyarrow as pa

        size, capacity = t.column("size").to_numpy(), t.column("capacity")[0].as_py()
        order = np.lexsort((t.column("piece").to_numpy(), t.column("id").to_numpy(), -size))
        t, size = t.take(pa.array(order)), size[order]
        bins = best_fit_decreasing(size, capacity)
        part, before = key[1].as_py(), t.column("bin").to_pylist()
        names = [f"{round_no}-{part}-{b}" for b in bins]
        if before[0] is not None and bins.max() + 1 > len(set(before)):  # what there was is better
            names = before
            bins = np.unique(before, return_inverse=True)[1]
        fill = np.bincount(bins, weights=size).astype(int)
        bound = max(lower_bound(size, capacity), 1)
        same = lambda x, kind: pa.array([x] * len(bins), kind)
        out = t.select(["container_id", "capacity", "id", "piece", "size"]).append_column("bin", pa.array(names))
        out = out.append_column("room", pa.array((capacity - fill[bins]).astype("int32"))).append_column("certified", same(len(fill) <= bound, pa.bool_()))
        return out.append_column("pool", same(f"{round_no}-{part}", pa.string())).append_column("pool_bins", same(len(fill), pa.int32())).append_column("pool_bound", same(bound, pa.int32()))

    return run


_PACKED = "container_id int, capacity int, id long, piece int, size int, bin string, room int, certified boolean, pool string, pool_bins int, pool_bound int"


def fill(items: DataFrame, per_partition: int = ITEMS_PER_PARTITION) -> DataFrame:
    """container_id, capacity, id, piece, size, bin, room, certified, pool, pool_bins, pool_bound: each item in a container
    (bin) of its kind, with the pool in which it was packed last, the containers that this pool took, and the fewest that
    any packing of the pool can take; certified where the two are equal.

    Ids repeated whole count once; items of size 0 go where they fit. An empty input has an empty result."""
    left = items.dropDuplicates(["container_id", "id", "piece"]).withColumn("bin", F.lit(None).cast("string"))
    left = materialize(left.select("container_id", "capacity", "id", "piece", "size", "bin"), "items")
    done, round_no = None, 0
    while True:
        counts = left.groupBy("container_id").agg(F.count("*").alias("n"), F.countDistinct("bin").alias("bins")).collect()  # kinds are few
        if not counts:
            break
        parts = {r["container_id"]: -(-r["n"] // (per_partition << min(round_no, DOUBLINGS))) for r in counts}
        share = F.create_map(*[x for c, p in parts.items() for x in (F.lit(c), F.lit(p))])
        # what shares a container stays together, so that a pool knows what it had
        own = F.coalesce(F.xxhash64("bin", F.lit(round_no)), F.xxhash64("id", "piece")) if round_no else F.xxhash64("id", "piece")
        part = F.pmod(own, share[F.col("container_id")]).cast("int")
        packed = materialize(left.withColumn("part", part).groupBy("container_id", "part").applyInArrow(_pack(round_no), _PACKED), "packed")
        now = {r["container_id"]: r["bins"] for r in packed.groupBy("container_id").agg(F.countDistinct("bin").alias("bins")).collect()}
        # pools of one partition have nobody left to exchange with; other kinds go on while that saves containers
        alone = [r["container_id"] for r in counts if parts[r["container_id"]] == 1 or round_no and now[r["container_id"]] >= r["bins"]]
        settled = (F.col("certified") & (F.col("room") <= GAP * F.col("capacity"))) | F.col("container_id").isin(alone)
        fixed = packed.where(settled)
        done = fixed if done is None else done.unionByName(fixed)
        left = packed.where(~settled).select(left.columns)
        round_no += 1
    return done if done is not None else items.sparkSession.createDataFrame([], _PACKED)


def report(filled: DataFrame) -> DataFrame:
    """For each kind of container: items, tokens, containers used, share filled, the least that the total size allows, and
    of the pools that were packed last their number, the certified ones, and the containers beyond the bounds of the
    others."""
    bins = filled.groupBy("container_id", "capacity", "pool", "pool_bins", "pool_bound", "bin").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"))
    pools = bins.groupBy("container_id", "capacity", "pool", "pool_bins", "pool_bound").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count("*").alias("bins"))
    over = F.col("pool_bins") - F.col("pool_bound")
    out = pools.groupBy("container_id", "capacity").agg(
        F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.sum("bins").alias("n_bins"),
        F.count("*").alias("n_pools"), F.count(F.when(over == 0, 1)).alias("n_certified"), F.sum(over).cast("long").alias("beyond_bounds"),
    )
    out = out.withColumn("least_bins", F.ceil(F.col("n_tokens") / F.col("capacity")))
    return out.withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity")), 6))

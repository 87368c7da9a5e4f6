"""Problem 2: texts that lost their end, and how often each source cuts.

Word trigrams are counted inside texts and at text ends over the distinct texts of the whole table, with built-in expressions only. A text is
cut when its final trigram is frequent inside texts yet almost never ends one, when its last word leaves a frequent word
pair unfinished, when prose stops without a sentence end at words that end no other text, when a limit shows (its source's lengths pile up at a maximum in characters or bytes, or the recogniser
stopped at the instance's max_tokens), when a cut mark follows an unfinished sentence, when table markup is left open, or
when the short last row of a table aligned by blanks ends within a cell that other tables have whole. A text that the next prose block of the page carries on is not cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import quality

# Marks that replace a missing end.
CUT_MARK = r"\s*(?:(?:…|\.{3})+|\[more\]|\[\.{3}\]|\[…\]|\(more\))$"
ENDED = r"[.!?。？！:：．…)\]>|][\"'”’»]*\s*$"
TITLE_LINE = r"(?s)^(.*[.!?。？！:：．][\"'”’»)\]]*\s*\n)(?:[^\n\p{Ll}]{8,}|[^\n]{3,80} [|—] [^\n]{3,80})$"
LAST_LINE = r"^(?:[\s\-–—\[(]*(?:\p{L}{1,7}\.?\s+)?(?:[0-9]{1,4}|[ivxlc]{1,8})(?:\s*[/(]\s*[0-9]{1,4}\s*\)?)?[\s\-–—\])]*|[^\p{Ll}]{8,}|.{3,80} [|—] .{3,80})$"
PAGE_LINE = r"\n[\s\-–—\[(]*(?:\p{L}{1,7}\.?\s+)?(?:[0-9]{1,4}|[ivxlc]{1,8})(?:\s*[/(]\s*[0-9]{1,4}\s*\)?)?[\s\-–—\])]*$"

#: A trigram inside texts this often is frequent; a pair needs more, as its third word is open.
MIN_INSIDE, MIN_PAIR = 3, 10
#: The share of a trigram's or pair's places that may be ends if ends count as almost never.
END_SHARE = 0.03
#: The share of a pair's places at which texts may break off with the same third word, which a running title exceeds; and
#: how many may anyway.
BREAK_SHARE, BREAKS = 0.01, 2
#: Characters at a text's end that are searched for marks and page leftovers.
WINDOW = 240
#: Bits for each key in a map of asked keys, and the least and the most that a map may have: 128 KiB and 8 MiB.
BITS_PER_KEY, MIN_BITS, MAX_BITS = 32, 1 << 20, 1 << 26
#: A length limit shows when its pile is this many texts and this many times the usual count of a length below it.
PILE, PILE_RATIO = 5, 8.0


def _with_words(df: DataFrame, name: str, text: Column) -> DataFrame:
    """``df`` with an array of tokens between blanks, digits folded; each Han character is one. Null text has none."""
    flat = F.translate(text, "123456789\n\t", "000000000  ")
    df = quality.fence(df, "__flat", {"t": flat})
    t = F.col("__flat.t")
    df = quality.fence(df, "__flat", {"t": F.when(t.contains("00"), F.regexp_replace(t, "00+", "0")).otherwise(t)}, replace=True)
    spaced = F.regexp_replace(t, r" *([\p{IsHan}，。？！；：、]) *", " $1 ")
    words = F.when(t.rlike(r"\p{IsHan}"), F.array_remove(F.split(spaced, " "), "")).otherwise(F.split(t, " "))
    return quality.fence(df, "__words", {"w": words}).withColumn(name, F.col("__words.w")).drop("__flat", "__words")


def _with_core(df: DataFrame, name: str, text: Column) -> DataFrame:
    """``df`` with the text less a page number line, a running title and a cut mark at its end. Only the last characters
    are searched for them."""
    size = F.greatest(F.length(text) - WINDOW, F.lit(0))
    df = quality.fence(df, "__cut", {"start": F.substring(text, F.lit(1), size), "end": F.substring(text, size + 1, F.lit(WINDOW))})
    start, end = F.col("__cut.start"), F.col("__cut.end")
    last = F.substring_index(F.rtrim(end, F.lit(" \n\t\r")), "\n", -1)
    body = F.when(end.contains("\n") & last.rlike(LAST_LINE), F.regexp_replace(F.regexp_replace(end, PAGE_LINE, ""), TITLE_LINE, "$1")).otherwise(end)
    df = quality.fence(df, "__cut", {"start": start, "end": body}, replace=True)
    mark = F.length(F.regexp_extract(F.substring(end, F.greatest(F.length(end) - 16, F.lit(0)) + 1, F.lit(17)), CUT_MARK, 0))
    whole = F.concat(start, F.rtrim(F.substring(end, F.lit(1), F.length(end) - mark)))
    return quality.fence(df, "__core", {"t": whole}).withColumn(name, F.col("__core.t")).drop("__cut", "__core")


def trigram_counts(texts: DataFrame, text: str, asked: DataFrame | None = None) -> DataFrame:
    """key, inside, at_end: counts of trigrams and of their first pairs over all ``texts``, by hash.

    With ``asked`` (a column key) only keys that fall on a bit of theirs are counted: the map spares the shuffle of keys
    that nobody asks for and changes no count of the asked ones."""
    rows = _with_core(texts.select(F.col(text).alias("t")), "t", F.col("t"))
    rows = _with_words(rows, "w", F.col("t")).select("w").where(F.size("w") >= 3)
    rows = rows.select("w", F.posexplode("w").alias("i", "a")).where(F.col("i") + 2 < F.size("w"))
    b, c = F.get("w", F.col("i") + 1), F.get("w", F.col("i") + 2)
    rows = rows.select((F.col("i") + 3 == F.size("w")).alias("end"), F.xxhash64("a", b, c).alias("k3"), F.xxhash64("a", b).alias("k2"))
    known = None if asked is None else bitmap(asked)
    if known:
        rows = rows.where(on_bit(F.col("k3"), known) | on_bit(F.col("k2"), known))
    rows = rows.select("end", F.explode(F.array("k3", "k2")).alias("key"))
    if known:
        rows = rows.where(on_bit(F.col("key"), known))
    elif asked is not None:
        rows = asked_only(rows, asked)
    end = F.col("end")
    return rows.groupBy("key").agg(F.count(F.when(~end, 1)).alias("inside"), F.count(F.when(end, 1)).alias("at_end"))


def distinct_texts(blocks: DataFrame, rows: DataFrame, prose: list[str]) -> DataFrame:
    """t: each text of ``blocks`` that may have three words once, however often it was delivered, and prose however often
    it was copied; a header says the same on every page, and each of its blocks counts. ``rows`` has block_id, prose and hash
    of each delivered text; only texts that may be there again are shuffled."""
    key = lambda is_prose, text: F.when(is_prose, text).otherwise(F.xxhash64("block_id", text)).alias("key")
    again = rows.select(key(F.col("prose"), F.col("hash"))).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    again = materialize(again, "again")
    texts = blocks.where(F.length("content") >= 5)
    texts = texts.select(F.col("content").alias("t"), key(F.coalesce(F.col("label").isin(prose), F.lit(False)), F.xxhash64("content")))
    repeated = asked_only(texts, again).dropDuplicates(["key"])
    return asked_only(texts, again, False).unionByName(repeated).select("t")


def _slots(key: Column, bits: int) -> list[Column]:
    """Two places of a key in a map of 2^k bits: of the low and of the high half of its hash."""
    return [F.shiftrightunsigned(key, n).bitwiseAND(F.lit(bits - 1)) for n in (0, 32)]


def bitmap(asked: DataFrame) -> tuple[Column, int] | None:
    """A map of the asked keys as an array of longs, for ``on_bit``, and its size in bits: BITS_PER_KEY for each key. None
    where that is more than MAX_BITS; then only a join can tell."""
    n = asked.count()
    bits = max(MIN_BITS, 1 << (BITS_PER_KEY * n - 1).bit_length() if n else 0)
    if bits > MAX_BITS:
        return None
    cell = asked.select(F.explode(F.array(*_slots(F.col("key"), bits))).alias("slot"))
    cell = cell.select(F.shiftright("slot", 6).alias("cell"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bits"))
    zero = asked.sparkSession.range(bits // 64).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bits"))
    cell = cell.unionByName(zero).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    rows = F.array_sort(F.collect_list(F.struct("cell", "bits")))  # bits / 64 of them, in one row
    return cell.agg(F.transform(rows, lambda x: x["bits"]).alias("map")).scalar(), bits


def on_bit(key: Column, known: tuple[Column, int]) -> Column:
    """Whether both bits of the key are in the map: true of every asked key, and of few others."""
    bit = [F.getbit(F.get(known[0], F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1 for s in _slots(key, known[1])]
    return bit[0] & bit[1]


def asked_only(rows: DataFrame, asked: DataFrame, on: bool = True) -> DataFrame:
    """The rows that a map of the asked keys lets through (every asked one, and few others), or not ``on`` those it doesn't.
    With more keys than a map may hold, the rows that have or not ``on`` haven't an asked key, by a join."""
    known = bitmap(asked)
    if known is None:
        return rows.join(asked.select("key").distinct(), "key", "left_semi" if on else "left_anti")
    hit = F.coalesce(on_bit(F.col("key"), known), F.lit(False))
    return rows.where(hit if on else ~hit)


def _features(blocks: DataFrame, prose: list[str]) -> DataFrame:
    """What later steps need of each block, without its text."""
    src = blocks.where("content is not null and content <> ''").select(
        "block_id", "page_id", "pos", "source_id", "label", F.col("label").isin(prose).alias("prose"), F.col("n_tokens").alias("spent"), F.col("content").alias("t")
    )
    src = _with_core(src, "core", F.col("t"))
    t, core = F.col("t"), F.col("core")
    near_end = F.substring(core, F.greatest(F.length(core) - 40, F.lit(0)) + 1, F.lit(40))
    src = quality.fence(src, "__end", {"ended": near_end.rlike(ENDED) | (F.trim(core) == "")}).withColumn("ended", F.col("__end.ended"))
    table = (F.col("label") == "table") | F.col("prose")
    first_line, last_line = F.substring_index(core, "\n", 1), F.substring_index(core, "\n", -1)
    cells = lambda line: F.regexp_count(line, F.lit(r"[;,\t]"))
    gaps = lambda line: F.regexp_count(F.trim(line), F.lit(r" {2,}"))  # noqa: E731 - cells aligned by blanks
    open_markup = core.contains("<t") & F.lower(core).contains("<table") & ~F.lower(core).contains("</table>")
    open_rows = F.when(
        table & ~F.col("ended"),
        (first_line.rlike(r"^\s*\|") & ~last_line.rlike(r"\|\s*$")) | ((cells(first_line) >= 2) & (cells(last_line) < cells(first_line))),
    ).otherwise(F.lit(False))
    short_row = table & ~F.col("ended") & core.contains("  ") & (gaps(first_line) >= 1) & (gaps(last_line) < gaps(first_line))
    short_row = F.coalesce(short_row & F.trim(last_line).rlike(r"\p{L}$"), F.lit(False))
    open_end = ~F.col("ended")
    # three words at the end, two at the start: looked for in the whole text where a part of it has too few
    part = lambda p, n: F.when(p.rlike(rf"(?:[^\s\p{{IsHan}}]*[\s\p{{IsHan}}]){{{n}}}"), p).otherwise(core)
    tail = F.substring(core, F.greatest(F.length(core) - WINDOW // 2, F.lit(0)) + 1, F.lit(WINDOW // 2))
    src = _with_words(src, "w", F.when(open_end, part(tail, 8)))
    src = _with_words(src, "h", F.when(F.col("prose"), part(F.substring(core, F.lit(1), F.lit(WINDOW // 4)), 4)))
    at = lambda i: F.try_element_at("w", F.lit(i))
    three = open_end & (F.size("w") >= 3)
    stop = lambda e: F.xxhash64(at(-3), at(-2), F.concat(at(-1), F.lit(e)))
    han_stop = F.xxhash64(at(-2), at(-1), F.lit("。"))  # a word of its own
    out = src.select(
        "block_id", "page_id", "pos", "source_id", "label", "prose", "spent", "ended",
        F.xxhash64(t).alias("hash"), F.length(t).alias("n_chars"), F.octet_length(F.rtrim(t, F.lit("\ufffd"))).alias("n_bytes"),
        (t.endswith("\ufffd") & F.col("prose")).alias("split_char"),
        F.substring(t, F.greatest(F.length(t) - 12, F.lit(0)) + 1, F.lit(13)).rlike(CUT_MARK).alias("marked"),
        open_markup.alias("open_markup"), open_rows.alias("open_rows"),
        F.when(short_row, F.regexp_extract(F.trim(last_line), r"(?:^|  )((?:(?!  ).)+)$", 1)).alias("last_cell"), "w", "h",
    )
    return out.select(
        "block_id", "page_id", "pos", "source_id", "label", "prose", "spent", "ended", "n_chars", "n_bytes", "split_char", "marked", "open_markup", "open_rows", "last_cell", "hash",
        F.when(three, F.xxhash64(at(-3), at(-2), at(-1))).alias("k3"),
        F.when(three, F.xxhash64(at(-3), at(-2))).alias("k2"),
        F.when(three, F.array(stop("."), stop("?"), han_stop)).alias("stops"),
        F.when(open_end & (F.size("w") >= 2), F.array(at(-2), at(-1))).alias("tail"),
        F.size("w").alias("n_words"),
        F.when(F.col("prose") & (F.size("h") >= 2), F.array(F.col("h")[0], F.col("h")[1])).alias("head"),
    )


def open_cells(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """block_id, hash of the tables whose short last row ends in a cell that isn't whole: no other row has this cell, but
    another has one that goes on from it within the word. A row that merely leaves cells empty ends in a whole cell."""
    ask = rows.where("last_cell is not null").select("block_id", "hash", "last_cell").distinct()
    lines = blocks.where((F.col("label") == "table") & F.col("content").contains("  ")).select(F.xxhash64("content").alias("text"), F.explode(F.split("content", "\n")).alias("line"))
    cell = lines.select("text", F.explode(F.split(F.trim("line"), " {2,}")).alias("cell")).where(F.col("cell").rlike(r"^\p{L}.*\p{L}$"))
    cell = cell.groupBy("cell").agg(F.countDistinct("text").alias("n"))  # a text counts once, however often delivered or copied
    starts = cell.select("cell", "n", F.explode(F.sequence(F.lit(1), F.length("cell"))).alias("k"))
    starts = starts.select(F.substring("cell", F.lit(1), F.col("k")).alias("last_cell"), "n", (F.col("k") == F.length("cell")).alias("whole"),
        F.substring("cell", F.col("k") + 1, F.lit(1)).rlike(r"\p{L}").alias("within"))
    known = ask.join(starts, "last_cell").groupBy("block_id", "hash", "last_cell").agg(
        F.coalesce(F.sum(F.when(F.col("whole"), F.col("n"))), F.lit(0)).alias("same"), F.coalesce(F.sum(F.when(F.col("within"), F.col("n"))), F.lit(0)).alias("longer")
    )
    return known.where((F.col("longer") >= MIN_INSIDE) & (F.col("same") <= BREAK_SHARE * F.col("longer") + BREAKS)).select("block_id", "hash").distinct()


def length_limits(rows: DataFrame) -> DataFrame:
    """source_id, char_limit, byte_limit: the lengths at which a source's texts pile up, null where none shows."""

    def limit(col: str, name: str) -> DataFrame:
        texts = rows.groupBy("source_id", F.col(col).alias("len"), "hash").agg(F.lit(1).alias("one"))  # one text is no pile
        n = texts.groupBy("source_id", "len").agg(F.count("*").alias("n"))
        by = Window.partitionBy("source_id").orderBy("len")
        near = F.coalesce(F.sum("n").over(by.rangeBetween(-50, -1)), F.lit(0)) / 50
        above = F.coalesce(F.sum("n").over(by.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
        s = n.withColumns({"near": near, "above": above})
        usual = F.greatest(F.col("near"), F.lit(0.02))
        ok = (F.col("n") >= PILE) & (F.col("n") >= PILE_RATIO * usual) & (F.col("above") <= 0.1 * F.col("n")) & (F.col("len") >= 40)
        return s.where(ok).groupBy("source_id").agg(F.max("len").alias(name))

    return limit("n_chars", "char_limit").join(limit("n_bytes", "byte_limit"), "source_id", "full")


def cut_blocks(blocks: DataFrame, sources: DataFrame, apis: DataFrame, prose: list[str]) -> DataFrame:
    """One row for each block with text: block_id, source_id, cut, reasons; a block delivered again counts once, and is cut
    if a delivery is. See ``deliveries``."""
    rows = deliveries(blocks, sources, apis, prose)
    best = F.max(F.struct("cut", "source_id", "reasons")).alias("b")
    return rows.groupBy("block_id").agg(best).select("block_id", "b.source_id", "b.reasons", "b.cut")


def deliveries(blocks: DataFrame, sources: DataFrame, apis: DataFrame, prose: list[str]) -> DataFrame:
    """block_id, source_id, reasons, cut of each delivered block with text.

    Null or empty texts and texts of fewer than three words can only be cut by a limit.
    A null source, position or token count leaves out the rules that need it."""
    rows = materialize(_features(blocks, prose), "ends")
    after = Window.partitionBy("page_id").orderBy("pos").rangeBetween(1, Window.unboundedFollowing)  # past all deliveries of its own
    follow = rows.where("prose").select("block_id", "page_id", "pos", "label", "prose", "ended", "k3", "k2", "stops", "tail", "head", "n_words")
    follow = follow.withColumn("next_head", F.first("head", True).over(after))
    lone = rows.where("not prose and not ended").select(*[c for c in follow.columns if c != "next_head"]).withColumn("next_head", F.lit(None).cast("array<string>"))
    follow = follow.unionByName(lone)
    tail, head = F.col("tail"), F.col("next_head")
    stopped = rows.groupBy("label").agg(F.avg(F.col("ended").cast("int")).alias("share")).where("share >= 0.5")
    stopped = [r["label"] for r in stopped.collect()]  # labels are a closed list
    # text that is open although its kind usually ends with a sentence
    suspect = F.coalesce(~F.col("ended") & F.col("k3").isNotNull() & F.col("label").isin(stopped), F.lit(False))
    open_ends = follow.where(suspect).select(
        "block_id", "prose", "n_words",
        F.concat(F.transform("stops", lambda k: F.struct(F.lit("stop").alias("role"), k.alias("key"))), F.array(
            F.struct(F.lit("k3").alias("role"), F.col("k3").alias("key")),
            F.struct(F.lit("k2").alias("role"), F.col("k2").alias("key")),
            F.struct(F.lit("over").alias("role"), F.when(head.isNotNull(), F.xxhash64(tail[0], tail[1], head[0])).alias("key")),
            F.struct(F.lit("over").alias("role"), F.when(head.isNotNull(), F.xxhash64(tail[1], head[0], head[1])).alias("key")),
        )).alias("keys"),
    )
    asked = open_ends.select("block_id", "prose", "n_words", F.explode("keys").alias("k")).select("block_id", "prose", "n_words", "k.role", "k.key").where("key is not null")
    asked = materialize(asked.distinct(), "asked")
    counts = trigram_counts(distinct_texts(blocks, rows, prose), "t", asked.select("key"))
    known = asked.join(counts, "key", "left").fillna(0, ["inside", "at_end"])
    pick = lambda role, c: F.coalesce(F.max(F.when(F.col("role") == role, F.col(c))), F.lit(0))
    seen = known.groupBy("block_id", "prose", "n_words").agg(
        pick("k3", "inside").alias("in3"), pick("k3", "at_end").alias("end3"), pick("k2", "inside").alias("in2"),
        pick("k2", "at_end").alias("end2"), pick("over", "inside").alias("over"),
        pick("stop", "inside").alias("stop_in"), pick("stop", "at_end").alias("stop_end"),
    )
    rarely = lambda inside, end: F.col(end) <= 1 + END_SHARE * F.col(inside)
    whole = F.col("stop_in") + F.col("stop_end") >= F.greatest(F.lit(1), F.col("in3") * 0.05)  # ends so, but for the full stop
    unfinished = (F.col("in3") >= MIN_INSIDE) & rarely("in3", "end3") & ~whole
    pair_open = (F.col("in2") >= MIN_PAIR) & rarely("in2", "end2") & ~whole
    # a share of the first two words' places, so that it grows with the table as the ends do
    seldom = F.col("end3") <= F.greatest(F.lit(BREAKS), BREAK_SHARE * (F.col("in2") + F.col("end2")))
    open_sentence = F.col("prose") & (F.col("n_words") >= 6) & seldom & ~whole
    evidence = seen.select(
        "block_id",
        (F.col("over") >= 2).alias("carried_on"),
        F.array_compact(
            F.array(F.when(unfinished, "trigram"), F.when(pair_open, "pair"), F.when(open_sentence & ~pair_open & ~unfinished, "open_sentence"))
        ).alias("evidence"),
    )
    dims = sources.select("source_id", "api_id").dropDuplicates(["source_id"]).join(
        apis.select("api_id", "max_tokens").dropDuplicates(["api_id"]), "api_id", "left"
    )
    limits = materialize(dims.join(length_limits(rows), "source_id", "left").drop("api_id"), "limits")
    none = F.array().cast("array<string>")
    told = rows.drop("tail", "head", "stops", "k2", "n_words")
    cells = open_cells(rows, blocks).withColumn("open_cell", F.lit(True))
    short = told.where("last_cell is not null").join(cells, ["block_id", "hash"], "left")
    short = materialize(short.withColumn("open_rows", F.col("open_rows") | F.coalesce("open_cell", F.lit(False))).drop("open_cell"), "short")
    told = told.where("last_cell is null").unionByName(short).drop("hash", "last_cell").join(limits, "source_id", "left")
    seen = materialize(told.where(suspect).drop("k3").join(evidence, "block_id", "left"), "evidence")
    rest = told.where(~suspect).drop("k3").withColumns({"carried_on": F.lit(False), "evidence": none})
    at_limit = (F.col("n_chars") == F.col("char_limit")) | (
        (F.col("n_bytes") <= F.col("byte_limit"))
        & (F.col("n_bytes") > F.col("byte_limit") - F.when(F.col("n_bytes") > F.col("n_chars"), 3).otherwise(1))
    )
    unfinished_mark = F.col("marked") & ~F.col("ended")
    go_on = F.coalesce(F.col("carried_on"), F.lit(False))
    no = lambda test: F.coalesce(test, F.lit(False))
    at_limit, spent = no(at_limit), no(F.col("spent") >= F.col("max_tokens"))
    sure = at_limit | spent | unfinished_mark | F.col("open_markup")
    # open prose that something speaks against has to be prose, or a table, to count; it is looked at where that decides
    speaks = (F.size(F.coalesce("evidence", none)) > 0) & ~go_on
    against = F.col("prose") & ~F.col("ended") & ~sure & (F.col("open_rows") | F.col("split_char") | speaks)
    doubtful = materialize(seen.where(against).unionByName(rest.where(against)), "doubtful")
    texts = blocks.select("block_id", F.col("content").alias("t"), F.xxhash64("block_id").alias("key"))
    texts = asked_only(texts, doubtful.select(F.xxhash64("block_id").alias("key"))).drop("key").join(doubtful.select("block_id"), "block_id", "left_semi")
    kinds = quality.with_verdict(_with_core(texts.dropDuplicates(["block_id"]), "t", F.col("t")), "t").select("block_id", "kind")
    plain = seen.where(~against).unionByName(rest.where(~against)).withColumn("kind", F.lit("prose"))
    full = plain.unionByName(doubtful.join(kinds, "block_id", "left"))
    kind = F.coalesce("kind", F.lit("prose"))
    shows = {
        "length_limit": at_limit, "max_tokens": spent, "cut_mark": unfinished_mark,
        "open_table": F.col("open_markup") | (F.col("open_rows") & (~F.col("prose") | (kind == "table"))), "split_character": F.col("split_char") & (kind == "prose"),
    }
    speaks = ~go_on & (kind == "prose")
    reasons = F.array_compact(F.concat(F.array(*[F.when(v, k) for k, v in shows.items()]), F.when(speaks, F.coalesce("evidence", none)).otherwise(none)))
    cut = speaks & (F.size(F.coalesce("evidence", none)) > 0)
    for v in shows.values():
        cut = cut | v
    return full.select("block_id", "source_id", reasons.alias("reasons"), cut.alias("cut"))


def source_shares(cuts: DataFrame) -> DataFrame:
    """For each source: texts, cut texts and their share."""
    g = cuts.groupBy("source_id").agg(F.count("*").alias("n_blocks"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"))
    return g.withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_blocks"), 6))

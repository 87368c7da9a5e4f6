"""Problem 4: leftovers of the printed page in recognised text, and the text repaired.

Words broken over line ends are told from compounds by the counts of both spellings. Running headers are lines whose
title is among those of the file's header blocks; page numbers are lines that hold the number of their page.
Misrecognised words are found by a symmetric-delete index: frequent words of the corpus and rare ones are reduced to a
key in which look-alike letters coincide, and to that key less one letter; equal keys make candidates, which a weighted
edit distance with cheap confusion pairs scores, and the count of the word pair with the preceding word decides between
them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import truncation

# Shapes that recognition takes for one another, printed form first.
CONFUSIONS = [
    ("m", "rn"), ("w", "vv"), ("d", "cl"), ("u", "ii"), ("n", "ii"), ("n", "ri"), ("h", "li"), ("b", "lo"), ("k", "lc"), ("m", "nn"), ("u", "li"),
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "!"), ("l", "!"), ("l", "|"), ("i", "|"), ("i", "l"), ("l", "i"), ("t", "l"), ("s", "5"), ("s", "$"), ("b", "6"),
    ("b", "8"), ("g", "9"), ("g", "q"), ("q", "9"), ("z", "2"), ("a", "@"), ("a", "4"), ("t", "7"), ("e", "3"), ("e", "c"), ("c", "e"), ("o", "c"), ("a", "o"),
    ("h", "b"), ("b", "h"), ("u", "v"), ("n", "u"), ("u", "n"), ("f", "t"), ("t", "f"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("li", "h"),
]
#: Cost of a confusion (any other edit costs 1), the highest cost of a repair, and how much more frequent it must be.
CONFUSION_COST, MAX_COST, MIN_RATIO = 0.25, 0.8, 20.0
#: Words shorter than this are left as they are.
MIN_LENGTH = 3

WORD = r"[\p{L}\p{M}0-9@$]*\p{L}(?:[\p{L}\p{M}0-9@$|!]*[\p{L}0-9@$])?"
BREAK = r"(?<![\p{L}\p{N}])(\p{L}+)([-‐¬\x{AD}])[^\S\n]*\n\s*(\p{Ll}\p{L}*|\p{Lu}+)(?![\p{L}\p{N}])"
AT_END = r"[-‐¬\x{AD}][^\S\n]*\n"
JOIN = r"(\p{L})[-‐¬\x{AD}][^\S\n]*\n\s*(?=\p{L})"
NUMBER_LINE = (
    r"(?m)^[\s\-–—\[(]*(?:\p{L}{1,7}\.?[^\S\n]+|第[^\S\n]*)?(?:[0-9]{1,9}|[ivxlcdm]{1,15})(?:[^\S\n]*[/(][^\S\n]*[0-9]{1,9}[^\S\n]*\)?|[^\S\n]*页(?:，共[^\S\n]*[0-9]{1,9}[^\S\n]*页)?)?"
    r"(?:[^\S\n]|[\-–—\])])*$"
)
TITLE_LABELS = ["doc_title", "paragraph_title", "figure_title"]


def _fold(word: Column) -> Column:
    """The word with look-alike shapes brought to one: digits and signs first, then pairs, then letters."""
    word = F.translate(word, "01!|5$6892@473", "olllssbbgzaate")
    for pair, one in (("rn", "m"), ("nn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n"), ("ri", "n"), ("li", "h"), ("lo", "b"), ("lc", "k")):
        word = F.replace(word, F.lit(pair), F.lit(one))
    return F.translate(word, "iqchuvf", "lgebnnt")


def _edits(word: Column) -> Column:
    """The folded word, with pairs of letters folded and without, and, from five characters on, the folded word less one
    character."""
    k = _fold(word)
    single = F.translate(F.translate(word, "01!|5$6892@473", "olllssbbgzaate"), "iqchuvf", "lgebnnt")
    less = F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    return F.array_distinct(F.when(F.length(k) >= 5, F.concat(F.array(k, single), less)).otherwise(F.array(k, single)))


_COSTS: dict[tuple[str, str], float] = {}


def confusion_distance(seen: str, true: str, limit: float = MAX_COST) -> float:
    """Edit distance from the printed word ``true`` to ``seen`` in which a known confusion costs little."""
    if not _COSTS:
        _COSTS.update({(a, b): CONFUSION_COST for a, b in CONFUSIONS})
    n, m = len(seen), len(true)
    if abs(n - m) > 3:
        return limit + 1
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 99.0
            if i:
                best = d[i - 1][j] + 1
            if j:
                best = min(best, d[i][j - 1] + 1)
            if i and j:
                best = min(best, d[i - 1][j - 1] + (seen[i - 1] != true[j - 1]))
                for a in (1, 2):
                    for b in (1, 2):
                        if i >= a and j >= b and a + b < 4:
                            c = _COSTS.get((true[j - b : j], seen[i - a : i]))
                            if c is not None and d[i - a][j - b] + c < best:
                                best = d[i - a][j - b] + c
            d[i][j] = best
    return d[n][m]


def _distances(seen, true):
    import pyarrow as pa

    return pa.array([confusion_distance(a, b) for a, b in zip(seen.to_pylist(), true.to_pylist())], pa.float64())


def _tokens(text: Column) -> Column:
    """Words of the text in lower case, those broken over a line end joined."""
    whole = F.when(text.contains("\n") & text.rlike(AT_END), F.regexp_replace(text, JOIN, "$1")).otherwise(text)
    return F.regexp_extract_all(F.lower(whole), F.lit(WORD), F.lit(0))


def _words(texts: DataFrame) -> DataFrame:
    """Columns of ``texts`` but text, before and word: each word with the one before it ('' at the start)."""
    w = F.col("w")
    before = F.concat(F.array(F.lit("")), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))))
    rows = texts.withColumn("w", F.explode(F.array(_tokens(F.col("text"))))).where(F.size("w") > 0).drop("text")
    rows = rows.withColumn("p", F.explode(F.arrays_zip(before.alias("before"), w.alias("word")))).drop("w")
    return rows.withColumn("before", F.col("p.before")).withColumn("word", F.col("p.word")).drop("p")


def lexicon(texts: DataFrame) -> DataFrame:
    """before, word, n: counts of word pairs over the whole corpus; their sums by word are the frequency lexicon."""
    return _words(texts.select("text")).groupBy("before", "word").agg(F.count("*").alias("n"))


def candidates(pairs: DataFrame) -> DataFrame:
    """word, repair, cost, n_repair: for each rare word the frequent words that a few confusions turn into it."""
    words = materialize(pairs.groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") >= MIN_LENGTH), "words")
    # a repair is MIN_RATIO times as frequent as its misreading, so that nothing rarer can be one, nor misread more often
    frequent = words.where((F.col("n") >= MIN_RATIO) & ~F.col("word").rlike(r"[0-9@$|!]")).select(
        F.col("word").alias("repair"), F.col("n").alias("n_repair"), F.explode(_edits(F.col("word"))).alias("key")
    )
    most = words.agg((F.max("n") / MIN_RATIO).alias("most")).scalar()
    read = (F.col("n") <= most) & (3 * F.length(F.regexp_replace("word", r"[^0-9]", "")) <= F.length("word"))  # else a part number
    rare = words.where(read).select("word", "n", F.explode(_edits(F.col("word"))).alias("key"))
    both = rare.join(frequent, "key").where((F.col("word") != F.col("repair")) & (F.col("n_repair") >= MIN_RATIO * F.col("n")))
    both = both.where(F.abs(F.length("word") - F.length("repair")) <= 2).select("word", "repair", "n_repair").distinct()
    cost = F.arrow_udf(_distances, "double")(F.col("word"), F.col("repair"))
    # a change of case, accent or ending is no confusion of shapes: it costs 1 and is left out
    return both.withColumn("cost", cost).where(F.col("cost") <= MAX_COST)


def misread(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """field, rec_id, word, repair: the misrecognised words of each text and what they should be."""
    pairs = materialize(known if known is not None else lexicon(texts), "pairs")
    found = materialize(candidates(pairs), "repairs")
    asked = found.select(F.xxhash64("word").alias("key")).distinct()
    rows = _words(texts.select("field", "rec_id", "text")).withColumn("key", F.xxhash64("word"))
    hits = truncation.asked_only(rows, asked).drop("key").distinct().join(found, "word")
    context = pairs.select("before", F.col("word").alias("repair"), F.col("n").alias("together"))
    scored = hits.join(context, ["before", "repair"], "left").fillna(0, ["together"])
    # a short word may be one of its own: only what stands before it can tell
    odd = F.col("word").rlike(r"[0-9@$|!]")
    scored = scored.where((F.col("together") > 0) | (F.length("word") >= F.when(odd, 5).otherwise(6)))
    # nearest first; then the word pair seen more often, then the more frequent word
    best = F.max_by("repair", F.struct(-F.col("cost"), "together", "n_repair", "repair"))
    return scored.groupBy("field", "rec_id", "word").agg(best.alias("repair"))


def broken(texts: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """field, rec_id, left, mark, right: words broken over a line end, without compounds that merely wrapped there."""
    at = lambda i: F.regexp_extract_all("text", F.lit(BREAK), F.lit(i))
    here = texts.where(F.col("text").contains("\n") & F.col("text").rlike(AT_END)).where(F.col("text").rlike(BREAK))
    rows = here.select("field", "rec_id", F.explode(F.arrays_zip(at(1).alias("l"), at(2).alias("m"), at(3).alias("r"))).alias("b"))
    rows = rows.select("field", "rec_id", F.col("b.l").alias("left"), F.col("b.m").alias("mark"), F.col("b.r").alias("right"))
    rows = rows.withColumn("compound", F.lower(F.concat("left", F.lit("-"), "right")))
    breaks = rows.where(F.col("mark").isin("-", "‐")).groupBy("compound").agg(F.count("*").alias("n_broken"))
    whole = texts.where(F.col("text").contains("-")).where(F.col("text").rlike(r"\p{L}-\p{L}")).select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}-])\p{L}+-\p{L}+(?![\p{L}\p{N}-])"), F.lit(0))).alias("compound")
    )
    whole = whole.groupBy("compound").agg(F.count("*").alias("n_whole"))
    # a compound that is written with its hyphen within lines more often than it breaks keeps it
    kept = breaks.join(whole, "compound").where("n_whole >= n_broken").select("compound", F.explode(F.array(F.lit("-"), F.lit("‐"))).alias("mark"))
    return rows.join(kept, ["compound", "mark"], "left_anti").drop("compound")


def _parts(line: Column) -> Column:
    """The parts of a running header by their letters: author and title, in any order, spacing and case."""
    parts = F.transform(F.split(line, r" [|—] "), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}]+", "")))
    return F.filter(parts, lambda x: F.length(x) >= F.when(x.rlike(r"\p{IsHan}"), 4).otherwise(8))


def _longest(parts: Column) -> Column:
    return F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("part"))))["part"]


def header_lines(texts: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """field, rec_id, line: lines within a text that are the running header of its file. A page without a file name
    stands for itself; where a file has no header block, the headers of all files serve."""
    file = F.coalesce(F.col("filename"), F.concat(F.lit("page "), F.col("page_id").cast("string")))
    of_page = pages.select("page_id", file.alias("file")).dropDuplicates(["page_id"])
    heads = blocks.where("label = 'header' and content is not null").select("page_id", F.explode(_parts(F.col("content"))).alias("part"))
    heads = materialize(heads.join(of_page, "page_id").select("file", "part").distinct(), "headers")
    lines = texts.where(F.col("text").contains("\n")).select("field", "rec_id", "page_id", F.explode(F.split("text", "\n")).alias("line"))
    # no header ends as a sentence or in a number, or is a table row or a heading
    blank = F.lit(" \t\r\u00a0")
    last, first = F.substring(F.rtrim("line", blank), -1, 1), F.substring(F.ltrim("line", blank), 1, 1)
    other = last.isin(*".!?:。？！") | first.isin("|", "#") | F.substring("line", -1, 1).isin(*"0123456789%")
    lines = lines.where((F.length("line") >= 4) & ~other)
    lines = lines.withColumn("part", F.explode(F.array(_longest(_parts(F.col("line")))))).where("part is not null")
    keyed = truncation.asked_only(lines.withColumn("key", F.xxhash64("part")), heads.select(F.xxhash64("part").alias("key")))
    lines = materialize(keyed.drop("key").join(of_page, "page_id", "left").withColumn("file", F.coalesce("file", F.concat(F.lit("page "), F.col("page_id").cast("string")))), "lines")
    titles = blocks.where(F.col("label").isin(TITLE_LABELS) & F.col("content").isNotNull())
    titles = titles.select("page_id", F.explode(_parts(F.col("content"))).alias("part"), F.lit("markdown").alias("field")).distinct()
    own = lines.join(heads, ["file", "part"], "left_semi")
    bare = lines.join(heads.select("file").distinct(), "file", "left_anti").join(heads.select("part").distinct(), "part", "left_semi")
    found = own.unionByName(bare).join(titles, ["page_id", "part", "field"], "left_anti")
    return found.select("field", "rec_id", "line").distinct()


def _roman(limit: int = 4000) -> dict[str, int]:
    """All numbers that Roman digits can write without signs of their own for thousands."""
    out = {}
    for n in range(1, limit):
        text, left = "", n
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            text += sign * (left // value)
            left %= value
        out[text] = n
    return out


def number_lines(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """field, rec_id, line: lines within a text that print the number of its page."""
    spark = texts.sparkSession
    rows = texts.where(F.col("text").contains("\n")).select(
        "field", "rec_id", "page_id", F.explode(F.regexp_extract_all("text", F.lit(NUMBER_LINE), F.lit(0))).alias("line")
    )
    first = F.regexp_extract("line", r"(?:^|[\s\-–—\[(第])([0-9]{1,9}|[ivxlcdm]{1,15})(?=[^\p{L}0-9]|页|$)", 1)
    rows = rows.withColumn("number", first).where("number <> ''")
    roman = spark.createDataFrame([*_roman().items()], "number string, value int")  # 3,999 rows
    rows = rows.join(F.broadcast(roman), "number", "left").withColumn("value", F.coalesce("value", F.expr("try_cast(number as int)")))
    number = pages.select("page_id", F.col("page_no").alias("value")).dropDuplicates(["page_id"])
    return rows.join(number, ["page_id", "value"], "left_semi").select("field", "rec_id", "line").distinct()


def defects(texts: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """field, rec_id, defect of each text (field, rec_id, page_id, text) and each kind of leftover it has.

    Repeated deliveries count once. Null and empty texts have no defect; a text of an unknown page can have neither
    header nor page number."""
    texts = texts.where("text is not null and text <> ''").select("field", "rec_id", "page_id", "text")
    parts = [
        broken(texts).select("field", "rec_id", F.lit("hyphen").alias("defect")),
        misread(texts).select("field", "rec_id", F.lit("glyph").alias("defect")),
        header_lines(texts, blocks, pages).select("field", "rec_id", F.lit("header").alias("defect")),
        number_lines(texts, pages).select("field", "rec_id", F.lit("page_no").alias("defect")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def repair(texts: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """field, rec_id, repaired: each text as continuous paragraphs without headers, page numbers, breaks and misread
    words. Lines of a paragraph are joined by blanks; blank lines, list items and table rows keep their lines."""
    texts = texts.where("text is not null").select("field", "rec_id", "page_id", "text").dropDuplicates(["field", "rec_id"])
    full = texts.where("text <> ''")
    key = ["field", "rec_id"]
    drop = header_lines(full, blocks, pages).unionByName(number_lines(full, pages)).groupBy(*key).agg(F.collect_set("line").alias("drop_lines"))
    swaps = misread(full).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "repair"))).alias("swaps"))
    joins = broken(full).groupBy(*key).agg(F.collect_set(F.concat("left", "mark", F.lit("\n"), "right")).alias("joins"))
    rows = texts.join(drop, key, "left").join(swaps, key, "left").join(joins, key, "left")
    fixed = F.arrow_udf(_repaired, "string")("text", "drop_lines", "swaps", "joins")
    return rows.select(*key, fixed.alias("repaired"))


_TOKEN = re.compile(r"[^\W_][\w@$|!]*[\w@$]|[^\W_]")
_KEEP = re.compile(r"^\s*(?:[-*+•·–>|#]|\(?\w{1,3}[.)]\s|<)|\t| {3}")


def _repaired(texts, drops, swaps, joins):
    import pyarrow as pa

    out = []
    for text, drop, swap, join in zip(texts.to_pylist(), drops.to_pylist(), swaps.to_pylist(), joins.to_pylist()):
        if text is None:
            out.append(None)
            continue
        gone = {x.strip() for x in drop or ()}
        if gone:
            text = "\n".join(x for x in text.split("\n") if x.strip() not in gone)
        whole = {re.sub(r"\s+", "", x) for x in join or ()}
        if whole:
            text = re.sub(
                r"([^\W\d_]+)([-‐¬\xad])[^\S\n]*\n\s*([^\W\d_]+)",
                lambda m: m[1] + m[3] if m[1] + m[2] + m[3] in whole else m[1] + m[2] + m[3], text,
            )
        if swap:
            known = dict(swap)

            def fix(m):
                new = known.get(m[0].lower())
                return m[0] if new is None else new.upper() if m[0].isupper() and len(m[0]) > 1 else new.capitalize() if m[0][0].isupper() else new

            text = _TOKEN.sub(fix, text)
        lines: list[str] = []
        for line in text.split("\n"):
            if lines and line.strip() and lines[-1].strip() and not _KEEP.search(line) and not _KEEP.search(lines[-1]):
                lines[-1] = f"{lines[-1].rstrip()} {line.strip()}"
            else:
                lines.append(line)
        out.append("\n".join(lines))
    return pa.array(out, pa.string())

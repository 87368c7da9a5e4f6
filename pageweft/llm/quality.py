"""Problem 5: text statistics of each document and a verdict of prose, list, table or junk.

Everything is a built-in column expression: one scan, no shuffle, no Python. The fixed-threshold rules published for
filtering web text (Rae et al. 2021, "Scaling Language Models", appendix A; sentences: Raffel et al. 2020, "Exploring the
Limits of Transfer Learning", section 2.2) come first; each that a text fails leaves its
name, rule:…, in ``reasons``. A text that passes them all is prose. What another is, if not merely short prose, is told
by rules of kind, table:…, list:… and junk:…, which leave their names too. Null text counts as empty: zero statistics, verdict prose, no reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the corpus languages.
COMMON_WORDS = (
    "the and of to in is that it for was on are with as be this have from or by not but what all were when which their "
    "der die das und ist nicht ein eine zu den mit von auf für sich dem im des auch "
    "le la les de des et est un une que pour dans qui pas sur au ne se du "
    "el los las y en por con para una del se no lo su al más "
    "il lo gli di che e non per con una sono da si del della "
    "o os as um uma não em do da que com mais dos "
    "het een van en niet dat ik te zijn voor met op er aan "
    "i w na nie się z że do jest to są jak "
    "и в не на что с это как по но из для от а"
).split()
HAN_COMMON = "的了是不在有和就我这对都为也来到说们要"
# Characters that stand for symbols rather than text or its punctuation.
SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~¤°©¬™€¢®§¶±�■□▪"
# Blanks.
WIDE_BLANK = r"[\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
# Characters that fill text decoded with the wrong table.
WRONG_DECODE = "ÃÂâÐÑ€œ™žŸ¢¤©¬°�"


#: The published thresholds: words of a document, letters of a word, symbols (# and ellipses) for each word, shares of
#: lines that begin with a bullet or end in an ellipsis, share of words with a letter, stop words, and share of the text in
#: repeated sequences of five words (here: of these sequences themselves); sentences.
WORDS, WORD_LENGTH, SYMBOLS_PER_WORD, BULLET_LINES, ELLIPSIS_LINES, LETTER_WORDS, STOP_WORDS, REPEATED, SENTENCES = (50, 100_000), (3.0, 10.0), 0.1, 0.9, 0.3, 0.8, 2, 0.15, 3


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _any_of(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def _without(text: Column, chars: str) -> Column:
    """How many of ``chars`` are in ``text``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _wide(text: Column) -> Column:
    """Whether there are other characters than ASCII."""
    return F.octet_length(text) > F.length(text)


def _blanks(text: Column) -> Column:
    """How many blanks are in ``text``; usual ones are counted without a pattern."""
    plain = sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in " \n\t"), F.lit(0))
    rare = F.when(text.contains("\r") | text.contains("\x0b") | text.contains("\x0c"), _n(text, r"[\x0b\f\r]")).otherwise(0)
    return plain + rare + F.when(_wide(text), _n(text, WIDE_BLANK)).otherwise(0)


def _symbols(text: Column) -> Column:
    plain, wide = ("".join(c for c in SYMBOLS if (ord(c) < 128) == ascii_) for ascii_ in (True, False))
    return _n(text, _any_of(plain)) + F.when(_wide(text), _n(text, _any_of(wide))).otherwise(0)


def _per(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def fence(df: DataFrame, name: str, fields: dict[str, Column], replace: bool = False) -> DataFrame:
    """``df`` with a struct of ``fields``, each computed once: the optimizer can't copy them into later expressions."""
    kept = [c for c in df.columns if c != name] if replace else ["*"]
    if len(fields) <= 6:
        return df.select(*kept, F.explode(F.array(F.struct(*[v.alias(k) for k, v in fields.items()]))).alias(name))
    # in groups: one generated method for all fields would be too long to be compiled
    names = [*fields]
    groups = {f"{name}_{i}": names[i : i + 6] for i in range(0, len(names), 6)}
    for g, part in groups.items():
        df = fence(df, g, {k: fields[k] for k in part})
    whole = F.struct(*[F.col(g)[k].alias(k) for g, part in groups.items() for k in part])
    return df.select(*kept, *groups, whole.alias(name)).drop(*groups)


def with_stats(df: DataFrame, text: str) -> DataFrame:
    """``df`` with a struct column ``stats``; other columns are kept, also ones named like a statistic."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    out = fence(df, "__in", {"t": t, "w": words, "han": F.when(t.rlike(r"\p{IsHan}"), F.regexp_count(t, F.lit(r"\p{IsHan}"))).otherwise(0)})
    w, base = F.col("__in.w"), F.col("__in.t")
    n_words, n_chars = F.size(w), F.length(base)
    n_lines = F.when(n_chars > 0, _n(base, r"\n(?=\S|[^\S\n]+\S)") + 1).otherwise(0)
    letters = F.length(F.array_join(w, ""))
    han = F.col("__in.han")
    plain = {
        "n_chars": n_chars,
        "n_words": n_words,
        "n_lines": n_lines,
        "n_letters": letters,
        "n_han": han,
        "n_digits": _n(base, "[0-9]"),
        "n_space": _blanks(base),
        "n_distinct": F.size(F.array_distinct(w)),
        "n_common": F.size(F.filter(w, lambda x: x.isin(COMMON_WORDS))),
        "n_han_common": F.when(han > 0, _without(base, HAN_COMMON)).otherwise(0),
        "n_han_distinct": F.when(han > 0, F.size(F.array_distinct(F.split(base, "")))).otherwise(0),
        "n_sentences": _n(base, r"[.!?…。？！][\"'”»)\]]*(?=\s|$|\p{IsHan})"),
        "n_end_lines": _n(base, r"(?m)[.!?:;…。？！]['\"”»)\]]*[^\S\n]*$"),
        "n_bullets": _n(base, r"(?m)^[^\S\n]*(?:[-*+•·‣▪◦–—○●]\s|\(?(?:[0-9]{1,3}|[A-Za-zА-я]|[ivx]{1,5})[.)、]\s)"),
        "n_markup_cells": F.when(base.contains("<"), _n(base, r"(?i)</?(?:table|tr|td|th)\b")).otherwise(0),
        "n_pipe_lines": F.when(base.contains("|"), _n(base, r"(?m)^\s*\|.*\|.*$")).otherwise(0),
        "n_leaders": F.when(base.contains("...."), _n(base, r"(?m)\.{4,}[^\S\n]*[0-9]+[^\S\n]*$")).otherwise(0),
        "n_tokens": _n(base, r"\S+"),
        "n_letter_tokens": _n(base, r"\p{L}\S*"),
        "n_marks": F.when(base.contains("#"), _without(base, "#")).otherwise(0) + F.when(base.contains("...") | base.contains("…"), _n(base, r"\.{3,}|…")).otherwise(0),
        "n_ellipsis_lines": F.when(base.contains("...") | base.contains("…"), _n(base, r"(?m)(?:\.{3}|…)[^\S\n]*$")).otherwise(0),
    }
    out = fence(out, "__plain", {k: v.cast("int") for k, v in plain.items()})
    p = lambda k: F.col("__plain")[k]
    # the rest is only asked for by rules about text of few common words, or without sentences, or that repeats
    few = p("n_distinct") <= 0.6 * F.least(p("n_words"), F.lit(120))
    many = (p("n_words") >= 20) & (p("n_distinct") <= 0.6 * p("n_words"))
    odd = (p("n_common") < 0.4 * p("n_words")) | (p("n_sentences") == 0)
    neighbours = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(n_words, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    fives = F.transform(F.sequence(F.lit(1), F.greatest(n_words - 4, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(5))))
    special = {
        "n_first_char": F.when(p("n_common") < 0.4 * p("n_words") + 1, n_chars - F.length(F.replace(base, F.substring(base, 1, 1), F.lit("")))).otherwise(0),
        "n_fives": F.when(many, F.size(F.array_distinct(fives))).otherwise(F.greatest(p("n_words") - 4, F.lit(0))),
        "n_pairs": F.when(few, F.size(F.array_distinct(neighbours))).otherwise(p("n_words")),
        "n_cells": F.when(
            odd & (few | many | (p("n_lines") >= 2)), _n(base, r"(?m)(?:[;,\t|]|  +)(?:[-+]?[0-9][0-9.]*%?|n/a|-)(?=[;,\t|]|  |$)|[;,\t|](?=[;,\t|])")
        ).otherwise(0),
        "n_separators": F.when(odd & (p("n_lines") <= 2), _n(base, r"[,;/|·、，]\s|、|，| - ")).otherwise(0),
        "n_code": F.when(odd & ((p("n_lines") <= 2) | (p("n_sentences") == 0)), _n(base, r"[{}()=]|--|::|->|;$")).otherwise(0),
        "n_no_vowel": F.when(
            p("n_common") < 0.3 * p("n_words"), _n(F.lower(base), r"(?<![\p{L}'’])[bcdfghjklmnpqrstvwxz]{2,}(?![\p{L}'’.])")
        ).otherwise(0),
        "n_mixed": F.when(
            (p("n_digits") > 2) & (p("n_common") < 0.3 * p("n_words")),
            _n(F.lower(base), r"(?<![\p{L}0-9])(?:[a-z]+[0-9]|[0-9]+[a-z])[a-z0-9]*"),
        ).otherwise(0),
        "n_wrong": F.when(p("n_common") < 0.3 * p("n_words"), _n(base, _any_of(WRONG_DECODE))).otherwise(0),
    }
    stats = {k: p(k) for k in plain} | {k: v.cast("int") for k, v in special.items()}
    out = fence(out, "__stats", stats)
    return out.withColumn("stats", F.col("__stats")).drop("__in", "__plain", "__stats")


def with_verdict(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``stats``, the reported ratios, ``kind`` (prose, list, table, junk) and ``reasons``."""
    out = with_stats(df, text)
    s = lambda k: F.col("stats")[k]
    body = s("n_chars") - s("n_space")
    latin_words = F.greatest(s("n_words"), F.lit(1))
    common = F.when(
        s("n_han") * 2 > s("n_letters"), F.least(_per(s("n_han_common"), s("n_han")) * 2.0, F.lit(1.0))
    ).otherwise(_per(s("n_common"), s("n_words")))
    distinct = _per(s("n_han_distinct"), F.least(s("n_han"), F.lit(120)))
    ratios = {
        "word_count": s("n_words"),
        "mean_word_length": F.round(_per(s("n_letters"), s("n_words")), 4),
        "symbol_ratio": F.round(_per(_symbols(F.coalesce(F.col(text), F.lit(""))), body), 4),
        "line_end_ratio": F.round(_per(s("n_end_lines"), s("n_lines")), 4),
        "common_ratio": F.round(common, 4),
    }
    out = out.withColumns(ratios)
    # Han text has no blanks between words: each character counts as one, and its length says nothing
    is_han = s("n_han") * 2 > s("n_letters")
    words = F.when(is_han, s("n_han")).otherwise(s("n_tokens"))
    length = _per(body, s("n_tokens"))
    again = F.greatest(s("n_words") - 4, F.lit(0)) - s("n_fives")
    published = {
        "rule:word_count": ~words.between(*WORDS),
        "rule:mean_word_length": ~is_han & ~length.between(*WORD_LENGTH),
        "rule:symbols": s("n_marks") > SYMBOLS_PER_WORD * words,
        "rule:bullet_lines": s("n_bullets") > BULLET_LINES * s("n_lines"),
        "rule:ellipsis_lines": s("n_ellipsis_lines") > ELLIPSIS_LINES * s("n_lines"),
        "rule:letter_words": s("n_letter_tokens") < LETTER_WORDS * s("n_tokens"),
        "rule:stop_words": s("n_common") + s("n_han_common") < STOP_WORDS,
        "rule:sentences": s("n_sentences") < SENTENCES,
        "rule:repetition": again > REPEATED * (s("n_words") - 4),
    }
    out = fence(out, "__failed", {"r": F.array_compact(F.array(*[F.when(v & (s("n_chars") > 0), F.lit(k)) for k, v in published.items()]))})
    failed = F.col("__failed.r")
    big = body >= 12
    spread = s("n_words") / F.greatest(s("n_lines"), F.lit(1))
    rules = {
        "table:markup": s("n_markup_cells") >= 3,
        "table:pipes": (s("n_pipe_lines") >= 2) & (s("n_pipe_lines") >= 0.6 * s("n_lines")),
        "junk:no_text": big & (s("n_letters") + s("n_digits") < 0.15 * body),
        "junk:wrong_decoding": big & (s("n_wrong") >= 0.3 * body) & (F.col("common_ratio") < 0.3),
        "junk:one_character": (body >= 20) & (s("n_first_char") >= 0.8 * body),
        "junk:repetition": ((s("n_words") >= 8) & (s("n_pairs") < F.when((s("n_words") < 20) & (s("n_distinct") <= 6), 0.6).otherwise(0.35) * F.least(s("n_words"), F.lit(200)))
        & (s("n_cells") < s("n_lines")) & (s("n_bullets") < 2)) | ((s("n_han") >= 24) & (distinct <= 0.2)),
        "junk:repeated_passages": (s("n_words") >= 40) & (again >= 0.6 * (s("n_words") - 4)) & (s("n_cells") < s("n_lines")) & (s("n_bullets") < 2),
        "junk:no_vowels": (s("n_words") >= 3) & (s("n_no_vowel") > 0.5 * latin_words) & (F.col("common_ratio") < 0.3),
        "junk:letter_digit_mix": (s("n_mixed") >= 3) & (s("n_mixed") >= 0.3 * (s("n_space") + 1)) & (F.col("common_ratio") < 0.3),
        "junk:endless_token": (body >= 40) & (s("n_space") < 0.02 * s("n_chars")) & (s("n_han") < 0.3 * body)
        & ~F.coalesce(F.col(text), F.lit("")).rlike(r"^\s*(?:https?://|www\.)|[\\{}()]"),
        "table:cells": (s("n_lines") >= 2) & (s("n_cells") >= 0.8 * s("n_lines"))
        & ((F.col("common_ratio") < 0.25) | (s("n_sentences") == 0)),
        "list:bullets": (s("n_bullets") >= 2) & (s("n_bullets") >= 0.6 * s("n_lines")),
        "list:leaders": (s("n_leaders") >= 2) & (s("n_leaders") >= 0.5 * s("n_lines")),
        "list:short_lines": (s("n_lines") >= 3) & (spread <= 6) & (s("n_sentences") == 0) & (s("n_end_lines") == 0)
        & (F.col("common_ratio") < 0.4) & (s("n_code") < s("n_lines")),
        "list:enumeration": (s("n_lines") <= 2) & (s("n_separators") >= 4)
        & ((s("n_sentences") == 0) | ((s("n_sentences") <= 1) & F.coalesce(F.col(text), F.lit("")).rlike(r"(?:…|\.\.\.)$")))
        & (s("n_words") < 5 * (s("n_separators") + 1)) & (F.col("common_ratio") < 0.4) & (s("n_code") <= 2),
    }
    kinds = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    out = fence(out, "__kinds", {"k": F.when(F.size(failed) > 0, kinds).otherwise(F.array().cast("array<string>"))})
    first = F.split(F.try_element_at("__kinds.k", F.lit(1)), ":")[0]
    return out.withColumn("reasons", F.concat(failed, F.col("__kinds.k"))).withColumn("kind", F.coalesce(first, F.lit("prose"))).drop("__failed", "__kinds")


REPORT = ["word_count", "mean_word_length", "symbol_ratio", "line_end_ratio", "common_ratio", "kind", "reasons"]


def report(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row of ratios, verdict and reasons for each row of ``df``."""
    return with_verdict(df.select(*keys, F.col(text).alias("__text")), "__text").select(*keys, *REPORT)


def misfits(blocks: DataFrame, prose_labels: list[str]) -> DataFrame:
    """block_id and kind of the blocks labelled prose whose content isn't; a redelivered block counts once."""
    rows = blocks.where(F.col("label").isin(prose_labels) & (F.trim("content") != ""))
    bad = with_verdict(rows.select("block_id", F.col("content").alias("__text")), "__text").where("kind <> 'prose'")
    return bad.groupBy("block_id").agg(F.min("kind").alias("kind"))

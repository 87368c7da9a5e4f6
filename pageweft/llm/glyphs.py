"""Problem 3: one consistent form for text that prints alike.

Every token gets the scripts in which it could be written as a whole (the intersection of its characters' resolved
script sets). A token of mixed scripts takes the script in that intersection; a token whose every letter has a twin in
another script follows the script that the rest of the text is written in. Remaining compatibility forms (width,
ligatures, blanks, invisible characters, combining sequences) are normalised. Raised and lowered digits, circled
characters, fractions, case and line breaks stay, since they print differently.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize

#: Tasks that share the pairs of one class.
SALTS = 8

# Letters of other scripts that print like Latin letters.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝӏѵ", "ABESIJKMHOPCTYXaesijopcyxhdqwlv"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹνοϲϳ", "ABEZHIKMNOPTYXJCvocj"))
ARMENIAN = dict(zip("ԼՍՏՕհոսցօ", "LUSOhnugo"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏀ", "ABCDEHJKLMPRSTVWZG"))
COPTIC = dict(zip("ⲤⲞⲢⲎⲔⲘⲚⲦⲬⲥⲟ", "COPHKMNTXco"))
# Characters without a width of their own.
INVISIBLE = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
# Compatibility tags whose forms print like their plain form.
ALIKE = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<small>")

_TWINS = {"Cyrl": CYRILLIC, "Grek": GREEK, "Armn": ARMENIAN, "Cher": CHEROKEE, "Copt": COPTIC}
_RANGES = {"Cyrl": [(0x400, 0x530)], "Grek": [(0x370, 0x400), (0x1F00, 0x2000)], "Armn": [(0x530, 0x590)], "Cher": [(0x13A0, 0x1400)], "Copt": [(0x2C80, 0x2D00)]}
_BACK = {s: {v: k for k, v in m.items()} for s, m in _TWINS.items()}
_TO_LATIN = {ord(k): v for m in _TWINS.values() for k, v in m.items()}
_TOKEN = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[" + "".join(f"{chr(a)}-{chr(b - 1)}" for r in _RANGES.values() for a, b in r) + "]")
_BLANKS = re.compile(r"[^\S\n]+")


class _Compat(dict):
    """A translation table filled on demand from the Unicode character database."""

    def __missing__(self, code: int) -> str | None:
        ch = chr(code)
        if ch in INVISIBLE:
            out = None
        elif code in _TO_LATIN:
            out = ch
        elif ch in "‐‑":
            out = "-"
        elif ch.isspace() and ch != "\n":
            out = " "
        else:
            out = unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch).startswith(ALIKE) else ch
        self[code] = out
        return out


_COMPAT = _Compat()


def _script(ch: str) -> str:
    code = ord(ch)
    for script, ranges in _RANGES.items():
        if any(a <= code < b for a, b in ranges):
            return script
    return "Latn" if code < 0x250 or 0x1E00 <= code < 0x1F00 else "Other"


def _possible(ch: str) -> frozenset[str]:
    """Scripts that have a letter printing like ``ch`` (combining marks set aside)."""
    base = unicodedata.normalize("NFD", ch)[0]
    own, latin = _script(base), _TO_LATIN.get(ord(base), base)
    out = {own}
    if own == "Latn" or latin != base:
        out |= {"Latn"} | {s for s, back in _BACK.items() if latin in back}
    return frozenset(out)


class _Letters(dict):
    """Script and possible scripts of a character, looked up once."""

    def __missing__(self, ch: str) -> tuple[str, frozenset[str]]:
        out = self[ch] = _script(unicodedata.normalize("NFD", ch)[0]), _possible(ch)
        return out


_LETTERS = _Letters()


def _respell(token: str, script: str) -> str:
    """``token`` with every letter that has a twin in ``script`` written by that twin."""
    out = []
    for ch in unicodedata.normalize("NFD", token):
        latin = _TO_LATIN.get(ord(ch), ch)
        out.append(ch if _script(ch) == script else latin if script == "Latn" else _BACK[script].get(latin, ch))
    return unicodedata.normalize("NFC", "".join(out))


def _resolve(text: str) -> tuple[str, int, int]:
    """The text in consistent scripts; tokens that mixed scripts; tokens wholly written in look-alikes."""
    fixed: Counter = Counter()
    for ch, n in Counter(text).items():  # letters without a twin tell the script of the text
        if ch.isalpha() and len(_LETTERS[ch][1]) == 1:
            fixed[_LETTERS[ch][0]] += n
    main = max(sorted(fixed), key=fixed.get) if fixed else "Latn"
    out, at, mixed, whole_script = [], 0, 0, 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        if main == "Latn" and token.isascii():
            continue
        letters = [_LETTERS[c] for c in token]
        now = {x[0] for x in letters}
        if len(now) == 1 and main in now:
            continue
        whole = frozenset.intersection(*[x[1] for x in letters])
        target = ""
        if len(now) > 1:
            mixed += 1
            target = main if main in whole else next(iter(sorted(whole)), "")
        elif main in whole:
            whole_script += 1
            target = main
        if target == "Latn" or target in _TWINS:
            out += [text[at : m.start()], _respell(token, target)]
            at = m.end()
    return "".join([*out, text[at:]]), mixed, whole_script


def canonical(text: str | None) -> tuple[str | None, int, int]:
    """The consistent form of ``text``, and how many tokens mixed scripts or were wholly look-alike. Null stays null."""
    if text is None:
        return None, 0, 0
    out, mixed, whole = text, 0, 0
    if not out.isascii():
        out = unicodedata.normalize("NFC", out.translate(_COMPAT))
        if _FOREIGN.search(out):
            out, mixed, whole = _resolve(out)
    return _BLANKS.sub(" ", out).strip(" "), mixed, whole


def skeleton(text: str | None) -> str | None:
    """Equal for any two texts that print alike, whichever script each was resolved to."""
    if text is None or not _FOREIGN.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TO_LATIN))


_FORM = T.StructType(
    [
        T.StructField("canonical", T.StringType()),
        T.StructField("skeleton", T.StringType()),
        T.StructField("mixed", T.IntegerType()),
        T.StructField("whole", T.IntegerType()),
    ]
)


def _forms(texts):  # Arrow batch in, Arrow batch out
    import pyarrow as pa

    rows = [canonical(t) for t in texts.to_pylist()]
    return pa.StructArray.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.string()),
            pa.array([skeleton(r[0]) for r in rows], pa.string()),
            pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.int32()),
        ],
        ["canonical", "skeleton", "mixed", "whole"],
    )


def with_canonical(df: DataFrame, text: str | Column, prefix: str = "") -> DataFrame:
    """``df`` with <prefix>canonical, <prefix>skeleton, <prefix>mixed_tokens and <prefix>whole_tokens.

    Plain ASCII text never leaves the JVM: only its runs of blanks change. Null text gives nulls and zeros, empty text
    stays empty, and any other column of ``df`` is kept."""
    text = F.col(text) if isinstance(text, str) else text
    special = text.rlike(r"[^\x00-\x7F]")
    form = F.arrow_udf(_forms, _FORM)(F.when(special, text))
    plain = F.trim(F.regexp_replace(text, r"[\x09\x0B\x0C\x0D\x1C-\x20]+", " "))
    tmp = "__form"
    out = df.withColumn(tmp, form)
    return out.withColumns(
        {
            f"{prefix}canonical": F.coalesce(F.col(f"{tmp}.canonical"), plain),
            f"{prefix}skeleton": F.coalesce(F.col(f"{tmp}.skeleton"), plain),
            f"{prefix}mixed_tokens": F.coalesce(F.col(f"{tmp}.mixed"), F.lit(0)),
            f"{prefix}whole_tokens": F.coalesce(F.col(f"{tmp}.whole"), F.lit(0)),
        }
    ).drop(tmp)


def _hashed(blocks: DataFrame, id_col: str, text: str) -> DataFrame:
    """k, s, id, once each: 128-bit hashes of what a text prints as and of its stored string. Written, since pairs, classes
    and spellings read it; the normaliser runs once."""
    h = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b"))
    src = blocks.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null and t <> ''")
    rows = with_canonical(src, "t").where("skeleton <> ''").select("id", h(F.col("skeleton")).alias("k"), h(F.col("t")).alias("s"))
    return materialize(rows, "forms")


def _spelt_differently(rows: DataFrame) -> DataFrame:
    """The rows, once each, of classes with more than one stored string."""
    spread = rows.groupBy("k").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("k")
    return rows.join(spread, "k", "left_semi").distinct()


def alike_pairs(blocks: DataFrame, id_col: str = "block_id", text: str = "content") -> DataFrame:
    """Pairs of ids whose texts print alike while the stored strings differ: <id>_a < <id>_b.

    Texts travel as 128-bit hashes only. Classes in which every stored string is the same (the hot ones: empty and
    boilerplate texts) are dropped before any pair is made, repeated rows count once, and a pair is only built between
    different spellings; a class is spread over SALTS tasks. Null and empty texts belong to no pair. Where classes are
    large, ``alike_classes`` says the same in one row for each id."""
    multi = materialize(_spelt_differently(_hashed(blocks, id_col, text)), "spellings")
    a = multi.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).alias("a")
    b = multi.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).alias("b")
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.salt") == F.col("b.salt"))
    pairs = a.join(b, same & (F.col("a.s") != F.col("b.s")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias(f"{id_col}_a"), F.col("b.id").alias(f"{id_col}_b")).distinct()


def alike_classes(blocks: DataFrame, id_col: str = "block_id", text: str = "content") -> DataFrame:
    """<id>, class_id, spelling_id, n_links of each id whose text is stored in other ways too: class_id is the smallest id
    that prints alike, spelling_id the smallest with the same string, n_links how many ids differ from it in their string
    alone. An id that was delivered with several strings has a row for each."""
    multi = _spelt_differently(_hashed(blocks, id_col, text))
    spellings = materialize(multi.groupBy("k", "s").agg(F.min("id").alias("spelling_id"), F.count("*").alias("n")), "spellings")
    classes = spellings.groupBy("k").agg(F.min("spelling_id").alias("class_id"), F.sum("n").alias("n_all"))
    told = spellings.join(classes, "k").select("k", "s", "class_id", "spelling_id", (F.col("n_all") - F.col("n")).alias("n_links"))
    return multi.join(told, ["k", "s"]).select(F.col("id").alias(id_col), "class_id", "spelling_id", "n_links")

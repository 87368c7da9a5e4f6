"""Problem 1: the language of each record and of each stretch of it in one language, with a confidence.

Evidence is fused in log space: word likelihoods of the stretch, the declared language, the suffix of linked addresses
and a prior of the record's host, which is smoothed towards its kind of record and towards the whole corpus by grouped
aggregation. The word model is naive Bayes with a character back-off, fitted on at most ``per_language`` labelled rows
of each language; rows that the first fit assigns elsewhere are left out of the second. Where another script prevails,
its letters are the likelihood, fused like that of words; text of none of the languages has a class of its own. Code, links, tables, lists and repetition are set aside before anything is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import glyphs

LANGUAGES = ["en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "zh"]
LATIN = 8  # the first eight share a script
# ISO 639 codes and names of the languages.
SPELLINGS = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano", "pt": "pt por portuguese português portugues", "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands", "pl": "pl pol polish polski", "ru": "ru rus russian русский", "zh": "zh zho chi chinese cmn 中文",
}
# Country suffixes whose sites are mostly in one of the languages.
SUFFIXES = {
    "en": "uk us au nz ie", "de": "de at", "fr": "fr", "es": "es mx ar co cl pe", "pt": "pt br", "it": "it", "nl": "nl", "pl": "pl", "ru": "ru su by", "zh": "cn tw",
}
#: Probability that a declared language or an address suffix is that of a stretch, and weight of the smoothing levels.
DECLARED_RIGHT, SUFFIX_RIGHT, SMOOTHING = 0.85, 0.6, 50.0
#: A stretch counts as prose of about a sentence from this many words (Han characters) and letters on.
MIN_WORDS, MIN_LETTERS, MIN_HAN = 4, 18, 7
#: Hosts whose priors (ten numbers each) are broadcast, at most; beyond, the tasks that share a host's texts.
MAX_BROADCAST_HOSTS, SALTS = 50_000, 32
#: Log-likelihood by which the best language must lead within a sentence.
MARGIN = 3.0

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_LINK = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+|<[^<>\n]{1,200}>")
_CODE_LINE = re.compile(
    r"^(?: {4}|\t)|^\s*[$#]\s|^\s*(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE|JOIN)\b|[{};]\s*$|^\s*\}|\w\(.*\)\s*[:{;]|^\s*(?:return|def|import|for|if|while|const|let|var|int|void)\b.*[=(:;]"
)
_CODE_HINT = re.compile(r"[{}=$#\t]|;\s*(?:\n|$)|    |\) *[:{;]|\b(?:SELECT|FROM|WHERE|GROUP|ORDER|INSERT|UPDATE|JOIN)\b")
_BULLET = re.compile(r"^\s*(?:[-*+•·‣▪–—]|\(?(?:\d{1,3}|[A-Za-z])[.)])\s")
_END = re.compile(r"[.!?。？！…．][\"'”’»)\]]*(?:\s|$)|[。？！]")
_SEPARATOR = re.compile(r"[,;/|·、，]\s|[、，]| - ")
_SENTENCE = re.compile(r"(?<=[.!?:;…])[\"'”’»)\]]*\s+|(?<=[。？！；：．])|[\"“”„«»()\[\]]|\n")
_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
_HAN, _CYRILLIC = re.compile(r"[㐀-鿿]"), re.compile(r"[Ѐ-ӿ]")
_KANA, _RUSSIAN = re.compile(r"[぀-ヿ]"), re.compile(r"[а-яё]")
#: Shares of letters (Han, kana, Russian, other Cyrillic, other) in text of a Latin language, of Russian, of Chinese, and of
#: none of the languages: of another language with Cyrillic or with Han letters; and the share of these two.
SCRIPT_SHARES = {"latin": (1e-4, 1e-4, 1e-4, 1e-4, 0.9996), "ru": (1e-4, 1e-4, 0.98, 1e-3, 0.0188), "zh": (0.96, 1e-4, 1e-4, 1e-4, 0.0397), "cyrillic": (1e-4, 1e-4, 0.85, 0.12, 0.0298), "han": (0.4, 0.5, 1e-4, 1e-4, 0.0998)}
NONE_SHARE = 0.02


def declared(lang: Column) -> Column:
    """The code of a language named in any usual spelling; null where it names none of the languages."""
    return _looked_up(F.regexp_replace(F.lower(F.trim(lang)), r"[-_.].*$", ""), SPELLINGS)


def _looked_up(key: Column, names: dict[str, str]) -> Column:
    """The code among whose names ``key`` is, read once; null where it is none's."""
    return F.try_element_at(F.create_map(*[F.lit(x) for code, all_ in names.items() for name in all_.split() for x in (name, code)]), key)


def _suffix(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z]+://[^/:?#]*\.([a-z]{2})(?:[:/?#]|$)", 1)


def _of_suffix(top: Column) -> Column:
    return _looked_up(top, SUFFIXES)


def suffix_language(url: Column) -> Column:
    return _of_suffix(_suffix(url))


def suffix_of(urls: Column) -> Column:
    """The language that most of a record's addresses point to by their suffix; of equals the later code. Null where none
    points to any."""
    found = F.array_compact(F.transform(F.transform(urls, _suffix), _of_suffix))
    count = lambda f: F.transform(F.array_distinct(f), lambda x: F.struct(F.size(F.filter(f, lambda y: y == x)).alias("n"), x.alias("lang")))
    counted = F.transform(F.array(found), lambda f: F.array_max(count(f)))  # an array of one: the suffixes are read once
    return F.when(F.size(urls) > 0, counted[0]["lang"])


def host_priors(records: DataFrame) -> DataFrame:
    """rec_kind, host, prior (array of LANGUAGES' length): label counts of a host, smoothed towards those of its kind,
    which are smoothed towards the corpus, which is smoothed towards even shares."""
    n = [F.count(F.when(F.col("declared") == x, 1)).alias(x) for x in LANGUAGES]
    host = materialize(records.groupBy("rec_kind", "host").agg(*n), "hosts")  # one scan, read by all levels
    kind = host.groupBy("rec_kind").agg(*[F.sum(x).alias(f"k_{x}") for x in LANGUAGES])
    corpus = kind.agg(*[F.sum(f"k_{x}").alias(f"c_{x}") for x in LANGUAGES])
    total = lambda p: sum((F.coalesce(F.col(p + x), F.lit(0)) for x in LANGUAGES), F.lit(0))
    out = host.join(kind, "rec_kind").join(corpus, how="cross")  # one row
    even = 1.0 / len(LANGUAGES)
    share = {}
    for x in LANGUAGES:
        c = (F.coalesce(F.col(f"c_{x}"), F.lit(0)) + SMOOTHING * even) / (total("c_") + SMOOTHING)
        k = (F.col(f"k_{x}") + SMOOTHING * c) / (total("k_") + SMOOTHING)
        share[x] = (F.col(x) + SMOOTHING * k) / (total("") + SMOOTHING)
    return out.select("rec_kind", "host", F.array(*[share[x].cast("float") for x in LANGUAGES]).alias("prior"))


def prose_chunks(text: str) -> list[str]:
    """The text without code, links, tables and lists, as chunks of running text."""
    if not text.isascii():
        text = glyphs.canonical(text)[0]
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    if "://" in text or "www." in text or "@" in text or "<" in text:
        text = _LINK.sub(" ", text)
    out = []
    hint = _CODE_HINT.search(text)
    for chunk in text.split("\n\n"):
        lines = [x for x in chunk.split("\n") if x.strip() and not (hint and _CODE_LINE.search(x))]
        while lines:
            quoted = lines[0].startswith(">")  # a quotation is a chunk of its own
            n = next((i for i, x in enumerate(lines) if x.startswith(">") != quoted), len(lines))
            part, lines = [x.lstrip("> ") for x in lines[:n]], lines[n:]
            bare = [x for x in part if "|" not in x and "\t" not in x and "  " not in x.strip() or _END.search(x)]
            if 2 * len(bare) < len(part):
                continue
            joined = " ".join(bare)
            if sum(bool(_BULLET.match(x)) for x in bare) >= max(2, 0.6 * len(bare)):
                continue
            words = joined.count(" ") + 1
            if 5 * len(_MIXED.findall(joined)) >= words + 5:  # codes rather than words
                continue
            if not _END.search(joined) and not joined.endswith(":"):
                if len(bare) >= 3 and words <= 6 * len(bare) and sum(map(len, bare[:-1])) < 30 * (len(bare) - 1):
                    continue
                cuts = len(_SEPARATOR.findall(joined))
                if cuts >= 4 and (words < 5 * (cuts + 1) or _HAN.search(joined)):
                    continue
            out.append(joined)
    return out


class Model:
    """Word likelihoods of the languages that share the Latin script."""

    def __init__(self, words: dict[str, int], weights: np.ndarray, common: np.ndarray, grams: dict[str, np.ndarray]):
        self.words, self.weights, self.common, self.grams = words, weights, common, grams

    @staticmethod
    def count(rows: list[tuple[str, int]], max_words: int) -> Model:
        seen: list[Counter] = [Counter() for _ in range(LATIN)]
        docs: list[Counter] = [Counter() for _ in range(LATIN)]
        size = [0] * LATIN
        for text, lang in rows:
            words = [w for c in prose_chunks(text) for w in _WORD.findall(c.lower())]
            seen[lang].update(words)
            docs[lang].update(set(words))
            size[lang] += 1
        total: Counter = Counter()
        for c in seen:
            total.update(c)
        kept = [w for w, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:max_words] if n >= 2]
        index = {w: i for i, w in enumerate(kept)}
        n = np.array([[c[w] for c in seen] for w in kept], float).reshape(-1, LATIN)
        spread = n.sum(0)
        weights = np.log((n + 0.5) / (spread + 0.5 * max(len(kept), 1)))
        common = np.array([[d[w] >= max(3, 0.05 * s) for d, s in zip(docs, size)] for w in kept], bool).reshape(-1, LATIN)
        grams: dict[str, np.ndarray] = {}
        for w, row in zip(kept, n):
            for g in _grams(w):
                grams[g] = grams.get(g, 0.0) + (row > 0)
        types = (n > 0).sum(0) + 1.0
        grams = {g: np.log((v + 0.5) / types).astype("float32") for g, v in grams.items() if v.sum() >= 3}
        return Model(index, weights.astype("float32"), common, grams)

    def unknown(self, word: str) -> np.ndarray:
        """A weak vote by character trigrams for a word outside the vocabulary."""
        found = [self.grams[g] for g in _grams(word) if g in self.grams]
        if not found:
            return np.zeros(LATIN, "float32")
        v = np.sum(found, 0) / max(2.0, len(found) / 2)
        return np.clip(v - v.mean(), -1.0, 1.0).astype("float32") * 0.5


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def fit(records: DataFrame, per_language: int = 2500, max_words: int = 60000) -> Model:
    """The word model, from at most about ``per_language`` labelled rows of each language chosen by a hash of their ids;
    rows of 40 to 5,000 characters, so that the sample's size is bounded too."""
    labelled = records.where("declared is not null and length(text) between 40 and 5000")
    n = {r["declared"]: r["n"] for r in records.groupBy("declared").agg(F.count("*").alias("n")).collect() if r["declared"]}
    u = F.pmod(F.xxhash64("rec_kind", "rec_id"), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map(*[F.lit(v) for x in LANGUAGES[:LATIN] for v in (x, per_language / max(n.get(x, 0), 1))])
    keep = u < F.try_element_at(share, F.col("declared"))
    # rows beyond the bound can only come from chance in the hash
    sample = labelled.where(keep).select("text", "declared").limit(2 * LATIN * per_language).toPandas()
    rows = [(t, LANGUAGES.index(x)) for t, x in zip(sample["text"], sample["declared"])]
    first = Model.count(rows, max_words)
    best = _best(first, [t for t, _ in rows])
    return Model.count([r for r, b in zip(rows, best) if b in (r[1], -1)], max_words)


def _best(model: Model, texts: list[str]) -> list[int]:
    out = []
    for t in texts:
        ids = [i for w in _WORD.findall(t.lower()) if (i := model.words.get(w)) is not None]
        out.append(int(model.weights[ids].sum(0).argmax()) if ids else -1)
    return out


class Scorer:
    def __init__(self, model: Model):
        self.words = dict(model.words)
        self.rows = [*model.weights]
        self.model = model
        self.known = len(model.words)
        self.matrix = model.weights
        self.common = model.common

    def index(self, word: str) -> int:
        i = len(self.rows)
        self.rows.append(self.model.unknown(word))
        self.words[word] = i
        return i

    def ready(self) -> None:
        if len(self.rows) != len(self.matrix):
            self.matrix = np.array(self.rows, "float32").reshape(-1, LATIN)
            self.common = np.zeros((len(self.rows), LATIN), bool)
            self.common[: self.known] = self.model.common

    def forget(self) -> None:
        """Keep the words seen outside the vocabulary within bounds."""
        if len(self.rows) > self.known + 300_000:
            self.words = dict(self.model.words)
            del self.rows[self.known :]
            self.matrix, self.common = self.model.weights, self.model.common

    def stretches(self, texts: list[str | None], bias: np.ndarray) -> list[list[tuple[int, float, int, int, bool]]]:
        """For each text its runs of sentences in one language: language, confidence, words, letters and whether they
        are prose. ``bias`` has the evidence beside the text, a row for each text."""
        owner: list[int] = []
        script: list[int] = []  # row of kinds, or -1: told by words
        kinds: list[tuple[int, int, int, int, int]] = []
        letters: list[int] = []
        count: list[int] = []
        flat: list[int] = []
        starts: list[int] = []
        get, find, index = self.words.get, _WORD.findall, self.index
        for t, text in enumerate(texts):
            if not text:
                continue
            for chunk in prose_chunks(text):
                chunk = chunk.lower()
                foreign = not chunk.isascii() and (_HAN.search(chunk) or _CYRILLIC.search(chunk))
                for seg in _SENTENCE.split(chunk):
                    if not seg or len(seg) < 4:
                        continue
                    words = find(seg)
                    size = sum(map(len, words))
                    if foreign:
                        han, cyr = len(_HAN.findall(seg)), len(_CYRILLIC.findall(seg))
                        latin = size - han - cyr
                        if (han or cyr) and (han * 2 > latin + cyr or cyr > latin):
                            zh = han * 2 > cyr
                            kana, russian = len(_KANA.findall(seg)), len(_RUSSIAN.findall(seg))
                            owner.append(t)
                            script.append(len(kinds))
                            kinds.append((han, kana, russian, cyr - russian, max(latin - kana, 0)))
                            letters.append(han if zh else cyr)
                            count.append(han if zh else len(words))
                            starts.append(len(flat))
                            continue
                    n = len(words)
                    if n < 2 or n > 5 and len(set(words)) * (3 if n > 11 else 2.5) <= n:  # repetition
                        continue
                    owner.append(t)
                    script.append(-1)
                    letters.append(size)
                    count.append(n)
                    starts.append(len(flat))
                    flat += [i if (i := get(w)) is not None else index(w) for w in words]
        self.ready()
        out: list[list] = [[] for _ in texts]
        if not owner or not len(self.matrix):
            return out
        ids = np.array(flat, int)
        bounds = np.array([*starts, len(flat)])
        cum = np.zeros((len(ids) + 1, LATIN))
        np.cumsum(self.matrix[ids], 0, out=cum[1:])
        total = cum[bounds[1:]] - cum[bounds[:-1]] + bias[owner][:, :LATIN]
        hits = np.zeros((len(ids) + 1, LATIN), "int32")
        np.cumsum(self.common[ids], 0, out=hits[1:])
        hit = hits[bounds[1:]] - hits[bounds[:-1]]
        best = total.argmax(1)
        top = np.partition(total, LATIN - 2, 1)
        sure = top[:, -1] - top[:, -2] >= MARGIN
        p = 1.0 / np.exp(np.maximum(total - top[:, -1:], -700)).sum(1)
        told = np.array(script)
        by_script = told >= 0
        lang = np.where(sure, best, -1)
        if kinds:
            lang[by_script], p[by_script] = _by_script(np.array(kinds, float), bias[np.array(owner)[by_script]])
        seen = np.where(by_script, count, hit[np.arange(len(best)), best]).tolist()
        lang, p = lang.tolist(), p.tolist()
        run, last = None, -1
        for t, x, q, n, size, h in zip(owner, lang, p, count, letters, seen):
            if t != last:
                run, last = None, t
            if x < 0:  # too little to tell: part of whatever it stands in
                if run and n <= 3:
                    run[2] += n
                    run[3] += size
                continue
            if run and run[0] == x:
                run[1], run[2], run[3], run[4] = 1 - (1 - run[1]) * (1 - q), run[2] + n, run[3] + size, run[4] + h
                run[5] = max(run[5], size)
            else:
                run = [x, q, n, size, h, size]
                out[t].append(run)
        return [[self._prose(r) for r in runs] if runs else runs for runs in out]

    @staticmethod
    def _prose(run: list) -> tuple[int, float, int, int, bool]:
        lang, p, words, letters, hit, longest = run
        if lang == 9:
            prose = longest >= MIN_HAN
        else:
            prose = words >= MIN_WORDS and longest >= MIN_LETTERS and (lang == 8 or hit >= max(1, words // 12))
        return lang, min(p, 0.9999), words, letters, prose


def _by_script(kinds: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of text in which another script than Latin prevails, -1 for none of them, and its probability: letters
    by script and the evidence beside the text, fused."""
    shares = np.log([SCRIPT_SHARES.get(x, SCRIPT_SHARES["latin"]) for x in [*LANGUAGES, "cyrillic", "han"]])
    total = kinds @ shares.T + np.hstack([bias, np.full((len(bias), 2), math.log(NONE_SHARE))])
    top = total.max(1, keepdims=True)
    p = 1.0 / np.exp(np.maximum(total - top, -700)).sum(1)
    best = total.argmax(1)
    return np.where(best < len(LANGUAGES), best, -1), p


def stretches(records: DataFrame, model: Model, min_letters: int = 0) -> DataFrame:
    """rec_kind, rec_id, declared, seq, lang, confidence, words, letters, prose: one row for each stretch in one language.

    ``records`` has rec_kind, rec_id, host, declared, suffix and text. Null or empty texts and texts without prose have
    no stretch; a null host has an even prior. Columns beyond these are ignored. Records of fewer than ``min_letters`` letters have none."""
    records = records.select("rec_kind", "rec_id", "host", "declared", "suffix", "text")
    shared = records.sparkSession.sparkContext.broadcast(model)
    priors = materialize(host_priors(records), "priors")
    if priors.count() <= MAX_BROADCAST_HOSTS:
        rows = records.join(F.broadcast(priors), ["rec_kind", "host"], "left")
    else:  # a host may hold a third of the texts: its rows are spread over SALTS tasks
        priors = priors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int")
        rows = records.withColumn("salt", salt).join(priors, ["rec_kind", "host", "salt"], "left")
    rows = rows.select("rec_kind", "rec_id", "declared", "suffix", "prior", "text")

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value)
        names = {x: i for i, x in enumerate(LANGUAGES)}
        say = lambda x, p: _vote(names.get(x), p)
        votes = {(a, b): say(a, DECLARED_RIGHT) + say(b, SUFFIX_RIGHT) for a in [None, *LANGUAGES] for b in [None, *LANGUAGES]}
        for batch in batches:
            d = {k: batch.column(k).to_pylist() for k in ("declared", "suffix", "prior", "text")}
            cols: list[list] = [[] for _ in range(7)]
            logs: dict = {None: np.full(len(LANGUAGES), math.log(0.1))}
            bias = []
            for a, b, prior in zip(d["declared"], d["suffix"], d["prior"]):
                key = prior and tuple(prior)
                if key not in logs:
                    logs[key] = np.log(np.maximum(prior, 1e-6))
                bias.append(votes[a, b] + logs[key])
            for i, found in enumerate(scorer.stretches(d["text"], np.array(bias).reshape(-1, len(LANGUAGES)))):
                if found and len(d["text"][i]) < 4 * min_letters and sum(map(str.isalpha, d["text"][i])) < min_letters:
                    continue
                for seq, (lang, p, words, letters, prose) in enumerate(found):
                    for c, v in zip(cols, (i, seq, LANGUAGES[lang], p, words, letters, prose)):
                        c.append(v)
            scorer.forget()
            at = pa.array(cols[0], pa.int32())
            take = [batch.column(k).take(at) for k in ("rec_kind", "rec_id", "declared")]
            types = (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.record_batch(
                [*take, *[pa.array(c, x) for c, x in zip(cols[1:], types)]],
                names=["rec_kind", "rec_id", "declared", "seq", "lang", "confidence", "words", "letters", "prose"],
            )

    schema = "rec_kind string, rec_id long, declared string, seq int, lang string, confidence double, words int, letters int, prose boolean"
    return rows.mapInArrow(run, schema)


def _vote(lang: int | None, right: float) -> np.ndarray:
    if lang is None:
        return np.zeros(len(LANGUAGES))
    out = np.full(len(LANGUAGES), math.log((1 - right) / (len(LANGUAGES) - 1)))
    out[lang] = math.log(right)
    return out


def undeclared(records: DataFrame, model: Model, min_letters: int = 40) -> DataFrame:
    """rec_kind, rec_id, lang: the languages in which a record of at least ``min_letters`` letters has prose of about a
    sentence or more, unless its declared language names them. Repeated rows count once."""
    found = stretches(records, model, min_letters)
    other = F.col("declared").isNull() | (F.col("lang") != F.col("declared"))
    return found.where(F.col("prose") & other).select("rec_kind", "rec_id", "lang").distinct()

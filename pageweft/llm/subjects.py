"""Problem 8: the subject areas of each document.

Documents are embedded by term weighting (inverse document frequency over the whole corpus) and a truncated singular
value decomposition of the document-term matrix, computed by subspace iteration whose passes cover every document.
Labelled documents seed one centroid for each subject; sentences are assigned by cosine to the centroids, and the
assigned sentences of the whole corpus refine centroids and term weights again and again. A document has every subject
that enough of its sentences deal with.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize
from . import glyphs

#: Terms embedded (the most frequent of each language) and dimensions: these bound what the driver and each task hold. All
#: other terms of at least MIN_DF documents are counted and weighted too, by joins.
MAX_TERMS, DIMENSIONS, MIN_DF = 40_000, 32, 3
#: Labelled documents used as seeds, at most.
MAX_SEEDS = 20_000
#: By how much the best subject of a sentence must lead, in the rounds of refinement and at last.
LEADS = (0.6, 0.7, 0.8, 1.0)
#: Rounds in which centroids move, and the cosine from which a document belongs to one.
ROUNDS, MIN_COSINE = 6, 0.15
#: The cosine between a centroid and its moved self from which it counts as settled.
SETTLED = 0.9999
#: How strongly the seeds hold a moving centroid.
ANCHOR = 0.7
#: Words without a full stop from which text is taken to be several sentences.
LONG = 40
#: Sentences that a term's own counts must outweigh.
CAUTION = 4.0

_FENCE = re.compile(r"```.*?(?:```|\Z)|https?://\S+|www\.\S+", re.S)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。？！])|\n+")
_WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+")


class _Numbers(dict):
    """63-bit numbers of words, by hash; the lowest two bits stay free for the kind of term: 0 a word, 1 a pair of Han
    characters, 2 a pair of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        n = self[word] = xxhash.xxh3_64_intdigest(word) >> 3 << 2
        return n


_NUMBER = _Numbers()


def sentences(text: str | None) -> list[list[int]]:
    """The words of each sentence as numbers, of Han text pairs of characters. A sentence counts once however often the
    text repeats it."""
    if not text:
        return []
    if not text.isascii():
        text = glyphs.canonical(text)[0]
    if "```" in text or "://" in text or "www." in text:
        text = _FENCE.sub("\n", text)
    out, seen = [], set()
    for s in _SENTENCE.split(text.lower()):
        if not s or s in seen:
            continue
        seen.add(s)
        words = _WORD.findall(s)
        step = LONG // 2 if len(words) > LONG else max(len(words), 1)  # typed without full stops: cut to usual lengths
        for i in range(0, len(words), step):
            row: list[int] = []
            for w in words[i : i + step]:
                if "㐀" <= w[0] <= "鿿":
                    row += [_NUMBER[w[j : j + 2]] | 1 for j in range(len(w) - 1)]
                else:
                    row.append(_NUMBER[w])
            if row:
                out.append(row)
    return out


def numbered(docs: DataFrame, id_col: str, text: str, group: Column) -> DataFrame:
    """id, grp, words, sizes: the words of each document's sentences in one array, and how many each sentence has. The
    texts are read and cut here only."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = [sentences(t) for t in part.column(2).to_pylist()]
                flat = pa.array(np.fromiter((x for r in rows for s in r for x in s), np.int64))
                sizes = pa.array(np.fromiter((len(s) for r in rows for s in r), np.int32))
                lists = [_lists(np.array([sum(map(len, r)) for r in rows]), flat), _lists(np.array([len(r) for r in rows]), sizes)]
                yield pa.record_batch([part.column(0), part.column(1), *lists], names=["id", "grp", "words", "sizes"])

    src = docs.select(F.col(id_col).alias("id"), F.coalesce(group, F.lit("")).alias("grp"), text)
    return src.mapInArrow(run, "id long, grp string, words array<long>, sizes array<int>")


def _lists(lengths: np.ndarray, values):
    """An Arrow column of lists of these lengths."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("int32"), pa.int32()), values)


def _terms(batch, step: int = 1000):
    """Of each ``step`` rows of ``numbered``: the rows, their terms (words and pairs of neighbours) in order of sentences,
    the sentence of each term, and how many sentences each document has."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        sizes = part.column(batch.schema.get_field_index("sizes"))
        words = part.column(batch.schema.get_field_index("words")).flatten().to_numpy(zero_copy_only=False).astype("int64")
        sent = np.repeat(np.arange(len(sizes.flatten())), sizes.flatten().to_numpy(zero_copy_only=False))
        pair = (sent[1:] == sent[:-1]) & ((words[1:] | words[:-1]) & 1 == 0)
        u = words.astype("uint64")
        pairs = (u[:-1] * np.uint64(0x9E3779B97F4A7C15) + u[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[pair]
        pairs = (pairs >> np.uint64(3) << np.uint64(2) | np.uint64(2)).astype("int64")
        sents = np.concatenate([sent, sent[:-1][pair]])
        order = np.argsort(sents, kind="stable")
        yield part, np.concatenate([words, pairs])[order], sents[order], np.diff(sizes.offsets.to_numpy())


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct combination of the keys stands first in its sorted order, as an index, and how often it occurs."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], 0)
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def document_frequencies(words: DataFrame) -> DataFrame:
    """term, df, main over all documents: in how many a term is, and the group (language) of documents it is in most.
    Counted batch by batch before the shuffle."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, terms, sents, n in _terms(b):
                doc = np.repeat(np.arange(len(n)), n)[sents]
                once, _ = _runs(doc, terms)
                grp = part.column(1).dictionary_encode()
                code = grp.indices.to_numpy(zero_copy_only=False)[doc[once]]
                at, df = _runs(code, terms[once])
                yield pa.record_batch([pa.array(terms[once][at]), grp.dictionary.take(pa.array(code[at])), pa.array(df)], names=["term", "grp", "df"])

    parts = words.select("id", "grp", "words", "sizes").mapInArrow(run, "term long, grp string, df long")
    by_group = parts.groupBy("term", "grp").agg(F.sum("df").alias("df"))
    main = F.max_by("grp", F.struct((F.col("grp") != "").alias("named"), "df", "grp"))
    return by_group.groupBy("term").agg(F.sum("df").alias("df"), main.alias("main"))


def _found(vocabulary: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each term in the sorted vocabulary, and whether it is there."""
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1) if len(vocabulary) else np.zeros(len(terms), int)
    return at, (vocabulary[at] == terms) if len(vocabulary) else np.zeros(len(terms), bool)


def _indexed(words: DataFrame, shared, blank: int) -> DataFrame:
    """id, sents: each document's sentences as arrays of term numbers; ``blank`` stands for a sentence without any."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, terms, sents, n in _terms(b):
                at, hit = _found(shared.value, terms)
                bare = np.flatnonzero(np.bincount(sents[hit], minlength=n.sum()) == 0)
                owner, index = np.concatenate([sents[hit], bare]), np.concatenate([at[hit], np.full(len(bare), blank)])
                order = np.argsort(owner, kind="stable")
                rows = _lists(np.bincount(owner, minlength=n.sum()), pa.array(index[order].astype("int32")))
                yield pa.record_batch([part.column(0), _lists(n, rows)], names=["id", "sents"])

    return words.select("id", "grp", "words", "sizes").mapInArrow(run, "id long, sents array<array<int>>")


def _occurrences(words: DataFrame, shared, tail: DataFrame) -> DataFrame:
    """id, s, key, grp, n: how often the sentence number s of a document holds a term of ``tail`` (key, grp); a repeated
    document counts once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part, terms, sents, n in _terms(b):
                far = ~_found(shared.value, terms)[1]
                terms, sents = terms[far], sents[far]
                at, times = _runs(sents, terms)
                doc = np.repeat(np.arange(len(n)), n)[sents[at]]
                place = sents[at] - (np.cumsum(n) - n)[doc]
                yield pa.record_batch(
                    [part.column(0).take(pa.array(doc)), pa.array(place.astype("int32")), pa.array(terms[at]), pa.array(times.astype("int32"))],
                    names=["id", "s", "key", "n"],
                )

    places = words.select("id", "grp", "words", "sizes").mapInArrow(run, "id long, s int, key long, n int")
    return places.join(tail, "key").dropDuplicates(["id", "s", "key"])


def _flat(batch, step: int = 500):
    """Of each ``step`` documents: first row, term numbers, starts of sentences among them, sentences of each document."""
    for at in range(0, batch.num_rows, step):
        col = batch.slice(at, step).column(batch.schema.get_field_index("sents"))
        n = np.diff(col.offsets.to_numpy())
        sents = col.flatten()
        sizes = np.diff(sents.offsets.to_numpy())
        terms = sents.flatten().to_numpy(zero_copy_only=False)
        yield at, terms, np.concatenate([[0], np.cumsum(sizes)]).astype(int), n


def _sum_by(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(rows[order], first, 0)


def _embedded(batch, idf: np.ndarray, basis: np.ndarray, group: np.ndarray):
    """Of each part of a batch: first row, rows with terms, their main group, and of each term its row among these, its
    number and its weight (0 outside the document's main group, normalised by document); the rows' embeddings."""
    groups = int(group.max()) + 1
    for at, terms, starts, n in _flat(batch):
        doc = np.repeat(np.arange(len(n)), np.diff(starts[np.concatenate([[0], np.cumsum(n)])]))
        told = idf[terms] >= 0  # the blank term says nothing
        doc, terms = doc[told], terms[told]
        if not len(doc):
            continue
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        full = doc[first]
        owner = np.repeat(np.arange(len(full)), np.diff(np.append(first, len(doc))))
        votes = np.bincount(owner * groups + group[terms], minlength=len(full) * groups).reshape(-1, groups)
        main = votes.argmax(1)
        w = np.where(group[terms] == main[owner], idf[terms], 0.0)
        norm = np.sqrt(np.add.reduceat(w * w, first))
        w = (w / np.maximum(norm, 1e-9)[owner]).astype("float32")
        yield at, full, main, owner, terms, w, np.add.reduceat(basis[terms] * w[:, None], first, 0)


def _packed(keys: np.ndarray, rows: np.ndarray):
    """An Arrow batch of keys and their rows of numbers as bytes."""
    import pyarrow as pa

    return pa.record_batch([pa.array(keys.astype("int32")), pa.array([r.tobytes() for r in rows], pa.binary())], names=["key", "v"])


def _summed(table: DataFrame, run, size: int, width: int) -> np.ndarray:
    """The sums by key of the rows of ``width`` numbers that ``run`` yields, as an array of ``size`` rows. The sums meet by
    key and come to the driver as bytes, a row for each task."""

    def add(batches):
        import pyarrow as pa

        keys, total = np.zeros(0, "int32"), np.zeros((0, width))
        for b in batches:
            if b.num_rows:
                got = np.frombuffer(b"".join(b.column(1).to_pylist()), "float64").reshape(-1, width)
                keys, total = _sum_by(np.concatenate([keys, b.column(0).to_numpy()]), np.concatenate([total, got]))
        yield pa.record_batch([pa.array([keys.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["k", "v"])

    out = np.zeros((size, width))
    for r in table.mapInArrow(run, "key int, v binary").repartition("key").mapInArrow(add, "k binary, v binary").toLocalIterator():
        out[np.frombuffer(r["k"], "int32")] = np.frombuffer(r["v"], "float64").reshape(-1, width)
    return out


def _gram_times(table: DataFrame, idf: np.ndarray, q: np.ndarray, group: np.ndarray) -> np.ndarray:
    """AᵀA·q for the matrix A of all documents' weighted, normalised terms, each document within its main group. Every
    task adds up its documents and sends one row of at most DIMENSIONS numbers for each term it met."""
    shared = table.sparkSession.sparkContext.broadcast((idf.astype("float32"), q.astype("float32"), group))

    def run(batches):
        weight, basis, grp = shared.value
        total = np.zeros(basis.shape)
        met = np.zeros(len(weight), bool)
        for b in batches:
            for _, _, _, owner, terms, w, y in _embedded(b, weight, basis, grp):
                keys, sums = _sum_by(terms, y[owner] * w[:, None])
                total[keys] += sums
                met[keys] = True
        at = np.flatnonzero(met)
        for i in range(0, len(at), 2000):
            yield _packed(at[i : i + 2000], total[at[i : i + 2000]])

    out = _summed(table, run, *q.shape)
    shared.destroy()  # nobody keeps a model of an earlier pass
    return out


def term_vectors(table: DataFrame, idf: np.ndarray, group: np.ndarray, k: int = DIMENSIONS, passes: int = 3) -> np.ndarray:
    """The leading right singular vectors of each group's part of the document-term matrix, a row for each term."""

    def orthonormal(y: np.ndarray) -> np.ndarray:
        out = np.zeros((len(y), k))
        for g in range(int(group.max()) + 1):
            rows = np.flatnonzero(group == g)
            q = np.linalg.qr(y[rows])[0]
            out[rows, : q.shape[1]] = q
        return out

    q = orthonormal(np.random.default_rng(7).standard_normal((len(idf), k)))
    for _ in range(passes):
        q = orthonormal(_gram_times(table, idf, q, group) + 1e-9 * q)
    return q


def embeddings(table: DataFrame, idf: np.ndarray, vectors: np.ndarray, group: np.ndarray) -> DataFrame:
    """id, main, v: main group and embedding of each document with embedded terms, written once."""
    shared = table.sparkSession.sparkContext.broadcast((idf.astype("float32"), vectors.astype("float32"), group))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at, full, main, _, _, _, y in _embedded(b, *shared.value):
                lists = _lists(np.full(len(y), y.shape[1]), pa.array(y.ravel().astype("float32")))
                yield pa.record_batch([b.column(0).take(pa.array(at + full)), pa.array(main.astype("int32")), lists], names=["id", "main", "v"])

    out = materialize(table.select("id", "sents").mapInArrow(run, "id long, main int, v array<float>"), "embeddings")
    shared.destroy()
    return out


def _centres(rows: DataFrame, groups: int, subjects: int, mean, centre, labels: str | None = None):
    """Sums and numbers of embeddings by group and subject: of labelled documents by their labels, of all by the nearest
    centroid, or, without centroids, all in one."""
    width = DIMENSIONS + 1

    def run(batches):
        total = np.zeros((groups, subjects, width))
        for b in batches:
            if not b.num_rows:
                continue
            main = b.column(1).to_numpy()
            y = np.hstack([b.column(2).flatten().to_numpy().reshape(b.num_rows, -1), np.ones((b.num_rows, 1))])
            if labels:
                for m, e, given in zip(main, y, b.column(3).to_pylist()):
                    for x in given:
                        total[m, x] += e / len(given)
            elif centre is None:
                np.add.at(total[:, 0], main, y)
            else:
                s = _nearest(y[:, :-1], main, mean, centre)
                np.add.at(total, (main[s >= 0], s[s >= 0]), y[s >= 0])
        yield _packed(np.arange(groups * subjects), total.reshape(-1, width))

    out = _summed(rows.select("id", "main", "v", *([labels] if labels else [])), run, groups * subjects, width).reshape(groups, subjects, width)
    return out[:, :, :-1], out[:, :, -1]


def _nearest(y: np.ndarray, main: np.ndarray, mean: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The subject whose centroid is nearest by cosine around the mean of the language; -1 where none is near."""
    e = _unit(y - mean[main])
    cos = np.einsum("dk,dsk->ds", e, centre[main])
    return np.where(cos.max(1) >= MIN_COSINE, cos.argmax(1), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


def refine(rows: DataFrame, seeds: DataFrame, groups: int, subjects: int):
    """The mean embedding of each language and its subjects' unit centroids: those of the seeds, moved to the mean of the
    documents nearest to them, again and again over the embeddings of all documents, until they stay."""
    total, n = _centres(rows, groups, subjects, None, None)
    mean = total.sum(1) / np.maximum(n.sum(1), 1)[:, None]
    total, n = _centres(seeds, groups, subjects, None, None, "given")
    seed = np.where(n[:, :, None] > 0, _unit(total / np.maximum(n, 1e-9)[:, :, None] - mean[:, None]), 0.0)
    centre = seed
    for _ in range(ROUNDS):
        total, n = _centres(rows, groups, subjects, mean, centre)
        moved = _unit(_unit(total / np.maximum(n, 1e-9)[:, :, None] - mean[:, None]) + ANCHOR * seed)
        last, centre = centre, np.where((n[:, :, None] > 0) & (seed != 0).any(2)[:, :, None], moved, seed)
        if (last * centre).sum(2)[(seed != 0).any(2)].min(initial=1.0) > SETTLED:
            break
    return mean, centre


class Areas:
    """Coordinates of the terms by subject, and the centroids of the subjects among sentences.

    A sentence is embedded as the sum of its terms' coordinates; it belongs to the centroid with the greatest cosine, if the
    lead over the next one, in units of the sentence's length, is great enough."""

    def __init__(self, counts: np.ndarray, idf: np.ndarray, vectors: np.ndarray, group: np.ndarray, more: np.ndarray | float = 0.0, centre: np.ndarray | None = None):
        """``more``: counts of terms that aren't embedded, by group and subject. ``centre``: the centroids, at first the
        axes."""
        n = counts.sum(1)
        subjects = counts.shape[1]
        base = np.full((group.max(initial=0) + 1, subjects), 1.0)
        np.add.at(base, group, counts)
        base += more
        base /= base.sum(1, keepdims=True)
        self.base = base
        usual = base[group]  # how the subjects share the text of a term's language
        unit = _unit(vectors)
        share = (counts + CAUTION * usual) / (n + CAUTION)[:, None]
        pull = counts * (idf * _surprise(share, usual))[:, None]
        middle = np.zeros((len(base), subjects, vectors.shape[1]))
        for s in range(subjects):
            np.add.at(middle[:, s], group, pull[:, s : s + 1] * unit)
        near = np.maximum(np.einsum("tk,tsk->ts", unit, _unit(middle)[group]), 0) ** 2 + 1e-3
        near /= near.sum(1, keepdims=True)
        # a term's place among the subjects: its own counts as far as they go, else its cosines to the centroids
        place = (counts + CAUTION * (0.5 * usual + 0.5 * near)) / (n + CAUTION)[:, None]
        self.at = (_surprise(place, usual)[:, None] * np.log(place / usual)).astype("float32")
        self.at[idf < 0] = 0
        self.centre = np.eye(subjects) if centre is None else centre

    def embedded(self, terms: np.ndarray, starts: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The embedding of each sentence. ``more``: sentences and what terms that aren't embedded add to them."""
        if len(starts) < 2:
            return np.zeros((0, len(self.centre)))
        e = np.add.reduceat(self.at[terms], starts[:-1], 0).astype("float64")
        if more is not None:
            e[more[0]] += more[1]
        return e

    def judge(self, e: np.ndarray, lead: float) -> np.ndarray:
        """The subject of each sentence by the cosine of its embedding to the centroids, -1 where none leads by ``lead``."""
        size = np.linalg.norm(e, axis=1)
        cos = _unit(e) @ self.centre.T
        top = np.partition(cos, cos.shape[1] - 2, 1) if cos.shape[1] > 1 else np.hstack([np.zeros_like(cos), cos])
        return np.where((size * (top[:, -1] - top[:, -2]) >= lead) & (size * top[:, -1] >= lead / 4), cos.argmax(1), -1)

    def moved(self, sums: np.ndarray) -> np.ndarray:
        """The centroids moved to the mean direction of the sentences that belong to them, held by the axes."""
        return _unit(_unit(sums) + ANCHOR * np.eye(len(sums)))


def _surprise(share: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """0 where a term is spread like all text of its language, 1 where it belongs to a single subject."""
    whole = -np.log(np.take_along_axis(usual, (share / usual).argmax(1)[:, None], 1))[:, 0]
    return np.clip((share * np.log(share / usual)).sum(1) / np.maximum(whole, 1e-9), 0, 1)


def _counted(table: DataFrame, shared, size: int, subjects: int, lead: float) -> tuple[np.ndarray, np.ndarray]:
    """Sentences of each subject that hold each term: of all documents by their nearest centroid or, with areas, of all
    sentences by themselves; and the sums of these sentences' unit embeddings by subject."""

    def run(batches):
        weight, basis, grp, middle, near, areas = shared.value
        total = np.zeros((size + subjects, subjects))
        for b in batches:
            if areas is None:
                for _, _, main, owner, terms, _, y in _embedded(b, weight, basis, grp):
                    s = _nearest(y, main, middle, near)[owner]
                    ok = s >= 0  # in any language: a quotation mostly shares its document's subject
                    np.add.at(total, (terms[ok], s[ok]), 1.0)
            else:
                for at, terms, starts, n in _flat(b):
                    e = areas.embedded(terms, starts, _added(b, at, n, subjects))
                    found = areas.judge(e, lead)
                    np.add.at(total, size + found[found >= 0], _unit(e[found >= 0]))
                    s = np.repeat(found, np.diff(starts))
                    np.add.at(total, (terms[s >= 0], s[s >= 0]), 1.0)
        at = np.flatnonzero(total.any(1))
        for i in range(0, len(at), 5000):
            yield _packed(at[i : i + 5000], total[at[i : i + 5000]])

    out = _summed(table, run, size + subjects, subjects)
    return out[:size], out[size:]


def _added(batch, at: int, n: np.ndarray, subjects: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Of the documents from row ``at`` with ``n`` sentences each: numbers of the sentences with terms that aren't embedded,
    and what these add to the subjects; None where the table has no such column."""
    column = batch.schema.get_field_index("added")
    if column < 0:
        return None
    first = np.concatenate([[0], np.cumsum(n)])
    rows = [(first[i] + x["s"], x["g"]) for i, d in enumerate(batch.slice(at, len(n)).column(column).to_pylist()) for x in d or []]
    return np.array([r[0] for r in rows], int), np.array([r[1] for r in rows], "float32").reshape(-1, subjects)


class Tail:
    """Counts and gains of the terms that aren't embedded, kept as tables and joined by term and sentence.

    Such a term has no vector, so that its own counts against its language's usual ones are its whole evidence."""

    def __init__(self, table: DataFrame, places: DataFrame, groups: int, subjects: int):
        self.groups, self.subjects, self.places = groups, subjects, materialize(places, "places")
        held = self.places.groupBy("id").agg(F.collect_set("s").alias("tails"))
        self.table = materialize(table.join(held, "id", "left"), "terms")

    def counted(self, table: DataFrame, shared, lead: float) -> tuple[DataFrame, np.ndarray]:
        """key, grp, subject, n as ``_counted`` has them of embedded terms, and their sums by group and subject."""
        subjects = self.subjects

        def run(batches):
            import pyarrow as pa

            weight, basis, grp, middle, near, areas = shared.value
            for b in batches:
                ids, tails = b.column(b.schema.get_field_index("id")).to_pylist(), b.column(b.schema.get_field_index("tails")).to_pylist()
                out: list[tuple] = []
                if areas is None:
                    for at, full, main, _, _, _, y in _embedded(b, weight, basis, grp):
                        for row, x in zip(full + at, _nearest(y, main, middle, near)):
                            out += [(ids[row], s, x) for s in tails[row] or [] if x >= 0]
                else:
                    for at, terms, starts, n in _flat(b):
                        found = areas.judge(areas.embedded(terms, starts, _added(b, at, n, subjects)), lead)
                        first = np.concatenate([[0], np.cumsum(n)])
                        for i in range(len(n)):
                            out += [(ids[at + i], s, x) for s in tails[at + i] or [] if (x := found[first[i] + s]) >= 0]
                cols = [*zip(*out)] or [[], [], []]
                yield pa.record_batch([pa.array(np.array(c, k)) for c, k in zip(cols, ("int64", "int32", "int32"))], names=["id", "s", "subject"])

        told = table.where("tails is not null").mapInArrow(run, "id long, s int, subject int").dropDuplicates(["id", "s"])
        counts = self.places.join(told, ["id", "s"]).groupBy("key", "grp", "subject").agg(F.sum("n").cast("double").alias("n"))
        counts = materialize(counts, "tail")
        sums = np.zeros((self.groups, subjects))
        for r in counts.groupBy("grp", "subject").agg(F.sum("n").alias("n")).collect():  # groups by subjects
            sums[r["grp"], r["subject"]] = r["n"]
        return counts, sums

    def added(self, counts: DataFrame, base: np.ndarray) -> DataFrame:
        """The table with ``added``: of each sentence with such terms what they add to the subjects, by ``Areas``' rule."""
        each = range(self.subjects)
        wide = counts.groupBy("key", "grp").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("subject") == i, F.col("n"))), F.lit(0.0)) for i in each]).alias("c"))

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    c, usual = np.array(b.column(2).to_pylist()), base[b.column(1).to_numpy()]
                    place = (c + CAUTION * usual) / (c.sum(1) + CAUTION)[:, None]
                    gain = _surprise(place, usual)[:, None] * np.log(place / usual)
                    yield pa.record_batch([b.column(0), pa.array([*gain], pa.list_(pa.float64()))], names=["key", "g"])

        gains = wide.select("key", "grp", "c").mapInArrow(run, "key long, g array<double>")
        rows = self.places.join(gains, "key").groupBy("id", "s").agg(F.array(*[F.sum(F.col("n") * F.col("g")[i]) for i in each]).alias("g"))
        return materialize(self.table.join(rows.groupBy("id").agg(F.collect_list(F.struct("s", "g")).alias("added")), "id", "left"), "added")


def _weights(df: np.ndarray, group: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Squared inverse document frequency within the term's language; pairs of words don't shape the embedding."""
    most = np.zeros(int(group.max()) + 1)
    np.maximum.at(most, group, df)  # nearly every text of a language holds its commonest word
    return np.where(term & 2, 0.0, np.log(1 + most[group] / df) ** 2)


def agreed_labels(labels: DataFrame) -> DataFrame:
    """doc_id, subject: what at least half of a document's raters gave it, null subjects aside and each rater once."""
    rows = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject", "rater").distinct()
    raters = rows.groupBy("doc_id").agg(F.countDistinct("rater").alias("raters"))
    votes = rows.groupBy("doc_id", "subject").agg(F.countDistinct("rater").alias("votes"))
    return votes.join(raters, "doc_id").where("2 * votes >= raters").select("doc_id", "subject")


def subject_sentences(docs: DataFrame, labels: DataFrame, subjects: list[str], lang: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, subject, n_sentences: how many sentences of each document deal with each subject.

    Null, empty and blank texts have none; rows that repeat a document count once. Without any label of a known document
    no subject can be told and the result is empty."""
    context = docs.sparkSession.sparkContext
    words = materialize(numbered(docs.where(F.col(text).isNotNull()), id_col, text, lang), "words")
    df = materialize(document_frequencies(words).where(F.col("df") >= MIN_DF), "frequencies")
    # the same share for each language; what one doesn't need is left to the others
    rank = F.row_number().over(Window.partitionBy("main").orderBy(F.desc("df"), "term"))
    kept = df.withColumn("rank", rank).where(F.col("rank") <= MAX_TERMS).orderBy("rank", "main").limit(MAX_TERMS).select("term", "df", "main").toArrow()
    term = kept.column("term").to_numpy()
    order = np.argsort(term)
    main = kept.column("main").combine_chunks().dictionary_encode()
    if hasattr(main, "combine_chunks"):
        main = main.combine_chunks()
    rank_of = np.argsort(np.argsort(main.dictionary.to_pylist()))
    group = rank_of[main.indices.to_numpy(zero_copy_only=False)][order] if len(term) else np.zeros(0, int)
    groups = sorted(main.dictionary.to_pylist())
    term, freq = term[order], kept.column("df").to_numpy()[order].astype(float)
    idf = _weights(freq, group, term) if len(term) else np.zeros(0)
    blank = len(term)  # stands for sentences whose terms aren't embedded, in a group of its own
    group, idf = np.append(group, len(groups)).astype(int), np.append(idf, -1.0)
    vocabulary = context.broadcast(term)
    table, tail = _indexed(words, vocabulary, blank), None
    if df.count() > len(term):
        number = F.create_map(*[x for i, g in enumerate(groups) for x in (F.lit(g), F.lit(i))])
        embedded = docs.sparkSession.createDataFrame(kept.select(["term"]))
        rest = df.join(embedded, "term", "left_anti").select(F.col("term").alias("key"), number[F.col("main")].alias("grp"))
        tail = Tail(table, _occurrences(words, vocabulary, rest), len(groups) + 1, len(subjects))
    table = tail.table if tail else materialize(table, "terms")
    vocabulary.destroy()
    del kept
    names = {s: i for i, s in enumerate(subjects)}
    index = docs.sparkSession.createDataFrame([*names.items()] or [("", 0)], "subject string, subject_id int")
    given = agreed_labels(labels).join(F.broadcast(index), "subject").groupBy(F.col("doc_id").alias("id"))
    given = given.agg(F.sort_array(F.collect_list("subject_id")).alias("given")).orderBy(F.xxhash64("id")).limit(MAX_SEEDS)
    vectors = term_vectors(table, idf, group)
    rows = embeddings(table, idf, vectors, group)
    mean, centre = refine(rows, rows.join(given, "id"), len(groups) + 1, len(names))
    areas, added, moved = None, table, None
    for lead in (0.0, *LEADS[:-1]):
        shared = context.broadcast((idf.astype("float32"), vectors.astype("float32"), group, mean, centre, None) if areas is None else (None,) * 5 + (areas,))
        counts, sums = _counted(added, shared, len(idf), len(names), lead)
        moved = areas.moved(sums) if areas else None
        more, tail_sums = tail.counted(added, shared, lead) if tail else (None, 0.0)
        shared.destroy()
        areas = Areas(counts, idf, vectors, group, tail_sums, moved)
        added = tail.added(more, areas.base) if tail else table
    shared = context.broadcast(areas)  # lives as long as the result

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column(0).to_numpy()
            for at, terms, starts, n in _flat(b):
                if len(starts) < 2:
                    continue
                found = shared.value.judge(shared.value.embedded(terms, starts, _added(b, at, n, len(subjects))), LEADS[-1])
                owner = np.repeat(np.arange(len(n)), n)
                hits = np.zeros((len(n), len(subjects)), int)
                np.add.at(hits, (owner[found >= 0], found[found >= 0]), 1)
                d, s = np.nonzero(hits)
                yield pa.record_batch(
                    [pa.array(ids[at + d]), pa.array([subjects[x] for x in s], pa.string()), pa.array(hits[d, s].astype("int32"))],
                    names=["doc_id", "subject", "n_sentences"],
                )

    out = added.mapInArrow(run, "doc_id long, subject string, n_sentences int")
    return out.groupBy("doc_id", "subject").agg(F.max("n_sentences").alias("n_sentences"))

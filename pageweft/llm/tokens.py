"""Problem 6: the whole corpus as ids of a public tokenizer.

Texts are cut into pre-tokens in the JVM, once, and written as one array for each document. Equal pre-tokens are gathered
over the whole corpus, each distinct one is encoded once, its ids are joined back, and every document is put together by
position. The most frequent words, at most ``head`` of them, are broadcast, so that they reach their documents without a
shuffle; the rest meets its ids in a shuffled join, where no word is hot any more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize

# White space as Unicode defines it, and the pre-token pattern of byte-level BPE.
_S = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PRETOKEN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + _S + r"\p{L}\p{N}]+|[" + _S + r"]+(?![^" + _S + r"])|[" + _S + r"]+"
)
TOKENIZER = "byte_bpe_50k"
_ENCODERS: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, from the installed package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _ranks(path: str) -> dict[bytes, int]:
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


def bpe(path: str):
    """The tiktoken encoder of a rank file, kept by the Python worker."""
    if path not in _ENCODERS:
        import tiktoken
        from public_tokenizers import PATTERN

        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    return _ENCODERS[path]


def _with_ids(words: DataFrame, path: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        enc = bpe(path)
        one = getattr(enc, "_encode_single_piece", enc.encode_ordinary)  # a pre-token isn't cut again
        for b in batches:
            ids = [one(w) if w else [] for w in b.column(0).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(1)], names=["word", "word_ids", "n"])

    return words.select("word", "n").mapInArrow(run, "word string, word_ids array<int>, n long")


def pretokens(text: Column) -> Column:
    """The pre-tokens of a text in order."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, head: int = 20000) -> DataFrame:
    """``id_col`` and ids (array<int>) of each row, without special tokens; strings that look like special tokens are
    ordinary text. An empty or null text has an empty list. Ids must be unique; a row repeated whole counts once."""
    path = path or tokenizer_path(TOKENIZER + ".tiktoken")
    src = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    cut = materialize(src.where("t is not null and t <> ''").select("id", pretokens(F.col("t")).alias("words")), "words")
    counts = cut.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = materialize(_with_ids(counts, path), "vocabulary")  # each distinct word once
    top = known.orderBy(F.desc("n"), "word").limit(head).select("word", "word_ids")
    frequent = F.broadcast(top)  # at most ``head`` rows
    places = cut.select("id", F.posexplode("words").alias("pos", "word"))
    part = F.concat(F.array("pos"), "word_ids").alias("p")  # sorts by position
    near = places.join(frequent, "word").select("id", part)
    far = places.join(frequent, "word", "left_anti")
    # a word's places within its document travel together
    far = far.groupBy("id", "word").agg(F.collect_list("pos").alias("at")).join(known.select("word", "word_ids"), "word")
    far = far.select("id", F.explode("at").alias("pos"), "word_ids").select("id", part)
    whole = near.unionByName(far).groupBy("id").agg(F.array_sort(F.collect_set("p")).alias("p"))
    ids = whole.select("id", F.flatten(F.transform("p", lambda x: F.slice(x, F.lit(2), F.size(x)))).alias("ids"))
    empty = src.where("t is null or t = ''").select("id", F.array().cast("array<int>").alias("ids")).distinct()
    return ids.unionByName(empty).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """The text behind each row's ids, by a join with the token-byte table (one row per token of the vocabulary)."""
    path = path or tokenizer_path(TOKENIZER + ".tiktoken")
    spark = encoded.sparkSession
    rows = [(int(i), bytearray(b)) for b, i in _ranks(path).items()]
    tokens = spark.createDataFrame(rows, "token int, piece binary")
    flat = encoded.select(F.col(id_col).alias("id"), F.posexplode_outer(ids).alias("pos", "token"))
    parts = flat.join(F.broadcast(tokens), "token", "left")  # the size of a vocabulary
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    text = F.concat_ws("", F.transform("p", lambda x: F.hex(x["piece"])))
    return whole.select(F.col("id").alias(id_col), F.decode(F.unhex(text), "UTF-8").alias("text"))

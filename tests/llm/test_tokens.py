from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pageweft.llm import tokens

TEXTS = [None, "", " ", "\n\n  a", "Hello  world's <|endoftext|> ½²³", "注意 ok　x", "а б", "tail   ", "🙂🙂 ​\u0085x ", "the the the " * 2000]


def _expected(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def test_ids_and_round_trip(spark):
    rows = [(i, t, [1]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, ids array<int>")
    for head in (0, 3, 20000):
        got = tokens.encode(df, head=head)
        assert {r.doc_id: r.ids for r in got.collect()} == {i: _expected(t) for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in tokens.decode(got).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokens.encode(df.limit(0)).count() == 0


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), min_size=20, max_size=40))
def test_any_text(spark, texts):
    texts = [t for t in texts if not any(0xD800 <= ord(c) < 0xE000 for c in t)]
    df = spark.createDataFrame([*enumerate(texts), (-1, "x")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert all(got[i] == _expected(t) for i, t in enumerate(texts))

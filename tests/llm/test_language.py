import pytest
from pyspark.sql import functions as F

from pageweft.llm import language

SENTENCES = {
    "en": ["Nobody in the office told me that the path would be closed.", "I have read that the old tables belong together with this one.", "What is the difference between a tram and a bus?"],
    "de": ["Niemand hat mir gesagt, dass der Weg heute gesperrt ist.", "Ich habe gelesen, dass die alten Tische nicht zusammen gehören.", "Was ist der Unterschied zwischen einem Zug und einem Bus?"],
    "fr": ["Personne ne m'a dit que le chemin est fermé pour la semaine.", "J'ai lu que les vieilles tables ne vont pas avec cette chaise.", "Quelle est la différence entre un train et un bus pour vous ?"],
    "es": ["Nadie me ha dicho que el camino está cerrado para la semana.", "He leído que las mesas viejas no van con esta silla.", "¿Cuál es la diferencia entre un tren y un autobús?"],
    "ru": ["Никто не сказал мне, что дорога сегодня закрыта.", "Я читал, что старые столы стоят вместе."],
    "zh": ["没有人告诉我这条路今天关闭了。", "我读过旧桌子和这把椅子不配。"],
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows, i = [], 0
    for lang in ("en", "de", "fr", "es"):
        for k in range(60):
            s = SENTENCES[lang]
            rows.append(("document", i, f"h{k % 3}", lang if k % 15 else "en", None, f"{s[k % 3]} {s[(k + 1) % 3]}"))
            i += 1
    return spark.createDataFrame(rows, "rec_kind string, rec_id long, host string, declared string, suffix string, text string")


def test_declared_spellings(spark):
    got = spark.createDataFrame([("EN",), ("en_GB",), ("Deutsch",), ("fre",), ("zh-CN",), ("und",), ("",), (None,), ("pt_BR",)], "l string")
    assert [r[0] for r in got.select(language.declared(F.col("l"))).collect()] == ["en", "en", "de", "fr", "zh", None, None, None, "pt"]
    url = spark.createDataFrame([("https://a.example.de/x",), ("http://b.com",), (None,)], "u string")
    assert [r[0] for r in url.select(language.suffix_language(F.col("u"))).collect()] == ["de", None, None]


def test_undeclared_languages(spark, corpus):
    s = SENTENCES
    cases = {
        1000: (None, s["de"][0]), 1001: ("de", s["de"][0]), 1002: ("en", f"{s['en'][0]} {s['fr'][1]}"),
        1003: ("en", f"{s['en'][0]}\n\n> {s['es'][1]}\n> {s['es'][0]}"), 1004: (None, s["ru"][0] + s["ru"][1]), 1005: ("en", f"{s['en'][1]} {s['zh'][0]}{s['zh'][1]}"),
        1006: (None, "- der Tisch\n- die Tische\n- der Zug\n- der Bus und der Weg"), 1007: (None, "| der | die |\n|---|---|\n| nicht | gesagt |\n| Zug | Bus |"),
        1008: (None, "und so und so und so und so und so und so und so und so und so"), 1009: (None, None), 1010: (None, ""), 1011: (None, "Kurz."),
        1012: (None, "```\n" + s["en"][0] + "\n```"), 1013: (None, "Ｎｉｅｍａｎｄ ｈａｔ ｍｉｒ ｇｅｓａｇｔ, dаss der Weg heute gesperrt ist."),
        1014: (None, (s["fr"][0] + " ") * 3 + s["fr"][1] * 900),
    }
    want = {(1000, "de"), (1002, "fr"), (1003, "es"), (1004, "ru"), (1005, "zh"), (1013, "de"), (1014, "fr")}
    rows = [("document", i, None if i % 2 else "h1", lang, None, t) for i, (lang, t) in cases.items()]
    df = spark.createDataFrame(rows + rows[:3], corpus.schema)
    model = language.fit(corpus)
    got = {(r.rec_id, r.lang) for r in language.undeclared(df.withColumn("prior", F.lit(1)), model).collect()}
    assert got == want
    out = language.stretches(df, model)
    assert out.where("confidence <= 0 or confidence > 1").count() == 0
    assert language.undeclared(df.limit(0), model).count() == 0


def test_priors_sum_to_one(spark, corpus):
    for r in language.host_priors(corpus).collect():
        assert abs(sum(r.prior) - 1) < 1e-5 and r.prior[0] > r.prior[9]


HELD_OUT = {
    "en": ["The office has told me that the bus is closed.", "What have you read in the old path with this tram?"],
    "de": ["Was ist das für ein Weg, der nicht zu dem Bus gehört?", "Ich habe niemand gesagt, dass die Tische heute alt sind."],
    "fr": ["La chaise est vieille et le chemin ne va pas pour vous.", "Quelle personne a lu que le train est fermé ?"],
    "es": ["El camino no está con la silla de esta semana.", "Nadie ha leído cuál es la diferencia entre las mesas."],
    "ru": ["Сегодня старая дорога стоит рядом со столом."],
    "zh": ["今天我没有读过这把旧椅子的消息。"],
}


def test_held_out_accuracy(spark, corpus):
    model = language.fit(corpus)
    rows = [("document", i, "h0", None, None, t) for i, t in enumerate(t for x in HELD_OUT.values() for t in x)]
    out = language.stretches(spark.createDataFrame(rows, corpus.schema), model).collect()
    right = {i: x for i, x in enumerate(x for x, t in HELD_OUT.items() for _ in t)}
    assert len(out) == len(rows) and sum(right[r.rec_id] == r.lang for r in out) >= 0.9 * len(rows)


def test_scripts_are_evidence_not_proof(spark, corpus, monkeypatch):
    texts = ["今日はとてもいい天気ですから、公園を散歩しましょう。", "Це речення написано українською мовою, їжак і ґава є тут.", "Никто не сказал мне, что дорога сегодня закрыта."]
    rows = [("document", i, None, d, None, t) for i, (t, d) in enumerate((t, d) for t in texts for d in (None, "ru"))]
    df = spark.createDataFrame(rows, corpus.schema)
    model = language.fit(corpus)
    got = {(r.rec_id, r.lang) for r in language.stretches(df, model).collect()}
    assert got == {(4, "ru"), (5, "ru")}
    monkeypatch.setattr(language, "MAX_BROADCAST_HOSTS", 0)
    assert {(r.rec_id, r.lang) for r in language.stretches(df, model).collect()} == got


def test_suffixes_of_all_links(spark):
    rows = [(["http://a.com", "http://b.de/x", "http://c.fr", "http://d.de"],), ([None, "http://c.pl"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "u array<string>")
    assert [r[0] for r in df.select(language.suffix_of(F.col("u"))).collect()] == ["de", "pl", None, None]

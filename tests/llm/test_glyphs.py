from pageweft.llm import glyphs


def test_canonical_forms():
    c = lambda t: glyphs.canonical(t)[0]
    assert c(None) is None and c("") == ""
    assert c("Ｆｕｌｌ　ｗｉｄｔｈ") == "Full width"
    assert c("Kündigung ﬁrst​ a  b") == "Kündigung first a b"
    assert c("x² ① ½ A™") == "x² ① ½ A™"
    assert c("а\nb  c") == "a\nb c"
    assert glyphs.canonical("cаsе")[0] == "case" and glyphs.canonical("cаsе")[1] == 1
    assert c("Мы сказали: o нет") == "Мы сказали: о нет"  # a Latin o alone among Russian words
    assert c("the сор went home") == "the cop went home"
    assert c("Draquiton и Москва") == "Draquiton и Москва"
    assert c("ᎻᎬᏞᏢ tһe ϲօսոt") == "HELP the count"


def test_pairs(spark):
    rows = [
        (1, "See the case", 0), (2, "See the cаse", 0), (2, "See the cаse", 9), (3, "See the case", 0), (4, "See the Case", 0),
        (5, None, 0), (6, "", 0), (7, "x²", 0), (8, "x2", 0), (9, "é", 0), (10, "é", 0), (11, "e", 0),
    ]
    df = spark.createDataFrame(rows, "block_id long, content string, canonical int")
    got = {tuple(r) for r in glyphs.alike_pairs(df).collect()}
    assert got == {(1, 2), (2, 3), (9, 10)}
    assert glyphs.alike_pairs(df.limit(0)).count() == 0
    classes = {r.block_id: (r.class_id, r.spelling_id, r.n_links) for r in glyphs.alike_classes(df).collect()}
    assert classes == {1: (1, 1, 1), 2: (1, 2, 2), 3: (1, 1, 1), 9: (9, 9, 1), 10: (9, 10, 1)}
    assert glyphs.with_canonical(df, "content").count() == len(rows)

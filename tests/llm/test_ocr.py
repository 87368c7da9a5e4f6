from pageweft.llm import ocr

GOOD = "We had a careful look at the border checkpoint. Nobody told me that the coastal path was closed."


def _frames(spark):
    texts = [("content", i, 100 + i % 3, GOOD) for i in range(60)]
    texts += [
        ("content", 900, 7, "We had a careful look at the bor-\nder checkpoint."), ("content", 901, 7, "We had a carefiil look at the b0rder checkpoint."),
        ("content", 902, 7, "We had a careful look at the\nOrla Brask | On the coastal path\nborder checkpoint."), ("content", 903, 7, "We had a careful look\nPage 12\nat the border checkpoint."),
        ("content", 904, 7, "It rose (12-\n14) with part AB1-\n22 and tie-\nbreak."), ("content", 905, 7, "The tie-break and the tie-break. Part x07 was new."),
        ("content", 906, 7, None), ("content", 907, 7, ""), ("content", 908, None, "lines\n12\nend"), ("markdown", 900, 7, "On the coastal path\n\nWe had\n\n"),
        ("content", 909, 8, "We had a careful look\nxii\nat it."), ("content", 910, 8, "We had a careful look\n11\nat it."),
    ]
    t = spark.createDataFrame([*texts, texts[60]], "field string, rec_id long, page_id long, text string")
    blocks = [(7, "header", "On the Coastal Path — Orla Brask"), (8, "header", None), (7, "paragraph_title", "On the coastal path"), (7, "text", GOOD)]
    b = spark.createDataFrame(blocks, "page_id long, label string, content string")
    pages = spark.createDataFrame([(7, "f.png", 12), (8, None, 12), (8, None, 12)], "page_id long, filename string, page_no int")
    return t, b, pages


def test_defects_and_repair(spark):
    t, b, pages = _frames(spark)
    got = {tuple(r) for r in ocr.defects(t, b, pages).collect()}
    assert got == {
        ("content", 900, "hyphen"), ("content", 901, "glyph"), ("content", 902, "header"), ("content", 903, "page_no"), ("content", 909, "page_no"),
    }
    fixed = {(r.field, r.rec_id): r.repaired for r in ocr.repair(t, b, pages).collect()}
    assert fixed["content", 900] == fixed["content", 902] == fixed["content", 903] == "We had a careful look at the border checkpoint."
    assert fixed["content", 901] == "We had a careful look at the border checkpoint."
    assert fixed["content", 907] == "" and ("content", 906) not in fixed
    assert ocr.defects(t.limit(0), b, pages).count() == 0


def test_distance_and_index(spark):
    assert ocr.confusion_distance("vvrong", "wrong") == ocr.CONFUSION_COST
    assert ocr.confusion_distance("rnadrc", "madre") == 2 * ocr.CONFUSION_COST
    assert ocr.confusion_distance("argees", "agrees") > ocr.MAX_COST and ocr.confusion_distance("same", "same") == 0
    # brute force: the index loses no pair that one or two confusions explain
    words = ["border", "wrong", "careful", "madre", "change", "niemand", "sangue", "would", "earlier", "table"]
    seen = ["b0rder", "vvrong", "carefiil", "rnadre", "changc", "riiemand", "sarigue", "woiild", "ear1ier", "t@ble", "other", "cable"]
    pairs = spark.createDataFrame([("", w, 500) for w in words] + [("", w, 1) for w in seen], "before string, word string, n long")
    got = {(r.word, r.repair) for r in ocr.candidates(pairs).collect()}
    assert got == {(s, w) for s in seen for w in words if ocr.confusion_distance(s, w) <= ocr.MAX_COST}

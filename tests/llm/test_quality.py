from pageweft.llm import quality

CASES = {
    "The long answer depends on the tide gauge. It took me 4 weeks to see why.": "prose",
    "L E S   T I R S   A U   B U T   E T   L E S   S E R V I C E S": "prose",
    "Table 33 lists every planning permit that was\ninspected during last Thursda": "prose",
    "def a(b):\n    for i in range(3):\n        yield b[i]\n    return None": "prose",
    "\\frac{8 x_{19}}{y^{20}} + \\alpha_{13}": "prose",
    "In Zamthanne zegt men dat volmachten zonder erfenissen niet te begrijpen zijn.": "prose",
    "有人说，不了解股价就很难理解免税额。有人说，不了解储蓄账户就很难理解利率。": "prose",
    "": "prose",
    "• type hint\n• package manager 218\n• merge conflict": "list",
    "oven rack\nonion gravy Velquisk\nrice cooker 12": "list",
    "free throw 48; training plan; offside call; second half; referee decision": "list",
    "mutui ......... 152\nconti ............ 102": "list",
    "<table><tr><td>a</td><td>1</td></tr></table>": "table",
    "| a | b |\n|---|---|\n| c | 4 |": "table",
    "Orlo;Velga;Monva\nspice rub;522;669\nstock pot,101,179": "table",
    "and so the Ostlesk and so the Ostlesk and so the Ostlesk and so the Ost": "junk",
    "kwnc cdmfw rpcmvbtmqcw vsznpspwkzj sgrsdm": "junk",
    "ef4e b2 cf0cf2 a3217f81 aac6e b3 2ecc2014": "junk",
    "QRX4hiNqHZQ0H856UOi8B8YDGCAmI4tqCPJkq9vD45yUC617F6AIQPgC5e": "junk",
    "~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~~": "junk",
    "Ãžâž°œœ€¢â°Ââ¤�¤ °¬Ã¢Ã™â¤€ÑÐ": "junk",
}


def test_verdicts(spark):
    rows = [(i, t, "text", 0) for i, t in enumerate(CASES)] + [(900, None, None, 0), (901, "word " * 40000, "text", 0)]
    df = spark.createDataFrame(rows, "block_id long, content string, label string, stats int")
    out = {r.block_id: r for r in quality.report(df, ["block_id"], "content").collect()}
    assert {t: out[i].kind for i, t in enumerate(CASES)} == CASES
    assert out[900].kind == "prose" and out[900].word_count == 0 and out[900].reasons == []
    assert out[901].kind == "junk" and {"rule:stop_words", "rule:repetition", "junk:repetition", "junk:repeated_passages"} <= set(out[901].reasons)
    found = quality.misfits(df.unionByName(df), ["text"]).collect()
    assert len(found) == len({r.block_id for r in found}) == sum(k != "prose" for k in CASES.values()) + 1
    assert quality.misfits(df.limit(0), ["text"]).count() == 0


def test_published_rules(spark):
    prose = (
        "The long answer depends on the tide gauge, and it took me four weeks to see why. Nobody keeps old lamps in that boat house any more. "
        "When it rains, water runs down every wall and collects under an iron stove by the door. My brother said that he would paint all of it "
        "before winter; I have my doubts. A road which leads to our village was closed for most of May, so we walked across the fields instead."
    )
    names = "lamp door boat road tree stone river cloud table chair glass paper wheel horse bridge tower garden".split()
    passage = " ".join(f"{a}{b}" for a in names for b in ("ing", "ed", "er", "est", "ful"))  # 85 different words
    cases = {
        0: (prose, set(), "prose"), 1: ("The tide is in.", {"rule:word_count", "rule:sentences"}, "prose"), 2: (prose.replace(" the ", " # # # # # # # # ").replace("it", "# # # # # # #"), {"rule:symbols", "rule:letter_words"}, "prose"),
        3: ("\n".join(f"- {x}..." for x in prose.split(".") if x.strip()), {"rule:bullet_lines", "rule:ellipsis_lines"}, None), 4: (f"the of {passage} " * 8, {"rule:repetition"}, "junk"),
        5: (prose.replace(" ", "xxxxxxxxxxxx "), {"rule:mean_word_length"}, None),
    }
    df = spark.createDataFrame([(i, c[0]) for i, c in cases.items()], "id long, t string")
    for r in quality.report(df, ["id"], "t").collect():
        _, rules, kind = cases[r.id]
        assert rules <= set(r.reasons) and (rules or not r.reasons), (r.id, r.reasons)
        assert kind in (None, r.kind), (r.id, r.kind, r.reasons)

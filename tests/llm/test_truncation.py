from pageweft.llm import truncation

BODY = "Nobody at the desk told us that the ferry crossing would affect the coastal path."


def _run(spark, rows):
    src = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "source_id int, api_id int")
    api = spark.createDataFrame([(1, 4096), (2, 20)], "api_id int, max_tokens int")
    df = spark.createDataFrame(rows, "block_id long, page_id long, pos int, label string, n_tokens int, source_id int, content string, stats int")
    return {r.block_id: (r.cut, r.reasons) for r in truncation.cut_blocks(df, src, api, ["text"]).collect()}


def test_cut_blocks(spark):
    rows = [(i, i, 0, "text", 9, 1, BODY, 0) for i in range(100, 160)]
    rows += [(i, i, 0, "paragraph_title", 9, 1, "Notes on the coastal path", 0) for i in range(200, 260)]
    rows += [
        (1, 1, 0, "text", 9, 1, "It was late. " + BODY[:40].rstrip(), 0),  # stops within a sentence
        (2, 2, 0, "text", 9, 1, " ".join(BODY.split()[:10]), 0), (3, 2, 1, "image", None, 1, "", 0), (4, 2, 2, "text", 9, 1, " ".join(BODY.split()[10:]), 0),  # carried on
        (5, 5, 0, "text", 9, 1, BODY[:-1], 0),  # whole but for the full stop
        (6, 6, 0, "text", 20, 2, BODY, 0),  # the recogniser's limit
        (7, 7, 0, "text", 9, 1, BODY + "…", 0), (8, 8, 0, "text", 9, 1, BODY[:30] + " [more]", 0),
        (9, 9, 0, "table", 9, 1, "<table><tr><td>a</td><td>b</td></tr><tr><td>c", 0),
        (10, 10, None, "text", None, 3, None, 0), (11, 11, 0, "text", None, None, "", 0), (12, 12, 0, "text", None, None, BODY, 0),
        (1, 1, 0, "text", 9, 1, "It was late. " + BODY[:40].rstrip(), 0),
    ]
    got = _run(spark, rows)
    assert len(got) == 60 + 60 + 9 and 10 not in got
    assert {k for k, v in got.items() if v[0]} == {1, 6, 8, 9}
    assert got[6][1] == ["max_tokens"] and "cut_mark" in got[8][1] and got[9][1] == ["open_table"]


def test_length_limit(spark):
    text = lambda i: f"{i:03d} " + "abcd efgh. " * (i * 7 % 23) + "x" * (i * 13 % 41) + "."
    rows = [(i, i, 0, "text", None, 2, text(i), 0) for i in range(120)]
    rows += [(i, i, 0, "text", None, 1, text(i)[:90], 0) for i in range(200, 320)]
    got = _run(spark, rows)
    assert all((k >= 200 and len(dict((r[0], r[6]) for r in rows)[k]) == 90) == v[0] for k, v in got.items())
    assert _run(spark, rows[:1])[0][0] is False


def test_trigram_counts_against_brute_force(spark):
    texts = ["a b c a b c", "a b c", "x", None, "", "7 b 12 b 9 b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = sorted((r.inside, r.at_end) for r in truncation.trigram_counts(df, "t").collect())
    want = {}
    for t in texts:
        w = ["0" if x.isdigit() else x for x in (t or "").split()]
        for i in range(len(w) - 2):
            for k in (tuple(w[i : i + 3]), tuple(w[i : i + 2])):
                a, b = want.get(k, (0, 0))
                want[k] = (a + (i < len(w) - 3), b + (i == len(w) - 3))
    assert got == sorted(want.values())


def test_open_sentence_counts_texts_and_grows_with_the_table(spark):
    noted = lambda i: "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731 - a word of its own for each text
    rows = [(i, i, 0, "text", 9, None, f"{noted(i)} {BODY}", 0) for i in range(1000, 1450)]
    # four different texts break off at each of these places: too often for a constant or for the pair
    stems = ["c", "cr", "cro", "cros", "crossi"]
    cut = [(i, i, 0, "text", 9, None, f"{noted(i)} {BODY.split(' crossing')[0]} {stems[i % 5]}", 0) for i in range(2000, 2020)]
    # one block delivered four times and four copies of a text, each cut within a word
    again = [(1, 1, 0, "text", 9, None, "Whoever waits for a replacement lamp may see the harb", 0)] * 4
    copies = [(i, i, 0, "text", 9, None, "Everybody agrees on how a small pump wears the gask", 0) for i in range(10, 14)]
    got = _run(spark, rows + cut + again + copies)
    assert {k for k, v in got.items() if v[0]} == {r[0] for r in cut + again + copies}
    assert all("open_sentence" in got[r[0]][1] for r in cut + again + copies)


def test_distinct_texts(spark):
    a, b, c = "one two three", "four five six", "one two four"
    texts = [(1, "text", a), (1, "text", a), (2, "text", a), (3, "text", b), (4, "text", None), (5, "text", ""), (6, "header", c), (6, "header", c), (7, "header", c), (8, None, c)]
    df = spark.createDataFrame(texts, "block_id long, label string, content string")
    rows = df.where("content <> ''").selectExpr("block_id", "coalesce(label = 'text', false) as prose", "xxhash64(content) as hash")
    assert sorted(r.t for r in truncation.distinct_texts(df, rows, ["text"]).collect()) == sorted([a, b, c, c, c])
    assert truncation.distinct_texts(df.limit(0), rows.limit(0), ["text"]).count() == 0


def test_short_last_row_of_an_aligned_table(spark):
    row = lambda i: f"training plan   {i}.5%   {i * 7}\nice hockey      {i * 3}   n/a"
    rows = [(i, i, 0, "table", 9, None, row(i), 0) for i in range(100, 130)]
    rows += [(1, 1, 0, "table", 9, None, row(1) + "\ntraining pl", 0)] * 4  # within a word, delivered again
    rows += [(2, 2, 0, "table", 9, None, row(2) + "\ntraining plan", 0), (3, 3, 0, "table", 9, None, row(3) + "\nZamholm", 0)]  # cells left empty
    assert {k: v[1] for k, v in _run(spark, rows).items() if v[0]} == {1: ["open_table"]}

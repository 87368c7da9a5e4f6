import random

from pyspark.sql import functions as F

from pageweft.llm import language, subjects

NOUNS = {
    "cooking": "soup oven garlic flour butter saucepan yeast recipe".split(),
    "law": "verdict statute tenant notary clause lawsuit bailiff deed".split(),
    "sport": "goalkeeper referee striker tournament racket sprint medal coach".split(),
}
FORMS = ["Nobody told me that the {} would affect the {}.", "Is there a reliable way to compare a {} with a {}?", "The {} and the {} are easy to confuse.", "I have read that the {} belongs to the {}."]


def _doc(r, subject, n):
    return " ".join(r.choice(FORMS).format(r.choice(NOUNS[subject]), r.choice(NOUNS[subject])) for _ in range(n))


def test_subjects_held_out(spark):
    r = random.Random(3)
    names = sorted(NOUNS)
    docs, truth = [], {}
    for i in range(300):
        s = names[i % 3]
        docs.append((i, _doc(r, s, 4), "en", "x"))
        truth[i] = {s}
    docs += [(900, _doc(r, "law", 3) + " " + _doc(r, "sport", 3), "en", "x"), (901, _doc(r, "law", 3) + " " + _doc(r, "sport", 1), "en", "x")]
    docs += [(902, None, "en", "x"), (903, "", None, "x"), (904, "Works for me.", "en", "x"), (905, "xq zzt " * 20000, "en", "x")]
    truth |= {900: {"law", "sport"}, 901: {"law"}}
    labels = [(i, names[i % 3], k, "x") for i in range(0, 60) for k in (1, 1)] + [(5, None, 1, "x"), (None, "law", 1, "x"), (7, "no such", 1, "x")]
    d = spark.createDataFrame([*docs, docs[0]], "doc_id long, text string, lang string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, rater int, text string")
    out = subjects.subject_sentences(d, lab, names, language.declared(F.col("lang")))
    got = {}
    for x in out.where("n_sentences >= 2").collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    held = [i for i in truth if i >= 60]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.95 * len(held)
    assert not {902, 903, 904, 905} & set(got)
    assert subjects.subject_sentences(d.limit(0), lab, names, language.declared(F.col("lang"))).count() == 0
    assert subjects.subject_sentences(d, lab.limit(0), names, language.declared(F.col("lang"))).count() == 0


def test_agreed_labels(spark):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 2), (2, "c", 3), (3, None, 1)]
    lab = spark.createDataFrame(rows + rows[:1], "doc_id long, subject string, rater int")
    assert {tuple(x) for x in subjects.agreed_labels(lab).collect()} == {(1, "a"), (1, "b")}


def test_terms_that_are_not_embedded_count(spark, monkeypatch):
    r = random.Random(5)
    names = sorted(NOUNS)
    rare = {"cooking": "colander ladle".split(), "law": "affidavit usufruct".split(), "sport": "javelin pommel".split()}
    docs, truth = [], {}
    for i in range(600):
        s = names[i % 3]
        if i < 540:
            docs.append((i, f"{_doc(r, s, 4)} The {r.choice(rare[s])} belongs to the {r.choice(NOUNS[s])}.", "en"))
        else:  # nothing but terms beyond the most frequent ones tells the subject
            a, b = rare[s]
            docs.append((i, f"Nobody told me that the {a} would affect the {b}. The {b} and the {a} are easy to confuse.", "en"))
            truth[i] = {s}
    docs += [(1000 + i, "Наречие сосед погода. Сосед погода наречие.", "ru") for i in range(4)]
    d = spark.createDataFrame([*docs, *docs[540:560]], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(i, names[i % 3], 1) for i in range(120)], "doc_id long, subject string, rater int")

    def found():
        out = subjects.subject_sentences(d, lab, names, language.declared(F.col("lang"))).where("n_sentences >= 2").collect()
        got = {}
        for x in out:
            got.setdefault(x.doc_id, set()).add(x.subject)
        return sum(got.get(i) == truth[i] for i in truth)

    assert found() >= 0.95 * len(truth)
    monkeypatch.setattr(subjects, "MAX_TERMS", 66)
    assert found() >= 0.95 * len(truth)

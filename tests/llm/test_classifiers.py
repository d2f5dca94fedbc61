"""Language identification and toxicity: held-out accuracy and edge cases."""

import random

from pyspark.sql import functions as F

from llm_cases import edge_docs, edge_rows, no_docs  # noqa: F401
from lastmile.llm import language_id as L
from lastmile.llm import toxicity as T

SYLLABLES = {"aa": "ba be bi bo bu da de di".split(), "bb": "kra stu plo gri sne tra".split(), "cc": "öü äß schü ähn ück".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_languages_and_mixtures(spark):
    rnd = random.Random(1)
    rows = [(k, prose(rnd, lang, 30), lang) for k, lang in enumerate(list(SYLLABLES) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = L.learn(docs.where(~L.held_out(F.col("doc_id"))))
    mixed = prose(rnd, "aa", 60) + " " + prose(rnd, "bb", 20)
    asked = spark.createDataFrame([*[r[:2] for r in rows], (900, mixed), (901, None), (902, "12 !! "), (903, ""), (904, "½ ② Ⅷ² 12 "), (905, "漢")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.predict(asked, langs, model).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in rows) >= 118
    assert got[900]["lang_pred"] == "aa" and 0.5 < got[900]["score"] < 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (901, 902, 903, 904))
    assert got[905]["lang_pred"] in SYLLABLES


def test_language_edge_cases(spark, edge_docs, no_docs, tmp_path):
    for name, docs in (("some", edge_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = L.op9_language_id(spark, f"{tmp_path}/{name}").collect()
        assert len(rows) == docs.count()
        assert all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in rows)


def test_toxic_words_are_learned(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for k in range(600):
        words = prose(rnd, "aa", 40).split()
        toxic, bad = k % 5 == 0, k % 3 == 0
        if toxic:
            words[rnd.randrange(40)] = rnd.choice(["vile", "rot"])
        if bad:
            words[rnd.randrange(40)] = "junk"
        rows.append((k, " ".join(words)))
        if k < 450:
            labels.append((k, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, labels[0], (5000, 1, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in T.score(docs, known).collect()}
    assert all(got[k]["toxic"] == (k % 5 == 0) for k in range(450, 600))
    assert not got[1000]["toxic"] and not got[1001]["toxic"]


def test_toxicity_without_labels(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.score(edge_docs, none).collect()
    assert len(rows) == edge_docs.count() and not any(r["toxic"] for r in rows)
    assert T.score(no_docs, none).count() == 0

"""What the bounded sample of language identification learns from."""

import random

from pyspark.sql import functions as F

from rayframe.llm import langid


def test_language_of_copies_is_learned(spark):
    # 40,000 rows of one text: the share that rows give would let 1 of 30 distinct texts pass.
    rows = [(i, "les enfants jouent dans la cour de la grande maison", "fr") for i in range(4)]
    many = spark.range(40_000).selectExpr("id AS doc_id", "'der hund und die katze sind da' AS text", "'de' AS lang")
    rng = random.Random(0)
    few = [(50_000 + i, "wir gehen heute " + "".join(rng.choices("abcdefgh", k=9)), "de") for i in range(3)]
    docs = many.unionByName(spark.createDataFrame([*rows, *few], "doc_id long, text string, lang string"))
    got = langid.sample(docs, F.lit(True), 64, 60_000, "text", "lang")
    assert {k: len(v) for k, v in got.items()} == {"de": 4, "fr": 1}
    assert len(langid.sample(docs, F.lit(True), 2, 60_000, "text", "lang")["de"]) == 2


def test_language_of_long_texts_is_learned(spark):
    rows = [(0, "der hund und die katze sind da " * 1000, "de"), (1, "the dog and the cat are there " * 1000, "en"), (2, "die katze", None), (3, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, F.lit(True), 64, 60_000, "text", "lang")
    assert {k: list(map(len, v)) for k, v in got.items()} == {"de": [15_000], "en": [15_000]}
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, F.lit(True)).collect()} == {0: "de", 1: "en", 2: "de", 3: "en"}
    assert langid.identified(docs, learn=F.lit(True)).count() == 4

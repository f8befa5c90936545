"""Operators with a form for small and one for large tables give the same rows by both."""

import pytest
from pyspark.sql import functions as F

from labelweave.functions.text import full_clean
from labelweave.operators import augment, cleaning, language, similarity


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 3000").select("doc_id", "text", "lang")


def test_thesaurus(spark, documents, monkeypatch):
    pairs = [("the", "that"), ("the", "this_one"), ("nd", "and_also"), ("que", "qui"), ("in", "into"), ("of", "from")]
    synonyms = augment.synonym_table(spark.createDataFrame(pairs, "word string, synonym string"))
    small = augment.augment(documents, "doc_id", "text", synonyms, stop_words=["of"], alpha_replace=0.3)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(augment, "LITERAL_LIMIT", 2)
    large = augment.augment(documents, "doc_id", "text", synonyms, stop_words=["of"], alpha_replace=0.3)
    assert rows(small) == rows(large)


def test_language_profile(spark, documents):
    profile = language.fit_profile(documents, "text", "lang")
    odd = documents.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "!?", "en"), (-4, "\U0001f600" * 5, "en")], documents.schema))
    small = language.identify(odd, "doc_id", "text", profile)
    assert "Generate" not in small._jdf.queryExecution().executedPlan().toString()
    assert rows(small) == rows(language.identify(odd, "doc_id", "text", profile, max_bytes=0))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_regions(spark, by):
    vectors = spark.range(300).select(
        F.col("id").alias("t"), (F.col("id") % 3).alias("g"),
        F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.sin(F.col("id") * (k + 1) * 1.7 + k)).alias("v"),
    ).unionByName(spark.createDataFrame([(300, 0, [0.0] * 8), (301, 1, [1.0] * 8)], "t long, g long, v array<double>"))
    source = vectors.select(F.col("t").alias("s"), "g", F.transform("v", lambda x: x + 0.1).alias("w"))
    plain = similarity.nearest(source, vectors, "s", "t", "w", "v", ["t"], by)
    found = similarity.pruned_nearest(source, vectors, "s", "t", "w", "v", ["t"], by, pivots=20)
    assert rows(found.best) == rows(plain)
    effort = found.effort.first()
    assert 0 < effort["compared"] < effort["pairs"]
    near = similarity.pruned_nearest(source, vectors, "s", "t", "w", "v", ["t"], by, at_least=0.9, pivots=20).best
    assert rows(near.filter("similarity_score >= 0.9")) == rows(plain.filter("similarity_score >= 0.9"))


def test_cleaning(spark):
    texts = ["I don't know, you're gonna LOVE it!!! sooooo", "The cities’ boxes were running; wasn't it?", "  ", "", None, "@me http://x.y #Tag <b>Studies</b> can't've", "a\tb\nthe the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = {r.id: r.full_text for r in cleaning.clean_texts(frame, "id", "text").collect()}
    want = {r.id: r.t for r in frame.select("id", full_clean(F.col("text")).alias("t")).collect()}
    assert found == want


def test_cleaning_of_rare_and_shared_words(spark, monkeypatch):
    texts = ["the cats ran ran ran to zebras", "zebras! don't the cats", "ran", "gonna yak the ran", "", None, "yaks, owls; ran (the) end", "a the"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = {r.id: r.t for r in frame.select("id", full_clean(F.col("text")).alias("t")).collect()}
    for held in (0, 1, 3, 100):
        monkeypatch.setattr(cleaning, "HELD_TOKENS", held)
        assert {r.id: r.full_text for r in cleaning.clean_texts(frame, "id", "text").collect()} == want
    rows = [(1, "cats yaks"), (1, "owls"), (None, "cats"), (2, "the cats"), (None, None)]
    found = cleaning.clean_texts(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert sorted(((r.id, r.text, r.full_text) for r in found), key=str) == sorted(
        [(1, "cats yaks", "cat owl yak"), (1, "owls", "cat owl yak"), (None, "cats", ""), (2, "the cats", "cat"), (None, None, None)], key=str
    )


def test_cleaning_stores_no_row_per_token(spark, monkeypatch):
    rows = []
    store = cleaning.materialise
    monkeypatch.setattr(cleaning, "materialise", lambda df, name: (rows.append((kept := store(df, name)).count()), kept)[1])
    frame = spark.range(20).select("id", F.repeat(F.lit("dogs run fast "), 500).alias("text"))
    assert {r.full_text for r in cleaning.clean_texts(frame, "id", "text").collect()} == {" ".join(["dog run fast"] * 500)}
    assert max(rows) <= 20

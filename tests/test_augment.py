from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelweave.operators.augment import augment, synonym_table
from labelweave.operators.balance import accept_similar, balance

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


@pytest.fixture(scope="module")
def synonyms(spark):
    return synonym_table(spark.createDataFrame([("beta", "second_one"), ("delta", "Fourth-x"), ("mu", "mu"), ("eta", "seventh")], "word string, synonym string"))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, " ".join(WORDS[i % 5:] + WORDS[: i % 7]), i % 2) for i in range(40)] + [(40, "too short", 0), (41, "", 1)]
    return spark.createDataFrame(rows, "id long, text string, label int")


def subsequence(part, whole):
    rest = iter(whole)
    return all(w in rest for w in part)


def test_structure(spark, texts, synonyms):
    original = {r.id: r.text for r in texts.collect()}
    got = augment(texts, "id", "text", synonyms).collect()
    assert Counter(r.method for r in got) == {"synonym": 40, "insert": 40, "swap": 40, "delete": 40, "copy": 2}
    for r in got:
        before, after = original[r.id].split(), r.text.split()
        if r.method == "copy":
            assert r.text == original[r.id]
        if r.method == "swap":
            assert Counter(before) == Counter(after) and before != after
        if r.method == "delete":
            assert subsequence(after, before)
        if r.method == "insert":
            assert subsequence(before, after) and len(before) <= len(after) <= len(before) + 2
        if r.method == "synonym":
            assert r.text != original[r.id] and "Fourth" not in r.text


def test_independent_of_partitioning(spark, texts, synonyms):
    runs = [
        sorted(map(tuple, augment(t, "id", "text", synonyms).collect()))
        for t in (texts.coalesce(1), texts.repartition(7), texts.orderBy(F.desc("id")).repartition(200))
    ]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("texts_,target,extra", [
    (["a b c d", "b c d e", "c d e f"], 10, 7),
    (["a b c d", "b c d e", "c d e f"], 100, 12),
    (["a b c d", "b c d e", "c d e f"], 2, 1),
    (["a b c", "d e f"], 10, 2),
])
def test_budget(spark, synonyms, texts_, target, extra):
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts_)] + [(9, "x y z w", 0)], "id long, text string, label int")
    made = balance(frame, "id", "text", "label", synonyms, target, [1], rows_per_range=2)
    assert made.count() == extra
    assert sorted(r.ordinal for r in made.collect()) == list(range(1, extra + 1))


def test_absent_class(spark, texts, synonyms):
    with pytest.raises(ValueError):
        balance(texts, "id", "text", "label", synonyms, 10, [7])


def test_shortcut_accepts_the_same_rows(spark, texts, synonyms):
    made = balance(texts, "id", "text", "label", synonyms, 60)
    keys = [
        sorted((r.id, r.variant) for r in accept_similar(made, texts, "id", "text", "label", dims=64, exact_scores=e).collect())
        for e in (False, True)
    ]
    assert keys[0] == keys[1] and keys[0]

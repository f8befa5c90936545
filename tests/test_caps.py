"""Nothing is cut by default, whatever the number of languages, swaps, rows or bytes."""

import pytest
from pyspark.sql import functions as F

from labelweave.checks.inputs import synonyms
from labelweave.operators import balance, evaluate, language, lookups, ordering, profile, tables
from labelweave.operators.augment import swap_rounds
from labelweave.session import drop_stages, materialise


def test_many_languages(spark):
    rows = [(i, f"l{i:03d}", f"{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)}{chr(0x4E02 + 3 * i)} the") for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, lang string, text string")
    fitted = language.fit_profile(frame, "text", "lang")
    assert len(fitted.languages) == 600
    found = language.identify(frame, "id", "text", fitted).collect()
    assert {(r.id, r.language) for r in found} == {(i, code) for i, code, _ in rows}


def test_wide_lookup_is_not_broadcast(spark):
    left = spark.range(50).withColumnRenamed("id", "k")
    wide = spark.range(20).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 4000).alias("v"))
    joined = lookups.lookup_join(left, wide, ["k"], max_bytes=10_000)
    small = lookups.lookup_join(left, wide, ["k"])
    assert "rightHint=(strategy=broadcast)" not in joined._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, small.collect()))


def test_order_by_any_type(spark):
    frame = spark.createDataFrame([(None if i % 9 == 0 else "hot" if i % 3 else f"k{i}", f"v{i:04d}") for i in range(900)], "a string, b string")
    numbered = ordering.dense_id(frame, ["a", "b"], rows_per_range=50).collect()
    assert [r.sample_id for r in sorted(numbered, key=lambda r: (r.a is not None, r.a or "", r.b))] == list(range(900))


def test_balanced_table_with_text_ids(spark):
    rows = [(f"id{i}", f"the rewh orre number {i} thatin", "big" if i % 4 else "small") for i in range(40)]
    frame = spark.createDataFrame(rows, "id string, t string, y string")
    whole = balance.balanced_table(frame, "id", "t", "y", synonyms(spark), target_size=30, rows_per_range=7, stop_words=[])
    sizes = {(r.y, r.is_augmented): r["count"] for r in whole.groupBy("y", "is_augmented").count().collect()}
    assert sizes == {("big", False): 30, ("small", False): 10, ("big", True): 1, ("small", True): 20}


def test_swap_rounds():
    assert swap_rounds(0.1) == 1 and swap_rounds(0.8) == 2 and swap_rounds(1.0) == 3


def test_missing_scores(spark):
    frame = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, None), (None, 0.4), (0, float("nan")), (1, 0.1)], "y int, s double")
    with pytest.raises(Exception, match="missing values"):
        evaluate.binary_metrics(frame, "y", "s").collect()
    row = evaluate.binary_metrics(frame, "y", "s", missing="drop").first()
    assert (row.tn, row.fp, row.fn, row.tp, row.roc_auc) == (1, 0, 1, 1, 0.5)


def test_histogram_refuses_nan(spark):
    with pytest.raises(ValueError, match="not finite"):
        profile.histogram(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), "x")


def test_align_checks(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, s string")
    aligned = tables.align_versions(left, left.withColumnRenamed("s", "f"), ["k"], "s", "f", seed=1, check=True)
    assert {tuple(r) for r in aligned.collect()} == {(1, "a", "a"), (2, "b", "b"), (3, "c", "c")}
    with pytest.raises(ValueError, match="0 aligned rows"):
        tables.align_versions(left, left.withColumnRenamed("s", "f").withColumn("k", F.col("k") + 9), ["k"], "s", "f", check=True)


def test_stages_of_others_stay(spark):
    mine = materialise(spark.range(3))
    path = mine.inputFiles()[0]
    assert spark.sparkContext.applicationId in path
    other = path.split("/stages/")[0] + "/stages/other-application/t"
    spark.range(2).write.parquet(other)
    drop_stages(spark)
    assert spark.read.parquet(other).count() == 2

import pytest
from pyspark.sql import functions as F

from labelweave.operators import duplicates, lookups, ordering, profile, split, tables
from labelweave.operators.similarity import approximate_nearest, nearest, predict_class

ROWS = [(0, "a", "x"), (1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c", "x"), (6, "c", "x"),
        (7, "c", "y"), (8, "c", "y"), (9, "d", "x"), (10, None, "x"), (11, None, "y"), (12, "e", "x"), (13, "e", "x"),
        (14, "e", "x"), (15, "e", "y")]


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame(ROWS, "i long, t string, l string")


def test_duplicates(spark, repeated):
    assert duplicates.surplus_duplicates(repeated, "t").first()[0] == 10
    assert tuple(duplicates.duplicate_summary(repeated, "t", "l", "i").first()) == (15, 10, 4)
    for parts in (1, 7):
        kept = duplicates.drop_duplicates_and_conflicts(repeated.repartition(parts), "t", "l", "i")
        assert sorted(r.i for r in kept.collect()) == [0, 5, 7, 9]
    assert tuple(duplicates.removal_report(repeated, ["t"], "l", "i").first()) == ("t", 8, 4)


def test_hot_text(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string")).alias("t"),
        F.lit("x").alias("l"),
    )
    assert duplicates.drop_duplicates_and_conflicts(frame, "t", "l", "i").count() == 2001


@pytest.mark.parametrize("rows_per_range", [3, 100, 10_000])
def test_running_total(spark, rows_per_range):
    frame = spark.range(1000).select(
        ((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 3).alias("g"), F.col("id").alias("v")
    ).withColumn("g", F.when(F.col("g") == 2, F.lit(None)).otherwise(F.col("g")))
    got = ordering.running_total(frame, ["k"], {"s": F.col("v")}, ["g"], rows_per_range).toPandas()
    want = frame.toPandas().sort_values("k")
    want["s"] = want.groupby("g", dropna=False)["v"].cumsum()
    assert got.sort_values("k")["s"].tolist() == want["s"].tolist()
    ids = ordering.dense_id(frame, ["k"], "n", 5, rows_per_range=rows_per_range).orderBy("k").select("n").collect()
    assert [r.n for r in ids] == list(range(5, 1005))


def test_plain_window_is_never_global(spark):
    frame = spark.range(1000).select(F.col("id").alias("k"))
    numbered = ordering.dense_id(frame, ["k"], rows_per_range=100)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "BatchEvalPython" not in plan


def test_split_quotas(spark):
    frame = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, "a").otherwise("b").alias("l"))
    results = [
        {(r.l, r.split): r["count"] for r in split.split(f, "id", "l").groupBy("l", "split").count().collect()}
        for f in (frame, frame.repartition(7), frame.orderBy(F.desc("id")))
    ]
    assert results[0] == {("a", "test"): 70, ("b", "test"): 30, ("a", "val"): 133, ("b", "val"): 57, ("a", "train"): 497, ("b", "train"): 213}
    assert results[0] == results[1] == results[2]
    members = [
        {r.id for r in split.split(f, "id", "l").filter("split = 'val'").collect()} for f in (frame, frame.repartition(5))
    ]
    assert members[0] == members[1]


def test_split_rejects_single_row_class(spark):
    frame = spark.createDataFrame([(i, "a") for i in range(9)] + [(9, "b")], "id long, l string")
    with pytest.raises(Exception, match="fewer than two rows"):
        split.split(frame, "id", "l").collect()


def test_large_lookup_is_salted(spark):
    left = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    lookup = spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    lookup = lookup.unionByName(spark.createDataFrame([("hot", -1)], "k string, v long"))
    small = lookups.lookup_join(left, lookup, ["k"], spread=["id"])
    large = lookups.lookup_join(left, lookup, ["k"], spread=["id"], max_bytes=10, salts=4)
    assert sorted(small.collect()) == sorted(large.collect())
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()


def test_empty_lookup(spark):
    left = spark.range(3).select("id", F.lit("a").alias("k"))
    nothing = spark.createDataFrame([], "k string, v array<double>")
    assert [r.v for r in lookups.lookup_join(left, nothing, ["k"], spread=["id"]).collect()] == [None] * 3
    assert lookups.lookup_join(left, nothing, ["k"], "inner").count() == 0


def test_row_counts_without_extra_job(spark):
    before, seen = tables.counted(spark.range(10), "before")
    after, kept = tables.counted(before.filter("id > 3"), "after")
    after.collect()
    assert (seen.get["rows"], kept.get["rows"]) == (10, 6)


def test_replace_tokens_keeps_spaces(spark):
    frame = spark.createDataFrame([(1, " the  cat\n"), (2, ""), (3, None)], "i int, t string")
    changes = spark.createDataFrame([("the", "a big")], "word string, replacement string")
    got = lookups.replace_tokens(frame, "i", "t", changes).orderBy("i").collect()
    assert [r.t for r in got] == [" a big  cat\n", "", None]


def test_sets(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("b", 4)], "t string, y int")
    right = spark.createDataFrame([(None, 2), ("b", 3)], "t string, y int")
    assert sorted(r.y for r in tables.rows_with_text_in(left, "t", right).collect()) == [2, 3, 4]
    assert sorted(r.y for r in tables.rows_with_text_in(left, "t", right, by=["y"], keep=False).collect()) == [1, 4]
    assert [r.t for r in tables.key_difference(left, right, ["t"]).collect()] == ["a"]
    assert tables.stack(left, right.drop("y")).filter("y IS NULL").count() == 2


def test_null_keys_align(spark):
    left = spark.createDataFrame([(1, None, "s"), (2, 0, "u")], "sample_id int, label int, soft string")
    right = spark.createDataFrame([(1, None, "f"), (2, 1, "g")], "sample_id int, label int, full string")
    aligned = tables.align_versions(left, right, ["sample_id", "label"], "soft", "full")
    assert [tuple(r) for r in aligned.collect()] == [(1, None, "s", "f")]
    assert tables.alignment_violations(aligned, ["soft", "full", "label"]).first().valid is False


def test_histogram(spark):
    frame = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,), (None,)], "x double")
    assert [r.n for r in profile.histogram(frame, "x", 2).orderBy("bin").collect()] == [1, 3]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r.bin_start, r.n) for r in profile.histogram(flat, "x", 2).orderBy("bin").collect()] == [(1.5, 0), (2.0, 2)]


def test_nearest_rules(spark):
    target = spark.createDataFrame([(0, [1.0, 0.0], "t0"), (1, [0.0, 1.0], "t1"), (2, [1.0, 0.0], "t2")], "j long, v array<double>, c string")
    source = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "i long, v array<double>")
    got = {r.i: (r.c, round(r.similarity_score, 6)) for r in nearest(source, target, "i", "j", "v", "v", ["c"]).collect()}
    assert got == {0: ("t0", 1.0), 1: ("t0", 0.707107), 2: ("t0", 0.0), 3: ("t1", 0.0)}
    texts = source.withColumn("tweet_text", F.lit("s")).withColumnRenamed("v", "embedding")
    targets = target.withColumn("tweet_text", F.col("c")).withColumnRenamed("v", "embedding").withColumnRenamed("c", "target")
    assert [r.i for r in predict_class(texts, targets, "i", "j").collect()] == [0]


def test_nearest_blocks_agree(spark, monkeypatch):
    import numpy as np
    from labelweave.operators import similarity

    rng = np.random.default_rng(1)
    left, right = rng.normal(size=(120, 8)), rng.normal(size=(90, 8))
    source = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(left)], "i long, v array<double>")
    target = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(right)], "j long, v array<double>")
    scores = (left / np.linalg.norm(left, axis=1)[:, None]) @ (right / np.linalg.norm(right, axis=1)[:, None]).T
    want = dict(enumerate(scores.argmax(axis=1).tolist()))
    monkeypatch.setattr(similarity, "TARGET_BLOCK_BYTES", 1000)
    monkeypatch.setattr(similarity, "SOURCE_BLOCK_BYTES", 1500)
    got = nearest(source, target, "i", "j", "v", "v", ["j"])
    assert {r.i: r.j for r in got.collect()} == want
    found = approximate_nearest(target.withColumnRenamed("j", "i"), target, "i", "j", "v", "v", ["j"])
    assert all(r.i == r.j for r in found.collect())

"""Figures that must not grow faster than the tables, and inputs as folders of many files."""

import numpy as np
from pyspark.sql import functions as F

from labelweave.checks.queries import QUERIES
from labelweave.operators import ordering, similarity


def test_keys_through_the_driver_are_bounded(spark, monkeypatch):
    for rows, key_bytes in ((512_000, 2_100), (3_000_000, 2_100), (10**9, 40_000), (40_000, 12)):
        ranges, keys = ordering.range_cut(rows, key_bytes, 150)
        assert ordering.OVERSAMPLING * ranges * keys * key_bytes <= ordering.KEY_SAMPLE_BYTES
    assert ordering.range_cut(10**9, 16) == (5000, 100)
    monkeypatch.setattr(ordering, "KEY_SAMPLE_BYTES", 60_000)
    frame = spark.range(3000).select("id", F.concat(F.repeat(F.lit("same start "), 100), F.pmod(F.xxhash64("id"), F.lit(900)).cast("string")).alias("t"))
    drawn = []
    monkeypatch.setattr(ordering, "materialise", lambda df, name="", real=ordering.materialise: drawn.append(spark.conf.get(ordering._KEYS_SETTING)) or real(df, name))
    before = spark.conf.get(ordering._KEYS_SETTING)
    got = ordering.dense_id(frame, ["t", "id"], rows_per_range=20).collect()
    assert int(drawn[0]) < int(before) == int(spark.conf.get(ordering._KEYS_SETTING))
    assert [r.sample_id for r in sorted(got, key=lambda r: (r.t, r.id))] == list(range(3000))


def test_stream_reads_one_file_or_a_folder_of_files(spark, tmp_path):
    rows = [(i, f"text {i} @you", "en" if i % 2 else "de") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame.repartition(4).write.parquet(f"{tmp_path}/folder/documents.parquet")
    (tmp_path / "file").mkdir()
    frame.toPandas().to_parquet(tmp_path / "file/documents.parquet")
    for place in ("folder", "file"):
        got = {r.doc_id: (r.tweet_soft, r.is_cyberbullying) for r in QUERIES["stream_clean"](spark, f"{tmp_path}/{place}").collect()}
        assert got == {i: (f"text {i}", 0 if i % 2 else 1) for i in range(40)}


def test_key_difference_takes_every_order(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 500_000.0), (2, 10.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in QUERIES["key_difference"](spark, str(tmp_path)).collect()] == [3]


def test_best_columns_are_those_of_the_whole_product(monkeypatch):
    rng = np.random.default_rng(3)
    rows, columns = rng.normal(size=(300, 24)), rng.normal(size=(500, 24))
    columns[100:140] = columns[7] + rng.normal(size=(40, 24)) * 1e-6  # near ties, more than are scored one by one
    columns[300:310] = columns[9]  # exact ties
    rows[:20], rows[20:25] = columns[7], columns[9]
    rows, columns = (m / np.linalg.norm(m, axis=1)[:, None] for m in (rows, columns))
    rows[30:33], columns[400:402] = 0, 0
    for names in ({}, {"ROW_TILE": 64, "COLUMN_TILE": 90}):
        for name, value in names.items():
            monkeypatch.setattr(similarity, name, value)
        best, score = similarity._best_columns(rows, columns)
        product = np.round(rows @ columns.T, 12)
        assert (best == product.argmax(axis=1)).all() and np.allclose(score, product.max(axis=1), atol=2e-12)


def test_copies_of_vectors_do_not_multiply(spark, monkeypatch):
    """Rows of the search step's input per vector, before the blocks meet, for targets of several blocks."""
    monkeypatch.setattr(similarity, "TARGET_BLOCK_BYTES", 64 * 1000)
    monkeypatch.setattr(similarity, "SOURCE_BLOCK_BYTES", 64 * 1000)
    monkeypatch.setattr(similarity, "pruned_nearest", lambda *a, **k: 1 / 0)  # up to one copy for each region
    numbers = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.xxhash64("id", k).cast("double") / 2.0**63)
    frame = spark.range(2000).select("id", numbers.alias("v"))
    found = similarity.nearest(frame, frame.withColumnRenamed("id", "m"), "id", "m", "v", "v", ["m"]).collect()
    assert len(found) == 2000 and all(r.id == r.m for r in found)


def test_a_text_is_changed_once(spark):
    """One call makes all variants of a text, and no filter of a later step makes them again."""
    from labelweave.checks.inputs import synonyms
    from labelweave.operators import augment

    frame = spark.createDataFrame([(1, "the rewh orre thatin the nd"), (2, "one two"), (None, "the que is the que"), (4, None)], "i long, t string")
    made = augment.augment(frame, "i", "t", synonyms(spark), stop_words=[])
    plan = made.filter("method = 'insert'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert sorted((r.i or 0, r.variant) for r in made.collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    words = frame.select("i", F.split("t", " ").alias("w"))
    assert {r.i: r._swap is None for r in augment.swap_words(words, "i", 1, 0.8, "w").collect()} == {1: False, 2: False, None: False, 4: True}


def test_few_replacements_shuffle_no_token(spark):
    from labelweave.operators import lookups

    rows = [(1, "the  cat\tthe"), (2, None), (3, ""), (4, "und so"), (5, "the a"), (5, "the a"), (None, "the")]
    frame = spark.createDataFrame(rows, "i long, t string")
    changes = spark.createDataFrame([("the", "THE"), ("und", ""), ("so", None), (None, "x")], "word string, replacement string")
    single = frame.filter("i < 5")
    short = lookups.replace_tokens(single, "i", "t", changes)
    assert "Generate" not in short._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.t for r in short.collect()} == {1: "THE  cat\tTHE", 2: None, 3: "", 4: " so"}
    by_join = lookups._replaced_by_join(frame, "i", "t", changes, None)
    assert sorted(map(str, lookups.replace_tokens(frame, "i", "t", changes).collect())) == sorted(map(str, by_join.collect()))


def test_soft_texts_are_worked_out_once(spark):
    """The whole preparation cleans a text softly a single time; full cleaning goes on from there."""
    from labelweave.functions import text
    from labelweave.operators import build

    rows = [(1, "@me Don't  see https://a.b #Tags <b>u</b> soooo walking’s", "a"), (2, None, "b"), (3, "gonna it's cats", "a"), (4, "", "b")]
    frame = spark.createDataFrame(rows, "i long, tweet_text string, c string")
    made = build.build_dataset(frame, "tweet_text", "c", negative="a", multiclass=False)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("www") == 1
    soft = text.soft_clean(F.col("tweet_text"))
    assert frame.select(text.expand_contractions(soft).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("www") == 1
    alone = frame.select("i", text.full_clean(F.col("tweet_text")).alias("full"))
    assert {r.i: r.tweet_full for r in made.collect()} == {r.i: r.full for r in alone.collect()}
    assert made.filter("i = 2").first().tweet_full is None


def test_numbered_rows_are_shuffled_once(spark):
    """The places of the rows are stored; numbers come from a small table of range sizes, also with missing and repeated keys."""
    place = F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") * 7919 % 5000)
    frame = spark.range(30_000).select("id", place.alias("k"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"))
    numbered = ordering.dense_id(frame, ["k"], "n", 3, ["g"], rows_per_range=700)
    plan = numbered._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert "Exchange" not in plan and "Window" not in plan
    rows = sorted(numbered.collect(), key=lambda r: (r.g or 0, r.n))
    for g in (None, 1, 2, 3, 4):
        mine = [r for r in rows if r.g == g]
        assert [r.n for r in mine] == list(range(3, 3 + len(mine))) and len(mine) == 6000
        keys = [-1 if r.k is None else r.k for r in mine]
        assert keys == sorted(keys)


def test_balancing_leaves_only_what_its_result_reads(spark):
    """Tables that steps stored for themselves are deleted, with no shuffle files of theirs left behind."""
    import os

    from labelweave.checks.inputs import STOP_WORDS, synonyms
    from labelweave.plans.balancing import balance_training
    from labelweave.session import _stages, materialise, settled

    words = ["the", "rewh", "orre", "thatin", "inoran", "nd", "ein", "ung"]
    rows = [(i, " ".join([f"w{i}", *(words[(i * k + k) % 8] for k in range(2, 14))]), "big" if i % 4 else "small", "s") for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, tweet_text string, label string, source string")
    frame = frame.selectExpr("*", "tweet_text AS tweet_soft", "tweet_text AS tweet_full")
    materialise(spark.range(1))
    stages = _stages(spark).removeprefix("file://")
    earlier = set(os.listdir(stages))
    part = settled(spark, lambda: materialise(materialise(frame).filter("doc_id >= 0")).filter("doc_id < 60"), "part")
    before = set(os.listdir(stages))
    assert [name.split("-")[0] for name in before - earlier] == ["part"]
    balanced = balance_training(part, "doc_id", synonyms(spark), 45, category_col="source", augmentation={"stop_words": STOP_WORDS}, stop_words=STOP_WORDS)
    left = sorted(name.split("-")[0] for name in set(os.listdir(stages)) - before)
    assert left.count("originals") == left.count("numbered") == 1 and set(left) <= {"originals", "numbered", "lookup"}
    found = balanced.collect()
    assert sorted(r.sample_id for r in found) == list(range(len(found))) and sum(r.is_augmented for r in found) > 0
    assert {r.tweet_text for r in found if not r.is_augmented} == {r[1] for r in rows} and {r.source for r in found} == {"s"}
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_words_of_vectors_are_hashed_in_batches(spark, monkeypatch):
    """Counts are those of each word's MD5, whatever white space parts the words, with no expression for each word in the plan."""
    import re
    from hashlib import md5

    monkeypatch.setattr(similarity, "COUNTED_ROWS", 3)
    monkeypatch.setattr(similarity, "KNOWN_WORDS", 4)
    odd = "".join(f"w{i}{chr(c)}" for i, c in enumerate([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    texts = ["The cat THE\tcat", None, "", "   ", " ÉA éa İ ", odd, odd + odd, "a\u200bb \x01 c", "x" * 5000, "nan"] + [f"w{i} w{i + 1}" for i in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(2)
    counts = similarity._hashed_counts(frame, "t", 8)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
    found = {r.i: r._counts.toArray().tolist() for r in counts.collect()}
    lower = {r.i: r.t for r in frame.select("i", F.lower(F.coalesce("t", F.lit("nan"))).alias("t")).collect()}
    for i in range(len(texts)):
        want = [0.0] * 8
        for word in re.findall("[^\\s\x1c-\x1f\x85]+", lower[i]):
            want[int(md5(word.encode()).hexdigest()[:8], 16) % 8] += 1
        assert found[i] == want
    assert similarity._hashed_counts(frame.limit(0), "t", 8).count() == 0

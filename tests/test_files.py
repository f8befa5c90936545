import json

import pytest
from pyspark.sql import functions as F

from labelweave.operators import evaluate, language, model, split
from labelweave.sources import readers, writers
from labelweave.streaming import stateless


def test_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('tweet_text,cyberbullying_type\n"line ""one""\nline, two",age\nnull,religion\n,gender\nnone,\n', encoding="utf-8")
    rows = [tuple(r) for r in readers.read_csv(spark, str(path)).collect()]
    assert rows == [('line "one"\nline, two', "age"), (None, "religion"), (None, "gender"), ("none", None)]
    assert readers.convert_csv(spark, str(path), str(tmp_path / "raw")).count() == 4


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_table(spark, str(tmp_path / "absent"))


def test_sinks(spark, tmp_path):
    frame = spark.range(100).select("id", (F.col("id") % 2).alias("target"))
    writers.write_split(frame, str(tmp_path / "parts"), "id", 0.1)
    assert spark.read.parquet(str(tmp_path / "parts/split=test")).count() == 10
    with pytest.raises(KeyError):
        writers.write_split(frame, str(tmp_path / "x"), "id", stratify="absent")
    writers.write_label_map(frame, "target", str(tmp_path / "map"))
    assert json.loads(spark.read.text(str(tmp_path / "map")).first()[0]) == {"0": 0, "1": 1}
    scored = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.7, 0)], "probability double, y int")
    metrics = evaluate.binary_metrics(scored, "y", "probability")
    writers.write_metrics(metrics, str(tmp_path), "test")
    back = spark.read.option("header", True).csv(str(tmp_path / "test_metrics.csv"))
    assert back.columns[:4] == ["Threshold", "Accuracy", "Balanced Accuracy", "F1"] and back.count() == 1
    decided = scored.withColumn("pred_label", evaluate.decide(F.col("probability")))
    writers.write_predictions(decided, str(tmp_path), "test", "y")
    assert spark.read.option("header", True).csv(str(tmp_path / "test_predictions.csv")).columns == ["true_label", "probability", "pred_label"]


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")


def test_language(spark, documents):
    parts = split.split_frames(split.split(documents, "doc_id", "lang"))
    profile = language.fit_profile(parts["train"], "text", "lang", 2)
    found = language.identify(parts["test"].unionByName(spark.createDataFrame([(-1, "!", "en")], documents.schema)), "doc_id", "text", profile)
    got = {r.doc_id: r.language for r in found.collect()}
    assert got.pop(-1) is None
    truth = {r.doc_id: r.lang for r in parts["test"].collect()}
    assert sum(got[i] == truth[i] for i in truth) / len(truth) > 0.9


def test_model_on_stream(spark, documents, small, tmp_path):
    labelled = documents.withColumn("y", (F.col("lang") == "en").cast("int"))
    parts = split.split_frames(split.split(labelled, "doc_id", "y"))
    trained = model.train_best(parts["train"], parts["val"], "text", "y", grid=[0.1, 0.01], dims=1024, max_iter=5)
    assert len(trained.history) == 2 and max(h["f1"] for h in trained.history) > 0.9
    stream = stateless.read_stream(spark, small, spark.read.parquet(f"{small}/documents.parquet").schema, "documents.parquet")
    scored = stateless.score_stream(stream.select("doc_id", "text"), trained).select("doc_id", "probability", "pred_label")
    stateless.run_available(scored, str(tmp_path / "out"), "model_stream")
    batch = model.score(documents, trained).select("doc_id", "probability", "pred_label")
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    single = spark.createDataFrame([("the of and",)], "text string")
    assert 0 <= model.score(single, trained).first().probability <= 1

import pytest
from pyspark.sql import functions as F

from labelweave.checks.inputs import STOP_WORDS, synonyms
from labelweave.functions.arrays import softmax
from labelweave.operators.evaluate import decide_class
from labelweave.operators.language import fit_profile
from labelweave.plans.balancing import balance_training, balancing_diagnostics
from labelweave.plans.judging import judge_multiclass
from labelweave.plans.prepare import model_input, prepare_part, prepare_raw
from labelweave.session import materialise


@pytest.fixture(scope="module")
def raw(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    return documents.select("doc_id", F.col("text").alias("tweet_text"), F.col("source").alias("cyberbullying_type"), "lang")


@pytest.fixture(scope="module")
def prepared(spark, raw):
    frame = raw.withColumn("cyberbullying_type", F.col("lang"))
    return materialise(prepare_raw(frame, "doc_id", negative="en", dropped_class="de", stop_words=STOP_WORDS))


@pytest.fixture(scope="module")
def part(prepared):
    train = prepared.filter("split = 'train'")
    return materialise(prepare_part(train, "doc_id", "cyberbullying_label", category_col="cyberbullying_type"))


def test_prepare(raw, prepared, part):
    assert {r.cyberbullying_type for r in prepared.select("cyberbullying_type").distinct().collect()} == {"en", "es", "fr"}
    assert {r.split for r in prepared.select("split").distinct().collect()} == {"train", "val", "test"}
    assert prepared.groupBy("tweet_text").count().filter("count > 1").count() == 0
    assert model_input(part).columns == ["text", "label"]


def test_language_filter(raw):
    profile = fit_profile(raw, "tweet_text", "lang")
    raw = raw.withColumn("cyberbullying_type", F.when(F.length("tweet_text") % 2 == 0, "even").otherwise("odd"))
    kept = prepare_raw(raw, "doc_id", negative="even", profile=profile, language="fr", dropped_class=None, stop_words=STOP_WORDS)
    shares = kept.agg(F.avg((F.col("lang") == "fr").cast("int"))).first()[0]
    assert shares > 0.95


def test_balancing(spark, part):
    balanced = materialise(
        balance_training(part, "doc_id", synonyms(spark), 60, category_col="cyberbullying_type",
                         augmentation={"stop_words": STOP_WORDS}, stop_words=STOP_WORDS)
    )
    originals, made = balanced.filter("NOT is_augmented"), balanced.filter("is_augmented")
    assert originals.count() == part.count() and made.count() > 0
    assert balanced.select("sample_id").distinct().count() == balanced.count()
    assert made.agg(F.min("sample_id")).first()[0] == part.count()
    assert made.join(originals, ["label", "tweet_text"], "left_semi").count() == 0
    names = {(r.label, r.cyberbullying_type) for r in balanced.select("label", "cyberbullying_type").distinct().collect()}
    assert names == {(0, "en"), (1, "es"), (2, "fr")}
    out = balancing_diagnostics(balanced, dims=64)
    sizes = out["class_sizes"].collect()
    assert all(r.after >= r.before for r in sizes)
    assert out["tweet_text"].agg(F.sum("n")).first()[0] == made.count()


def test_judge_multiclass(spark, tmp_path):
    frame = spark.range(300).select(
        (F.col("id") % 3).cast("int").alias("label"),
        F.array(*[F.sin(F.col("id") * (i + 1)) + F.when(F.col("id") % 3 == i, 1.0).otherwise(0.0) for i in range(3)]).alias("z"),
    )
    scored = frame.withColumn("p", softmax("z")).withColumn("pred_label", decide_class(F.col("p")))
    out = judge_multiclass(scored, "label", "p", 3, str(tmp_path))
    assert out["confusion"].agg(F.sum("n")).first()[0] == 300
    assert out["metrics"].first().roc_auc_ovr > 0.7
    back = spark.read.option("header", True).csv(str(tmp_path / "test_predictions.csv"))
    assert back.columns == ["true_label", "prob_class_0", "prob_class_1", "prob_class_2", "pred_label"] and back.count() == 300

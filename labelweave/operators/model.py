"""Training a text classifier with Spark ML and scoring rows with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.text import as_text, tokens
from .evaluate import confusion, decide, decide_class, metrics_from_counts, multiclass_metrics


@dataclass
class TrainedClassifier:
    features: PipelineModel
    classifier: object
    text_col: str
    history: list[dict] = field(default_factory=list)


def _with_tokens(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn("_tokens", tokens(F.lower(as_text(F.col(text_col), True))))


def _scored(features: DataFrame, classifier) -> DataFrame:
    probs = classifier.transform(features).withColumn("probabilities", vector_to_array("probability"))
    binary = classifier.numClasses == 2
    probs = probs.withColumn("pred_label", decide_class(F.col("probabilities")))
    if binary:
        probs = probs.withColumn("probability", F.col("probabilities")[1])
        probs = probs.withColumn("pred_label", decide(F.col("probability")))
    else:
        probs = probs.withColumn("probability", F.array_max("probabilities"))
    return probs.drop("rawPrediction", "prediction")


def epoch_metrics(scored: DataFrame, label_col: str, classes: int) -> dict:
    """Accuracy, precision, recall and F1; of class 1 if binary, macro otherwise."""
    cells = confusion(scored, label_col, "pred_label", classes)
    if classes > 2:
        row = multiclass_metrics(cells).first()
        return {n: row[c] for n, c in (("accuracy", "accuracy"), ("f1", "f1_macro"),
                                       ("precision", "precision_macro"), ("recall", "recall_macro"))}
    named = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    counts = cells.agg(
        *[F.sum(F.when((F.col("true_label") == t) & (F.col("pred_label") == p), F.col("n")).otherwise(0)).alias(n)
          for n, (t, p) in named.items()]
    )
    row = metrics_from_counts(counts).first()
    return {n: row[n] for n in ("accuracy", "f1", "precision", "recall")}


def train_best(
    train: DataFrame,
    validation: DataFrame,
    text_col: str,
    label_col: str,
    classes: int = 2,
    grid: Sequence[float] = (0.1, 0.01, 0.001),
    dims: int = 1 << 14,
    max_iter: int = 20,
) -> TrainedClassifier:
    """Fit one model per regularisation value and keep the one with the best validation F1."""
    stages = Pipeline(
        stages=[
            HashingTF(inputCol="_tokens", outputCol="_counts", numFeatures=dims),
            IDF(inputCol="_counts", outputCol="features", minDocFreq=0),
        ]
    )
    prepared = _with_tokens(train.select(text_col, F.col(label_col).cast("int").alias("label")), text_col)
    features = stages.fit(prepared)
    fitting = features.transform(prepared).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    checking = _with_tokens(validation.select(text_col, F.col(label_col).cast("int").alias("label")), text_col)
    checking = features.transform(checking).select("features", "label").persist(StorageLevel.MEMORY_AND_DISK)
    best, best_f1, history = None, -1.0, []
    try:
        for strength in grid:
            classifier = LogisticRegression(
                featuresCol="features", labelCol="label", regParam=strength, maxIter=max_iter,
                family="binomial" if classes == 2 else "multinomial",
            ).fit(fitting)
            metrics = epoch_metrics(_scored(checking, classifier), "label", classes)
            history.append({"strength": strength, **metrics})
            if metrics["f1"] > best_f1:
                best, best_f1 = classifier, metrics["f1"]
    finally:
        fitting.unpersist()
        checking.unpersist()
    return TrainedClassifier(features, best, text_col, history)


def score(df: DataFrame, model: TrainedClassifier) -> DataFrame:
    """Add probabilities, probability (of class 1, or of the chosen class) and pred_label.

    Row by row, so it serves single texts and streams as well.
    """
    features = model.features.transform(_with_tokens(df, model.text_col))
    return _scored(features, model.classifier).drop("_tokens", "_counts", "features")

"""Training in epochs: a linear classifier over hashed words whose weights are stored after every pass.

Features are made once and stored. In an epoch each task adds up the gradient of its rows, the sums per weight are a small
table, and the new weights and the validation metrics are written before the next epoch begins; a run that was
broken off goes on from the last epoch it finds.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_text, tokens
from ..session import materialise, ship, stage_path
from .evaluate import binary_metrics
from .tables import require_columns

BUCKETS = 1 << 12


def hashed_words(df: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """Add ``_index`` and ``_value``: buckets of the lower-case words of a text and their shares of its words.

    The bucket of a word is the first 32 bits of its MD5 modulo ``buckets``; a text without words has no entries.
    """
    words = tokens(F.lower(as_text(F.col(text_col), True)))
    bucket = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    sorted_ = df.withColumn("_all", F.sort_array(bucket))
    # Where a bucket begins in the sorted list; the next begin gives its count.
    begins = F.filter(
        F.transform("_all", lambda b, i: F.when((i == 0) | (b != F.get(F.col("_all"), i - 1)), i)), lambda i: i.isNotNull()
    )
    counted = sorted_.withColumn("_begins", begins)
    ends = F.concat(F.slice("_begins", F.lit(2), F.greatest(F.size("_begins") - 1, F.lit(0))), F.array(F.size("_all")))
    shares = F.transform(F.arrays_zip(F.col("_begins").alias("b"), ends.alias("e")), lambda z: (z["e"] - z["b"]) / F.size("_all"))
    index = F.transform("_begins", lambda i: F.get(F.col("_all"), i))
    none = F.size("_all") == 0
    return counted.withColumns({
        "_index": F.when(none, F.array().cast("array<int>")).otherwise(index),
        "_value": F.when(none, F.array().cast("array<double>")).otherwise(shares),
    }).drop("_all", "_begins")


def _margins(batch: pa.RecordBatch, index: str, value: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Margin of each row, and row, bucket and value of each entry. The last weight is the constant."""
    lists = batch.column(index)
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    places, values = lists.flatten().to_numpy(zero_copy_only=False), batch.column(value).flatten().to_numpy(zero_copy_only=False)
    return np.bincount(rows, values * weights[places], len(lists)) + weights[-1], rows, places, values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _gradient(features: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sum of the rows' gradients, then their number: one row per weight and task is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 1)
        for batch in batches:
            margin, rows, places, values = _margins(batch, "_index", "_value", weights)
            error = _sigmoid(margin) - batch.column("label").to_numpy(zero_copy_only=False)
            total[: len(weights)] += np.bincount(places, values * error[rows], len(weights))
            total[-2] += error.sum()
            total[-1] += len(error)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["place", "sum"])

    sums = features.mapInArrow(run, "place long, sum double").groupBy("place").agg(F.sum("sum").alias("sum")).collect()
    out = np.zeros(len(weights) + 1)
    for row in sums:
        out[row["place"]] = row["sum"]
    return out


def score_with(df: DataFrame, text_col: str, weights: np.ndarray) -> DataFrame:
    """``df`` with the probability of class 1 by the given weights, row by row."""
    spark = df.sparkSession
    own = spark.sparkContext.broadcast(weights)
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margins(batch, "_index", "_value", own.value)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(_sigmoid(margin))], [*names, "probability"])

    ship(spark)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return hashed_words(df, text_col, len(weights) - 1).mapInArrow(run, f"{schema}, probability double")


def stored_epochs(spark: SparkSession, folder: str) -> list[dict]:
    """Epochs stored in a folder, in order: number, metrics and weights; those after a gap do not count."""
    found = []
    while True:
        try:
            row = spark.read.parquet(f"{folder}/epoch={len(found) + 1}").first()
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return found
        found.append({**json.loads(row["metrics"]), "weights": np.array(row["weights"])})


def train_epochs(
    train: DataFrame, validation: DataFrame, text_col: str, label_col: str, epochs: int, rate: float = 8.0, buckets: int = BUCKETS,
    folder: str | None = None,
) -> list[dict]:
    """The epochs of a logistic model of 0/1 labels: epoch, validation accuracy, f1, precision and recall, and weights.

    Every epoch is one step against the mean gradient of all training rows, from zero weights. Epochs that ``folder`` (shared by
    driver and executors) holds already are not trained again. ``best_epoch`` picks the one to keep. Rows without a label
    are left out; texts without words are judged by the constant. The driver holds one weight per bucket.
    """
    require_columns(train, [text_col, label_col])
    spark = train.sparkSession
    ship(spark)
    folder = folder or stage_path(spark, "epochs")
    done = stored_epochs(spark, folder)[:epochs]
    if len(done) == epochs:
        return done
    rows = train.select(text_col, F.col(label_col).cast("double").alias("label")).filter("label IS NOT NULL")
    features = materialise(hashed_words(rows, text_col, buckets).select("label", "_index", "_value"), "features")
    checked = validation.select(text_col, F.col(label_col).cast("int").alias("label")).filter("label IS NOT NULL")
    weights = done[-1]["weights"] if done else np.zeros(buckets + 1)
    for epoch in range(len(done) + 1, epochs + 1):
        sums = _gradient(features, weights)
        weights = weights - rate * sums[:-1] / max(sums[-1], 1)
        row = binary_metrics(score_with(checked, text_col, weights), "label", "probability", 0.5).first()
        entry = {"epoch": epoch, **{n: row[n] for n in ("accuracy", "f1", "precision", "recall")}}
        table = spark.createDataFrame([(json.dumps(entry), weights.tolist())], "metrics string, weights array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
        done.append({**entry, "weights": weights})
    return done


def best_epoch(history: list[dict]) -> dict:
    """The first epoch of the highest validation F1."""
    return max(history, key=lambda e: (e["f1"] if e["f1"] == e["f1"] else -1.0, -e["epoch"]))

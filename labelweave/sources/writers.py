"""Writing tables, splits, label maps, metrics and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import METRIC_HEADERS
from ..operators.evaluate import predictions
from ..operators.labels import label_map
from ..operators.split import split


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path`` with Parquet or CSV; failures raise."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def write_split(
    df: DataFrame,
    path: str,
    id_cols: Sequence[str] | str,
    test_size: float = 0.1,
    stratify: str | None = "target",
    seed: int = 42,
    fmt: str = "parquet",
) -> None:
    """Split into train and test and write both in one pass, one folder each (split=train, split=test)."""
    parted = split(df, id_cols, stratify, [test_size], ["test", "train"], seed)
    write_table(parted, path, fmt, ["split"])


def label_map_json(mapping: DataFrame) -> DataFrame:
    """One row holding the JSON object {label: code} in code order; one entry per class."""
    label, code = mapping.columns
    entries = F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), F.col(label).cast("string").alias("l"))))
    pairs = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["l"], e["c"])))
    return mapping.filter(F.col(label).isNotNull()).agg(F.to_json(pairs).alias("value"))


def write_label_map(df: DataFrame, label_col: str, path: str) -> None:
    label_map_json(label_map(df, label_col)).coalesce(1).write.mode("overwrite").text(path)


def with_metric_headers(metrics: DataFrame) -> DataFrame:
    """Metric columns under their published headers, in published order."""
    return metrics.select(*[F.col(c).alias(h) for c, h in METRIC_HEADERS.items() if c in metrics.columns])


def write_metrics(metrics: DataFrame, folder: str, set_name: str) -> None:
    write_table(with_metric_headers(metrics).coalesce(1), f"{folder}/{set_name}_metrics.csv", "csv")


def write_predictions(
    scored: DataFrame, folder: str, set_name: str, label_col: str, classes: int = 2, fmt: str = "csv"
) -> None:
    """Scored rows: (true_label, probability, pred_label), or one probability column per class."""
    if classes == 2:
        flat = scored.select(F.col(label_col).alias("true_label"), "probability", "pred_label")
    else:
        flat = predictions(scored, label_col, "probabilities", classes)
    write_table(flat, f"{folder}/{set_name}_predictions.{fmt}", fmt)

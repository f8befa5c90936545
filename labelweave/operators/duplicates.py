"""Repeated texts: classification, conflict removal and the report of what was removed.

Texts are grouped by a 16-byte key and pre-aggregated per (text, label), so a text that makes
up a third of all rows reaches the second step as one row per label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import text_key
from .tables import require_columns


def text_groups(df: DataFrame, text_cols: Sequence[str], label_col: str, id_col: str) -> DataFrame:
    """One row per (text column, text, label): row count, first row, and the text's totals."""
    require_columns(df, [*text_cols, label_col, id_col])
    texts = F.explode(
        F.array(*[F.struct(F.lit(c).alias("text_column"), text_key(F.col(c)).alias("text_key")) for c in text_cols])
    )
    per_label = (
        df.select(F.col(id_col).alias("row_id"), F.col(label_col).alias("label"), texts.alias("t"))
        .groupBy("t.text_column", "t.text_key", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))
    )
    same_text = Window.partitionBy("text_column", "text_key")
    return per_label.withColumns(
        {
            "n_text": F.sum("n").over(same_text),
            "n_label_min": F.min("n").over(same_text),
            "n_label_max": F.max("n").over(same_text),
            "first_text_id": F.min("first_id").over(same_text),
        }
    ).withColumn("conflicted", (F.col("n_text") > 1) & (F.col("n_label_min") == 1))


def drop_duplicates_and_conflicts(
    df: DataFrame, text_cols: Sequence[str] | str, label_col: str, id_col: str
) -> DataFrame:
    """Drop texts with conflicting labels, keep the first row of equal (text, label).

    With several text columns a row must pass in each of them, judged on the original table.
    """
    columns = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    winners = text_groups(df, columns, label_col, id_col).filter(~F.col("conflicted")).select("first_id")
    if len(columns) > 1:
        winners = winners.groupBy("first_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(columns))
    return df.join(winners, df[id_col] == winners["first_id"], "left_semi")


def removal_report(df: DataFrame, text_cols: Sequence[str], label_col: str, id_col: str) -> DataFrame:
    """Per text column: rows dropped as conflicts and rows dropped as repeats."""
    return text_groups(df, text_cols, label_col, id_col).groupBy("text_column").agg(
        F.sum(F.when(F.col("conflicted"), F.col("n")).otherwise(0)).alias("conflict_rows"),
        F.sum(F.when(F.col("conflicted"), 0).otherwise(F.col("n") - 1)).alias("repeat_rows"),
    )


def surplus_duplicates(df: DataFrame, text_col: str) -> DataFrame:
    """One row: rows beyond the first of each text; missing counts as one text."""
    per_text = df.groupBy(text_key(F.col(text_col)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return per_text.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def surplus_of_groups(groups: DataFrame) -> DataFrame:
    """``surplus_duplicates`` from existing groups."""
    firsts = F.count_if(F.col("first_id") == F.col("first_text_id"))
    return groups.agg((F.coalesce(F.sum("n"), F.lit(0)) - firsts).alias("duplicates"))


def duplicate_summary(df: DataFrame, text_col: str, label_col: str, id_col: str) -> DataFrame:
    """One row: rows in repeated texts, rows of perfect and of imperfect repeats."""
    return summarise_groups(text_groups(df, [text_col], label_col, id_col))


def summarise_groups(groups: DataFrame) -> DataFrame:
    """``duplicate_summary`` from existing groups."""

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    return groups.agg(
        rows(F.col("n_text") > 1).alias("duplicate_rows"),
        rows(F.col("n") > 1).alias("perfect_rows"),
        rows((F.col("n_text") > 1) & (F.col("n_label_max") == 1)).alias("imperfect_rows"),
    )


def duplicate_labels(df: DataFrame, text_col: str, label_col: str, id_col: str) -> DataFrame:
    """Label histogram of the rows in repeated texts, missing labels excluded."""
    return labels_of_groups(text_groups(df, [text_col], label_col, id_col))


def labels_of_groups(groups: DataFrame) -> DataFrame:
    """``duplicate_labels`` from existing groups."""
    return (
        groups.filter((F.col("n_text") > 1) & F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("n").alias("n"))
    )

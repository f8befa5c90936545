"""Label columns and label dimensions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookups import lookup_join
from .tables import require_columns


def add_binary_label(df: DataFrame, label_col: str, negative: Any, out: str = "label") -> DataFrame:
    """0 for the negative class, 1 for everything else, missing labels included."""
    require_columns(df, [label_col])
    hit = F.col(label_col).eqNullSafe(F.lit(negative))
    return df.withColumn(out, F.when(hit, F.lit(0)).otherwise(F.lit(1)))


def label_map(df: DataFrame, label_col: str, code_col: str = "code") -> DataFrame:
    """Distinct labels in code-point order, numbered from 0; a missing label comes last.

    The window runs over one row per class.
    """
    require_columns(df, [label_col])
    order = Window.orderBy(F.col(label_col).asc_nulls_last())
    return df.select(label_col).distinct().withColumn(code_col, (F.row_number().over(order) - 1).cast("int"))


def add_ordinal_label(
    df: DataFrame, label_col: str, out: str = "label", mapping: DataFrame | None = None
) -> DataFrame:
    """Add the label's code; pass ``mapping`` to reuse the codes of another table."""
    codes = (mapping if mapping is not None else label_map(df, label_col)).toDF(label_col, out)
    spread = [c for c in df.columns if c != label_col]
    return lookup_join(df, codes, [label_col], spread=spread)


def one_vs_rest(df: DataFrame, label_col: str, classes: int, prob_col: str | None = None) -> DataFrame:
    """One row per (row, class) with a 0/1 indicator and, if given, the class's probability."""
    if prob_col is None:
        rows = df.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    else:
        rows = df.select("*", F.posexplode(prob_col).alias("class", "score"))
    return rows.withColumn("indicator", (F.col(label_col) == F.col("class")).cast("int"))

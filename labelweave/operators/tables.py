"""Projections, filters, semi/anti joins and unions with pandas-compatible NULL handling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.fixed_values import NA_TOKENS
from ..functions.hashing import shuffle_key, text_key
from ..session import materialise


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def require_text(df: DataFrame, column: str) -> None:
    require_columns(df, [column])
    if not isinstance(df.schema[column].dataType, StringType):
        raise TypeError(f"column {column} is not a string column")


def drop_class(df: DataFrame, label_col: str, label: Any) -> DataFrame:
    """All rows but those of one class; rows without a label stay."""
    require_columns(df, [label_col])
    return df.filter(~F.col(label_col).eqNullSafe(F.lit(label)))


def class_slice(df: DataFrame, label_col: str, label: Any) -> tuple[DataFrame, DataFrame]:
    """Rows of one class and all the others; an absent class is an error."""
    require_columns(df, [label_col])
    hit = F.col(label_col).eqNullSafe(F.lit(label))
    inside = df.filter(hit)
    if inside.isEmpty():
        raise ValueError(f"no rows with {label_col} = {label}")
    return inside, df.filter(~hit)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require_columns(df, columns)
    return df.na.drop(subset=list(columns))


def empty_to_null(df: DataFrame, columns: Sequence[str], na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """What a CSV round trip between stages does to text: listed tokens become missing."""
    require_columns(df, columns)
    return df.withColumns(
        {c: F.when(F.col(c).isin(*na_tokens), F.lit(None)).otherwise(F.col(c)) for c in columns}
    )


def keep_renamed(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Keep the listed columns, renamed where a mapping is given."""
    mapping = columns if isinstance(columns, Mapping) else {c: c for c in columns}
    require_columns(df, mapping)
    return df.select(*[F.col(old).alias(new) for old, new in mapping.items()])


def keep_scored(df: DataFrame, threshold: float, score_col: str = "similarity_score") -> DataFrame:
    return df.filter(F.col(score_col) >= threshold)


def keep_flagged(df: DataFrame, flag: Column) -> DataFrame:
    """Rows whose flag is true; an unknown flag counts as false."""
    return df.filter(F.coalesce(flag, F.lit(False)))


def rows_with_text_in(df: DataFrame, text_col: str, other: DataFrame, other_col: str | None = None,
                      by: Sequence[str] = (), keep: bool = True) -> DataFrame:
    """Semi join (``keep``) or anti join on equal text, NULL equal to NULL.

    Only 16-byte text keys of the other side are shuffled, each once.
    """
    keys = other.select(
        *[F.col(c).alias(f"_other_{c}") for c in by], text_key(F.col(other_col or text_col)).alias("_key")
    ).distinct()
    condition = text_key(F.col(text_col)).eqNullSafe(F.col("_key"))
    for c in by:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_other_{c}"))
    return df.join(keys, condition, "left_semi" if keep else "left_anti")


def key_difference(df: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct keys of one table that the other lacks."""
    return df.select(*columns).subtract(other.select(*columns))


def stack(*frames: DataFrame) -> DataFrame:
    """Union of all rows by column name; columns absent on a side are NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows while another action runs; read ``observation.get['rows']`` afterwards."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def align_versions(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_text: str, right_text: str,
    seed: int | None = None, check: bool = False,
) -> DataFrame:
    """Inner join of two text versions of the same samples, NULL keys matching NULL keys.

    With a ``seed`` the rows come in a seeded random order. With ``check`` the result is stored, and an empty result
    or a missing value in it is an error.
    """
    require_columns(left, [*keys, left_text])
    require_columns(right, [*keys, right_text])
    other = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], right_text)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    aligned = left.select(*keys, left_text).join(other, condition, "inner").select(*keys, left_text, right_text)
    if check:
        aligned = materialise(aligned, "aligned")
        found = alignment_violations(aligned, aligned.columns).first()
        if not found["valid"]:
            raise ValueError(f"{found['rows']} aligned rows, {found['nulls']} missing values")
    if seed is not None:
        order = shuffle_key(seed, *[F.col(k) for k in keys])
        aligned = aligned.withColumn("_order", order).orderBy("_order", *keys).drop("_order")
    return aligned


def alignment_violations(aligned: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of aligned rows and of missing values; zero rows or any NULL is a fault."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return aligned.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("nulls")).withColumn(
        "valid", (F.col("rows") > 0) & (F.col("nulls") == 0)
    )

"""From raw labelled texts to cleaned, encoded and split tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.build import build_dataset
from ..operators.duplicates import drop_duplicates_and_conflicts
from ..operators.language import LanguageProfile, keep_language
from ..operators.split import split
from ..operators.tables import drop_class, drop_missing, empty_to_null
from ..session import materialise


def prepare_raw(
    df: DataFrame,
    id_col: str,
    text_col: str = "tweet_text",
    label_col: str = "cyberbullying_type",
    negative: str = "not_cyberbullying",
    profile: LanguageProfile | None = None,
    language: str = "en",
    dropped_class: str | None = "other_cyberbullying",
    seed: int = 42,
    **tables,
) -> DataFrame:
    """Language filter, class filter, duplicate removal, cleaning, labels and the three-way split."""
    if profile is not None:
        df = keep_language(df, id_col, text_col, profile, language)
    if dropped_class is not None:
        df = drop_class(df, label_col, dropped_class)
    kept = materialise(drop_duplicates_and_conflicts(df, text_col, label_col, id_col))
    built = build_dataset(kept, text_col, label_col, negative=negative, **tables)
    return split(built, id_col, label_col, seed=seed)


def prepare_part(
    df: DataFrame,
    id_col: str,
    label_col: str,
    text_cols: Sequence[str] = ("tweet_text", "tweet_soft", "tweet_full"),
    category_col: str | None = None,
) -> DataFrame:
    """One split part for modelling: empty texts become missing, duplicates over all text versions
    and rows with missing texts go, the label column is called ``label``."""
    stored = empty_to_null(df, text_cols)
    unique = drop_duplicates_and_conflicts(stored, text_cols, label_col, id_col)
    whole = drop_missing(unique, [*text_cols, label_col])
    extra = [category_col] if category_col else []
    return whole.select(id_col, *text_cols, F.col(label_col).alias("label"), *extra)


def model_input(df: DataFrame, text_col: str = "tweet_soft", label_col: str = "label") -> DataFrame:
    """(text, label) rows for a classifier."""
    return df.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))



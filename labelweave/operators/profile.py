"""Profiles of a labelled text table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import as_text, emoji_count, hashtag_count, is_blank, word_count
from ..session import materialise
from .duplicates import labels_of_groups, summarise_groups, surplus_of_groups, text_groups
from .tables import require_columns


def class_distribution(df: DataFrame, label_col: str) -> DataFrame:
    """Rows per class, most frequent first; missing labels are not counted."""
    require_columns(df, [label_col])
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), label_col)


def class_sizes(df: DataFrame, label_col: str) -> DataFrame:
    """Rows per class in class order."""
    return class_distribution(df, label_col).orderBy(label_col)


def imbalance_ratio(df: DataFrame, label_col: str) -> DataFrame:
    return class_distribution(df, label_col).agg(
        F.try_divide(F.max("n").cast("double"), F.min("n")).alias("imbalance_ratio")
    )


def binary_shares(df: DataFrame, label_col: str) -> DataFrame:
    """Share of each 0/1 class, labelled No and Yes."""
    return _shares(class_distribution(df, label_col), label_col)


def _shares(counts: DataFrame, label_col: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy())
    name = F.when(F.col(label_col) == 0, "No").when(F.col(label_col) == 1, "Yes")
    return counts.select(
        F.coalesce(name, F.col(label_col).cast("string")).alias("label"), (F.col("n") / total).alias("share")
    )


def _blank(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, StringType):
        return F.count_if(is_blank(F.col(column)))
    return F.lit(0).cast("long")


def missing_and_blank(df: DataFrame) -> DataFrame:
    """Per column: missing values and blank strings, all from one pass."""
    return _column_rows(df.agg(*_column_counts(df)), df.columns)


def _column_counts(df: DataFrame) -> list[Column]:
    """Counts of missing values, m0, m1, …, and of blanks, b0, b1, …, of the columns."""
    missing = [F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]
    return missing + [_blank(df, c).alias(f"b{i}") for i, c in enumerate(df.columns)]


def _column_rows(sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.col(f"b{i}").alias("blank"))
            for i, c in enumerate(columns)
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def _measures(text: Column) -> Mapping[str, Column]:
    return {
        "mean_chars": F.length(text), "mean_words": word_count(text), "mean_hashtags": hashtag_count(text), "mean_emoji": emoji_count(text),
    }


def text_means(df: DataFrame, text_col: str, null_as_text: bool = True) -> DataFrame:
    """One row: mean characters, words, hashtags and emoji, from one pass.

    Missing texts count as the word ``nan`` unless ``null_as_text`` is off.
    """
    require_columns(df, [text_col])
    measures = _measures(as_text(F.col(text_col), null_as_text))
    return df.agg(*[F.avg(m).alias(n) for n, m in measures.items()])


def histogram(df: DataFrame, value_col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are listed.

    A constant column gets the range value - 0.5 to value + 0.5. The two limits are read first. Missing values are
    not counted; NaN or an infinite value is an error, as no bin could hold it.
    """
    value = F.col(value_col).cast("double")
    odd = F.count_if(F.isnan(value) | (F.abs(value) == float("inf")))
    low, high, unbounded = df.agg(F.min(value), F.max(value), odd).first()
    if unbounded:
        raise ValueError(f"{unbounded} values of {value_col} are not finite")
    if low is None:
        low, high = 0.0, 1.0
    elif low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(value.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def before_after_counts(before: DataFrame, after: DataFrame, label_col: str) -> DataFrame:
    """Class sizes of two tables side by side, 0 where a class is absent."""
    tagged = before.select(label_col, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(label_col, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    return (
        tagged.filter(F.col(label_col).isNotNull())
        .groupBy(label_col)
        .agg(F.sum("b").alias("before"), F.sum("a").alias("after"))
        .orderBy(label_col)
    )


def overview(df: DataFrame, text_col: str, label_col: str, id_col: str, binary_col: str | None = None) -> DataFrame:
    """All profiles in one long table (metric, key, value), from two passes.

    One pass adds everything up per class, and per binary value, into a small stored table from which classes, missing
    values and means follow. The other makes the table of text groups, which the duplicate figures share.
    """
    require_columns(df, [text_col, label_col, id_col])

    def rows(frame: DataFrame, metric: Column | str, key: Column | str, value: str) -> DataFrame:
        metric = F.lit(metric) if isinstance(metric, str) else metric
        key = F.lit(key) if isinstance(key, str) else key
        return frame.select(
            metric.alias("metric"), key.cast("string").alias("key"), F.col(value).cast("double").alias("value")
        )

    def long(frame: DataFrame) -> DataFrame:
        pairs = F.create_map(*[p for c in frame.columns for p in (F.lit(c), F.col(c).cast("double"))])
        return frame.select(F.explode(pairs).alias("metric", "value")).select("metric", F.lit("").alias("key"), "value")

    measures = _measures(as_text(F.col(text_col), True))
    keys = list(dict.fromkeys([label_col, *([binary_col] if binary_col else [])]))
    sums = [F.sum(m.cast("long")).alias(n) for n, m in measures.items()]
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    per_class = materialise(df.groupBy(*named).agg(F.count(F.lit(1)).alias("n"), *_column_counts(df), *sums), "profile")

    def classes(key: str) -> DataFrame:
        return per_class.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("label")).agg(F.sum("n").alias("n"))

    places = range(len(df.columns))
    totals = per_class.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for i in places for c in (f"m{i}", f"b{i}")])
    columns = _column_rows(totals, df.columns)
    means = per_class.agg(*[F.try_divide(F.sum(n).cast("double"), F.sum("n")).alias(n) for n in measures])
    groups = materialise(text_groups(df, [text_col], label_col, id_col).drop("text_key"), "groups")
    ratio = classes("k0").agg(F.try_divide(F.max("n").cast("double"), F.min("n")).alias("imbalance_ratio"))
    parts = [
        rows(classes("k0"), "class", F.col("label"), "n"),
        rows(ratio, "imbalance_ratio", "", "imbalance_ratio"),
        rows(columns, "missing", F.col("column"), "missing"),
        rows(columns, "blank", F.col("column"), "blank"),
        long(means),
        rows(surplus_of_groups(groups), "duplicates", "", "duplicates"),
        long(summarise_groups(groups)),
        rows(labels_of_groups(groups), "duplicate_label", F.col("label"), "n"),
    ]
    if binary_col:
        parts.append(rows(_shares(classes(f"k{len(keys) - 1}"), "label"), "binary_share", F.col("label"), "share"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

"""Judging classifiers: confusion counts, threshold curves and metric rows.

Everything that depends on scores works on one row per distinct score with running totals, so
tied scores collapse before the shuffle and no step orders all rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..session import materialise
from .labels import one_vs_rest
from .lookups import lookup_join
from .ordering import ROWS_PER_RANGE, running_total

NAN = float("nan")


def _ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def decide(prob: Column, threshold: float = 0.5) -> Column:
    """1 where the probability reaches the threshold."""
    return (prob >= F.lit(threshold)).cast("int")


def decide_class(probs: Column) -> Column:
    """Most probable class, the first one on ties."""
    return argmax(probs)


def confusion(df: DataFrame, true_col: str, pred_col: str, classes: int | None = None) -> DataFrame:
    """Counts by (true, predicted); pairs of known classes that never occur are listed with 0."""
    counts = df.groupBy(F.col(true_col).alias("true_label"), F.col(pred_col).alias("pred_label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if classes is None:
        seen = counts.select(F.explode(F.array("true_label", "pred_label")).alias("c"))
        known = seen.agg(F.collect_set("c").alias("known"))
    else:
        known = df.sparkSession.range(1).select(F.sequence(F.lit(0), F.lit(classes - 1)).alias("known"))
    grid = known.select("known", F.explode("known").alias("true_label")).select(
        "true_label", F.explode("known").alias("pred_label")
    )
    filled = grid.select("*", F.lit(0).alias("n")).unionByName(counts)
    return filled.groupBy("true_label", "pred_label").agg(F.sum("n").alias("n"))


def score_groups(
    df: DataFrame, label_col: str, score_col: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE,
    missing: str = "fail",
) -> DataFrame:
    """Per distinct score: positives and negatives, alone and summed from the highest score down.

    The counts per score are stored once, as the running totals read them several times. A missing label, or a
    missing or NaN score, is an error when the groups are computed; ``missing="drop"`` leaves such rows out
    of everything that is derived from the groups.
    """
    if missing not in ("fail", "drop"):
        raise ValueError("missing must be fail or drop")
    unknown = F.col(label_col).isNull() | F.col(score_col).isNull() | F.isnan(F.col(score_col).cast("double"))
    if missing == "drop":
        df = df.filter(~unknown)
    else:
        fault = F.raise_error(F.lit(f"missing values in {label_col} or {score_col}")).cast("int")
        df = df.withColumn(label_col, F.when(unknown, fault).otherwise(F.col(label_col)))
    positive = F.col(label_col) == 1
    groups = df.groupBy(*by, F.col(score_col).cast("double").alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    totals = {"tp": F.col("pos"), "fp": F.col("neg")}
    descending = materialise(groups, "scores").withColumn("_order", -F.col("score"))
    return running_total(descending, ["_order"], totals, by, rows_per_range).drop("_order")


def _area_columns() -> dict[str, Column]:
    """Aggregates over score groups: class totals, ROC rank sum and both PR sums."""
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    precision = tp / (tp + fp)
    before = F.when(tp - pos + fp - neg == 0, F.lit(1.0)).otherwise(
        F.try_divide(tp - pos, tp - pos + fp - neg)
    )
    return {
        "positives": F.sum("pos"),
        "negatives": F.sum("neg"),
        "_rank_sum": F.sum(neg * (tp - pos / 2)),
        "_ap_sum": F.sum(pos * precision),
        "_trapezoid_sum": F.sum(pos * (precision + before) / 2),
    }


def _areas() -> dict[str, Column]:
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return {
        "roc_auc": _ratio(F.col("_rank_sum"), p * n, NAN),
        "pr_auc": _ratio(F.col("_ap_sum"), p),
        "pr_trapezoid": _ratio(F.col("_trapezoid_sum"), p),
    }


def curve_areas(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC area, average precision and trapezoid PR area from ``score_groups``."""
    sums = groups.groupBy(*by).agg(*[c.alias(n) for n, c in _area_columns().items()])
    return sums.select(*by, *[c.alias(n) for n, c in _areas().items()])


def _count_metrics() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    npv0 = _ratio(tn, tn + fn)
    precision = _ratio(tp, tp + fp)
    f1, f1_negative = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    one_class = ((tp + fn) == 0) | ((tn + fp) == 0)
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    chance = ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (total * total)
    share = _ratio(tp + fn, total)
    return {
        "accuracy": _ratio(tp + tn, total, NAN),
        "balanced_accuracy": F.when(one_class, recall + specificity).otherwise((recall + specificity) / 2),
        "f1": f1,
        "precision": precision,
        "recall": recall,
        "specificity": _ratio(tn, tn + fp, NAN),
        "npv": _ratio(tn, tn + fn, NAN),
        "mcc": _ratio(tp * tn - fp * fn, margins),
        "kappa": _ratio((tp + tn) / total - chance, 1 - chance, NAN),
        "f1_macro": (f1 + f1_negative) / 2,
        "f1_weighted": share * f1 + (1 - share) * f1_negative,
        "precision_macro": (precision + npv0) / 2,
        "precision_weighted": share * precision + (1 - share) * npv0,
        "recall_macro": (recall + specificity) / 2,
        "recall_weighted": share * recall + (1 - share) * specificity,
    }


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """Metric columns for rows of (tn, fp, fn, tp)."""
    return counts.withColumns(_count_metrics())


def binary_metrics(
    df: DataFrame, label_col: str, score_col: str, threshold: float = 0.5, groups: DataFrame | None = None,
    missing: str = "fail",
) -> DataFrame:
    """The full metric row at one threshold, from a single aggregation over score groups."""
    groups = groups if groups is not None else score_groups(df, label_col, score_col, missing=missing)
    above = F.col("score") >= F.lit(float(threshold))

    def total(column: str, hit: Column) -> Column:
        return F.coalesce(F.sum(F.when(hit, F.col(column))), F.lit(0))

    row = groups.agg(
        total("neg", ~above).alias("tn"),
        total("neg", above).alias("fp"),
        total("pos", ~above).alias("fn"),
        total("pos", above).alias("tp"),
        *[c.alias(n) for n, c in _area_columns().items()],
    )
    metrics = _count_metrics()
    return row.select(
        F.lit(float(threshold)).alias("threshold"),
        "tn", "fp", "fn", "tp",
        *[c.alias(n) for n, c in metrics.items()],
        *[c.alias(n) for n, c in _areas().items()],
    )


def roc_points(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold) for every distinct score, after the point (0, 0) at +infinity."""
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    start = totals.select(*by, F.lit(math.inf).alias("threshold"), F.lit(0).cast("long").alias("tp"),
                          F.lit(0).cast("long").alias("fp"))
    points = start.unionByName(groups.select(*by, F.col("score").alias("threshold"), "tp", "fp"))
    return _with_totals(points, totals, by).select(
        *by, "threshold", _ratio(F.col("fp"), F.col("_n"), NAN).alias("fpr"),
        _ratio(F.col("tp"), F.col("_p"), NAN).alias("tpr"),
    )


def pr_points(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(precision, recall, threshold) for every distinct score; the end point (1, 0) has none."""
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    end = totals.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                        F.lit(0.0).alias("recall"))
    tp, fp = F.col("tp"), F.col("fp")
    points = _with_totals(groups, totals, by).select(
        *by, F.col("score").alias("threshold"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, F.col("_p"), 1.0).alias("recall"),
    )
    return points.unionByName(end)


def _with_totals(points: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach class totals: one row in all, or one row per class."""
    if by:
        return lookup_join(points, totals, by, "inner", spread=[c for c in points.columns if c not in by])
    p, n = totals.first()
    return points.withColumns({"_p": F.lit(p), "_n": F.lit(n)})


def youden(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the largest tpr - fpr; the highest one on ties, +infinity if none gains.

    Compared as whole numbers, tp * N - fp * P.
    """
    totals = groups.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    whole = "decimal(19,0)"
    gain = F.col("tp").cast(whole) * F.col("_n").cast(whole) - F.col("fp").cast(whole) * F.col("_p").cast(whole)
    best = F.max(F.when(gain > 0, F.struct(gain.alias("gain"), F.col("score").alias("score"))))
    scale = F.first("_p").cast("double") * F.first("_n").cast("double")
    return _with_totals(groups, totals, by).groupBy(*by).agg(
        F.coalesce(best["score"], F.lit(math.inf)).alias("threshold"),
        F.when(scale > 0, F.coalesce(best["gain"].cast("double"), F.lit(0.0)) / scale).alias("youden_j"),
    )


def youden_threshold(df: DataFrame, label_col: str, score_col: str) -> float:
    return float(youden(score_groups(df, label_col, score_col)).first()["threshold"])


def class_counts(cells: DataFrame) -> DataFrame:
    """Per class: support, predicted rows and hits, from a confusion table."""
    hit = F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)
    sides = F.explode(
        F.array(
            F.struct(F.col("true_label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                     hit.cast("long").alias("hits")),
            F.struct(F.col("pred_label").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("long").alias("hits")),
        )
    )
    return cells.select(sides.alias("s")).groupBy("s.class").agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.hits").alias("hits")
    )


def multiclass_metrics(cells: DataFrame) -> DataFrame:
    """The multiclass metric row from a confusion table."""
    support, predicted, hits = (F.col(c).cast("double") for c in ("support", "predicted", "hits"))
    precision, recall = _ratio(hits, predicted), _ratio(hits, support)
    f1 = _ratio(2 * hits, support + predicted)
    present = (support + predicted) > 0
    per_class = class_counts(cells).withColumns({"_p": precision, "_r": recall, "_f": f1})
    sums = per_class.agg(
        F.sum(support).alias("s"),
        F.sum(hits).alias("c"),
        F.sum(predicted * support).alias("pt"),
        F.sum(predicted * predicted).alias("pp"),
        F.sum(support * support).alias("tt"),
        F.avg(F.when(support > 0, F.col("_r"))).alias("balanced_accuracy"),
        *[F.avg(F.when(present, F.col(c))).alias(f"{n}_macro") for c, n in _PRF.items()],
        *[F.sum(F.col(c) * support).alias(f"_{n}_weighted") for c, n in _PRF.items()],
    )
    s, c, pt, pp, tt = (F.col(x) for x in ("s", "c", "pt", "pp", "tt"))
    return sums.select(
        _ratio(c, s, NAN).alias("accuracy"),
        "balanced_accuracy",
        *[F.col(f"{n}_macro") for n in _PRF.values()],
        *[_ratio(F.col(f"_{n}_weighted"), s).alias(f"{n}_weighted") for n in _PRF.values()],
        _ratio(c * s - pt, F.sqrt(s * s - pp) * F.sqrt(s * s - tt)).alias("mcc"),
        _ratio(c * s - pt, s * s - pt, NAN).alias("kappa"),
    )


_PRF = {"_p": "precision", "_r": "recall", "_f": "f1"}


def ovr_groups(df: DataFrame, label_col: str, probs_col: str, classes: int) -> DataFrame:
    """Score groups of every class against the rest."""
    rows = one_vs_rest(df.select(label_col, probs_col), label_col, classes, probs_col)
    return score_groups(rows, "indicator", "score", ["class"])


def ovr_areas(groups: DataFrame) -> DataFrame:
    """Unweighted means over classes of the ROC area and of average precision."""
    return curve_areas(groups, ["class"]).agg(
        F.avg("roc_auc").alias("roc_auc_ovr"), F.avg("pr_auc").alias("pr_auc_macro")
    )


def predictions(df: DataFrame, label_col: str, probs_col: str, classes: int) -> DataFrame:
    """Flat scored rows: true label, one probability column per class, predicted label."""
    return df.select(
        F.col(label_col).alias("true_label"),
        *[F.col(probs_col)[i].alias(f"prob_class_{i}") for i in range(classes)],
        decide_class(F.col(probs_col)).alias("pred_label"),
    )

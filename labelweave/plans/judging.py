"""Training, scoring and judging a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import (
    binary_metrics,
    confusion,
    curve_areas,
    decide,
    multiclass_metrics,
    ovr_areas,
    ovr_groups,
    pr_points,
    roc_points,
    score_groups,
    youden,
)
from ..operators.model import TrainedClassifier, score
from ..session import materialise
from ..sources.writers import write_metrics, write_predictions


def judge_binary(
    model: TrainedClassifier, validation: DataFrame, test: DataFrame, label_col: str = "label",
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """Metric rows of the test part at the validation-tuned threshold and at 0.5, with both curves."""
    tuned = float(youden(score_groups(score(validation, model), label_col, "probability")).first()["threshold"])
    scored = materialise(score(test, model).select(label_col, "probability"))
    groups = materialise(score_groups(scored, label_col, "probability"))
    out = {"roc": roc_points(groups), "pr": pr_points(groups), "areas": curve_areas(groups)}
    for name, threshold in (("test_youden", tuned), ("test_standard", 0.5)):
        out[name] = binary_metrics(scored, label_col, "probability", threshold, groups)
        if folder:
            write_metrics(out[name], folder, name)
            decided = scored.withColumn("pred_label", decide(F.col("probability"), threshold))
            write_predictions(decided, folder, name, label_col)
    return out


def judge_multiclass(
    scored: DataFrame, label_col: str, probs_col: str, classes: int, folder: str | None = None, name: str = "test"
) -> dict[str, DataFrame]:
    """Confusion table, metric row and per-class ROC points of scored rows."""
    cells = materialise(confusion(scored, label_col, "pred_label", classes))
    groups = materialise(ovr_groups(scored, label_col, probs_col, classes))
    areas = ovr_areas(groups).first()
    metrics = multiclass_metrics(cells).withColumns(
        {"roc_auc_ovr": F.lit(areas["roc_auc_ovr"]), "pr_auc_macro": F.lit(areas["pr_auc_macro"])}
    )
    if folder:
        write_metrics(metrics, folder, name)
        write_predictions(scored.withColumnRenamed(probs_col, "probabilities"), folder, name, label_col, classes)
    return {"confusion": cells, "metrics": metrics, "roc": roc_points(groups, ["class"])}

import math

import pytest
from pyspark.sql import functions as F

from labelweave.functions.arrays import argmax, softmax
from labelweave.operators import evaluate as ev


def scored(spark, pairs):
    return spark.createDataFrame([(float(s), y) for s, y in pairs], "p double, y int")


GOLDEN = {
    (495, 165, 304, 2797): dict(
        accuracy=0.8752991225737836, balanced_accuracy=0.8259835536923573, f1=0.9226455550057727, f1_macro=0.8005962524857513,
        f1_weighted=0.8798098519144598, precision=0.9442943956785955, precision_macro=0.7819094005927396,
        precision_weighted=0.887302054941204, recall=0.9019671073847146, specificity=0.75, npv=0.6195244055068836,
        mcc=0.6062930915803134, kappa=0.6020616705383431),
    (547, 113, 445, 2656): dict(
        accuracy=0.8516352034033502, balanced_accuracy=0.8426428913449229, f1=0.9049403747870528, f1_macro=0.783583988846311,
        f1_weighted=0.8623478649647238, precision=0.9591910436980859, recall=0.8564979039019671, specificity=0.8287878787878787,
        npv=0.5514112903225806, mcc=0.5915306586413037, kappa=0.5720324846463877),
}


@pytest.mark.parametrize("counts", list(GOLDEN))
def test_published_rows(spark, counts):
    row = ev.metrics_from_counts(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
    for name, value in GOLDEN[counts].items():
        assert row[name] == pytest.approx(value, abs=1e-12), name


def test_small_example(spark):
    groups = ev.score_groups(scored(spark, [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1), (0.5, 0)]), "y", "p", rows_per_range=2)
    row = ev.curve_areas(groups).first()
    assert row.roc_auc == pytest.approx(5 / 6) and row.pr_auc == pytest.approx(11 / 12)
    assert ev.youden(groups).first().threshold == 0.8
    points = sorted((r.threshold, r.fpr, r.tpr) for r in ev.roc_points(groups).collect())
    assert points[-1] == (math.inf, 0.0, 0.0) and points[0] == (0.5, 1.0, 1.0) and len(points) == 6


def test_ties_and_single_class(spark):
    groups = ev.score_groups(scored(spark, [(0.5, 1), (0.5, 0)]), "y", "p")
    row = ev.curve_areas(groups).first()
    assert (row.roc_auc, row.pr_auc, ev.youden(groups).first().threshold) == (0.5, 0.5, math.inf)
    only = ev.binary_metrics(scored(spark, [(0.2, 1), (0.7, 1)]), "y", "p", 0.0).first()
    assert math.isnan(only.specificity) and math.isnan(only.roc_auc) and only.precision == 1.0
    assert (only.tn, only.fp, only.fn, only.tp) == (0, 0, 0, 2)


def test_arrays(spark):
    row = spark.range(1).select(
        argmax(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2))), softmax(F.array(F.lit(1000.0), F.lit(1000.0)))
    ).first()
    assert row[0] == 0 and row[1] == [0.5, 0.5]


def test_multiclass(spark):
    frame = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 2)], "y int, z int")
    row = ev.multiclass_metrics(ev.confusion(frame, "y", "z", 3)).first()
    assert row.accuracy == pytest.approx(4 / 6)
    assert row.precision_macro == pytest.approx((1 + 1 / 3 + 1) / 3)
    assert row.recall_macro == row.balanced_accuracy == pytest.approx((1 / 2 + 1 + 2 / 3) / 3)
    assert row.f1_weighted == pytest.approx((2 * 2 / 3 + 1 * 0.5 + 3 * 0.8) / 6)
    assert ev.confusion(frame, "y", "z", 3).count() == 9

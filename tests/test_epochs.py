"""Epoch training goes on where it was broken off."""

import numpy as np
from pyspark.sql import functions as F

from labelweave.operators import epochs
from labelweave.session import stage_path


def test_resume(spark):
    rows = [("good fine nice" if i % 2 else "bad poor", i % 2) for i in range(40)] + [("", 1), (None, 0), ("odd", None)]
    frame = spark.createDataFrame(rows, "text string, label int")
    folder = stage_path(spark, "epochs")
    whole = epochs.train_epochs(frame, frame, "text", "label", 4, buckets=32)
    first = epochs.train_epochs(frame, frame, "text", "label", 2, buckets=32, folder=folder)
    rest = epochs.train_epochs(frame, frame, "text", "label", 4, buckets=32, folder=folder)
    assert [e["epoch"] for e in rest] == [1, 2, 3, 4] and len(first) == 2
    for one, other in zip(whole, rest, strict=True):
        assert np.allclose(one["weights"], other["weights"], rtol=0, atol=1e-12) and one["f1"] == other["f1"]
    best = epochs.best_epoch(rest)
    scored = epochs.score_with(frame, "text", best["weights"])
    assert scored.count() == len(rows) and best["f1"] > 0.9
    assert scored.filter((F.col("text") == "bad poor") & (F.col("probability") >= 0.5)).isEmpty()

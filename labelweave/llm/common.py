"""Helpers the corpus operators share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# The white space every operator here splits on.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACES = r"[^\x20\x09-\x0D]+"


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], base: str) -> str:
    """``base``, with underscores in front until no column has that name."""
    lower = {c.lower() for c in taken}
    while base.lower() in lower:
        base = "_" + base
    return base


def with_row_ids(df: DataFrame) -> tuple[DataFrame, str]:
    """The table stored once with a row number column, and that column's name.

    The number is drawn when the table is written, so every later read sees the same one, even
    where rows repeat or keys are missing.
    """
    name = fresh(df.columns, "row_id")
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without_rows(df: DataFrame, row_col: str, dropped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose number is not in ``dropped``.

    ``dropped`` is stored first: Spark then knows its true size, broadcasts it when it is below
    the session's limit and otherwise joins by shuffle.
    """
    stored = materialise(dropped.select(col(row_col)), "dropped")
    return df.join(stored, row_col, "left_anti").select(*[col(c) for c in columns])


def release(df: DataFrame, rounds: int = 2) -> None:
    """Have the driver forget plans that nothing refers to, so that Spark removes their shuffle files now.

    Finished plans stay referred to until the listeners have seen them, hence more than one round.
    """
    for _ in range(rounds):
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(1)

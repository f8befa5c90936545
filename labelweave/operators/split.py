"""Exact stratified splits whose rows are chosen by a seeded hash of the row id.

A histogram of hash prefixes per stratum finds the one prefix in which a quota ends, the cut
hash is then ranked inside that prefix only, and all rows are classified by comparing their
hash with a table of one row per stratum. No stratum is ever sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import shuffle_key
from .lookups import lookup_join, pin
from .tables import require_columns

TEST_SHARE = 0.10
VALIDATION_SHARE = 0.19 / 0.90


def _draw(counts: DataFrame, count_col: str, share: float, out: str) -> DataFrame:
    """Quota per stratum for drawing ceil(share * n) rows.

    The remainder is apportioned by largest fraction (ties by stratum), like the usual
    stratified shuffle split. Integer arithmetic, so no rounding is involved. The windows run
    over one row per stratum.
    """
    everything = Window.partitionBy()
    order = Window.orderBy(F.desc("_rest"), F.col("stratum").asc_nulls_last())
    total = F.sum(count_col).over(everything)
    kept = total - F.ceil(F.lit(share) * total)
    sized = counts.withColumns({"_n": total, "_kept": kept})
    product = F.col(count_col).cast("decimal(20,0)") * F.col("_kept").cast("decimal(18,0)")
    sized = sized.withColumn("_floor", F.floor(product / F.col("_n")).cast("long"))
    sized = sized.withColumn("_rest", (product % F.col("_n").cast("decimal(20,0)")).cast("decimal(38,0)"))
    sized = sized.withColumn("_missing", F.col("_kept") - F.sum("_floor").over(everything))
    extra = (F.row_number().over(order) <= F.col("_missing")).cast("long")
    sized = sized.withColumn(out, F.col(count_col) - F.col("_floor") - extra)
    return sized.drop("_n", "_kept", "_floor", "_rest", "_missing")


def split_quotas(df: DataFrame, stratum: Column, shares: Sequence[float]) -> DataFrame:
    """Per stratum: rows, and cumulative quotas ``upto_0``, ``upto_1``, … of successive draws.

    Every draw takes its share of what earlier draws left. A stratum of one row is an error.
    """
    counts = df.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("rows"))
    too_small = F.raise_error(F.concat(F.lit("fewer than two rows in stratum "), F.col("stratum").cast("string")))
    rows = F.when(F.col("rows") < 2, too_small.cast("long")).otherwise(F.col("rows"))
    quotas = counts.withColumn("rows", rows).withColumn("_left", F.col("rows"))
    for i, share in enumerate(shares):
        quotas = _draw(quotas, "_left", share, f"_draw_{i}")
        quotas = quotas.withColumn("_left", F.col("_left") - F.col(f"_draw_{i}"))
        quotas = quotas.withColumn(f"upto_{i}", F.col("rows") - F.col("_left"))
    return quotas.drop("_left", *[f"_draw_{i}" for i in range(len(shares))])


def _prefix_digits(rows: int) -> int:
    """Hex digits that leave some thousand rows per prefix, five at most."""
    digits = 1
    while digits < 5 and rows > 4000 * 16**digits:
        digits += 1
    return digits


def split(
    df: DataFrame,
    id_cols: Sequence[str] | str,
    stratify: str | None = None,
    shares: Sequence[float] = (TEST_SHARE, VALIDATION_SHARE),
    names: Sequence[str] = ("test", "val", "train"),
    seed: int = 42,
    out: str = "split",
) -> DataFrame:
    """Add a column naming the part each row belongs to; the last name takes what is left.

    ``shares[0]`` is drawn from all rows, ``shares[1]`` from the rest, and so on. Row ids must
    be unique. Without ``stratify`` the whole table is one stratum.
    """
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    require_columns(df, ids + ([stratify] if stratify else []))
    # Without strata: one value for all rows that is no literal, so that joins keep an equality key.
    stratum = F.col(stratify) if stratify else F.pmod(F.xxhash64(*ids), F.lit(1))
    key = shuffle_key(seed, *[F.col(c) for c in ids])
    keys = df.select(stratum.alias("stratum"), key.alias("_hash"))
    quotas = split_quotas(df, stratum, shares)
    quotas, _ = pin(quotas)
    prefix = F.substring("_hash", 1, _prefix_digits(quotas.agg(F.sum("rows")).first()[0] or 0))
    histogram = keys.groupBy("stratum", prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("stratum").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = histogram.withColumn("_upto", F.sum("n").over(upto))
    draws = quotas.select(
        "stratum", F.posexplode(F.array(*[F.col(f"upto_{i}") for i in range(len(shares))])).alias("draw", "quota")
    )
    ends = lookup_join(filled, draws, ["stratum"], "inner", spread=["_prefix"]).filter(
        (F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("n") < F.col("quota"))
    )
    ends = ends.select("stratum", "_prefix", "draw", (F.col("quota") - F.col("_upto") + F.col("n")).alias("need"))
    inside = lookup_join(keys.withColumn("_prefix", prefix), ends, ["stratum", "_prefix"], "inner", spread=["_hash"])
    rank = F.row_number().over(Window.partitionBy("stratum", "draw").orderBy("_hash"))
    cuts = (
        inside.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("need"))
        .groupBy("stratum")
        .agg(*[F.max(F.when(F.col("draw") == i, F.col("_hash"))).alias(f"_cut_{i}") for i in range(len(shares))])
    )
    keyed = df.withColumns({"_stratum": stratum, "_hash": key})
    cut = lookup_join(keyed, cuts.withColumnRenamed("stratum", "_stratum"), ["_stratum"], spread=["_hash"])
    part = F.when(F.col("_hash") <= F.col("_cut_0"), names[0])
    for i in range(1, len(shares)):
        part = part.when(F.col("_hash") <= F.col(f"_cut_{i}"), names[i])
    cut = cut.withColumn(out, part.otherwise(names[len(shares)]))
    return cut.drop("_hash", *[f"_cut_{i}" for i in range(len(shares))], "_stratum")


def split_frames(df: DataFrame, names: Sequence[str] = ("train", "val", "test"), column: str = "split") -> dict:
    """The parts of a split table as separate DataFrames."""
    return {n: df.filter(F.col(column) == n).drop(column) for n in names}

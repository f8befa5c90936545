"""Global order without a global sort task: running totals, dense ids, seeded shuffles.

Rows are range-partitioned by their order columns, whatever the types, and sorted inside each range, which gives every row a
place. Prefix sums have two levels: over the ranges, whose number is bounded, and over runs of some thousand places inside
each range. The final window runs inside one such run, so no window grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from ..functions.hashing import shuffle_key
from ..session import materialise
from .lookups import keyed_join, lookup_join

#: Rows that a range should have, and how many ranges at most (beyond that they grow).
ROWS_PER_RANGE, MAX_RANGES = 200_000, 10_000
#: Rows of a final window. Tables of up to ``SMALL_ROWS`` rows are one window as a whole.
ROWS_PER_RUN, SMALL_ROWS = 4096, 20_000
#: Bytes of the keys from which ranges are cut, as all of them pass through the driver; keys per range at most.
KEY_SAMPLE_BYTES, KEYS_PER_RANGE = 32 << 20, 100
#: Spark draws so many times the keys it is asked for.
OVERSAMPLING = 3
_KEYS_SETTING = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


def range_cut(rows: int, key_bytes: float, rows_per_range: int = ROWS_PER_RANGE) -> tuple[int, int]:
    """Number of ranges, and of keys drawn for each, so that keys of ``key_bytes`` on average stay within ``KEY_SAMPLE_BYTES``."""
    keys = max(1, int(KEY_SAMPLE_BYTES / (OVERSAMPLING * max(key_bytes, 1.0))))
    ranges = max(1, min(-(-rows // rows_per_range), MAX_RANGES, keys))
    return ranges, max(1, min(KEYS_PER_RANGE, keys // ranges))


def _bytes(column: str, kind: DataType) -> Column:
    if isinstance(kind, StringType | BinaryType):
        return F.octet_length(F.col(column))
    return F.octet_length(F.col(column).cast("string")) if isinstance(kind, ArrayType | StructType) else F.lit(8)


@contextmanager
def _keys_per_range(spark: SparkSession, keys: int) -> Iterator[None]:
    """Range cuts inside draw ``keys`` keys for each range."""
    before = spark.conf.get(_KEYS_SETTING)
    spark.conf.set(_KEYS_SETTING, min(keys, int(before)))
    try:
        yield
    finally:
        spark.conf.set(_KEYS_SETTING, before)


def running_total(
    df: DataFrame,
    order_cols: Sequence[str],
    values: Mapping[str, Column],
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add inclusive running sums of ``values`` in the order of ``order_cols`` within ``by``.

    Any orderable columns will do. Ranges are cut over all of ``by`` and ``order_cols``, so a hot first key is split
    as well. The placed rows are stored once, as the totals and the result must see the same places. Long keys make fewer ranges,
    cut from fewer keys (``range_cut``).
    """
    order = [F.col(c) for c in order_cols]
    so_far = (Window.unboundedPreceding, Window.currentRow)
    placed = _placed(df, order_cols, by, rows_per_range)
    if placed is None:
        whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(*so_far)
        return df.withColumns({n: F.sum(v).over(whole) for n, v in values.items()})
    run = F.floor(F.col("_place") / min(ROWS_PER_RUN, rows_per_range)).cast("long")
    placed = placed.withColumn("_run", run)
    runs = placed.groupBy(*by, "_range", "_run").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    per_range = runs.groupBy(*by, "_range").agg(*[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in values])

    def before(sums: DataFrame, keys: Sequence[str], place: str, out: str) -> DataFrame:
        earlier = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        return sums.select(*keys, place, *[F.sum(f"_sum_{n}").over(earlier).alias(f"{out}_{n}") for n in values])

    in_range = before(runs, [*by, "_range"], "_run", "_inner")
    offsets = materialise(keyed_join(in_range, before(per_range, list(by), "_range", "_outer"), [*by, "_range"], "inner"), "offsets")
    summed = keyed_join(placed, offsets, [*by, "_range", "_run"], "inner")
    inside = Window.partitionBy(*by, "_range", "_run").orderBy("_place").rowsBetween(*so_far)

    def total(name: str, value: Column):
        parts = [F.sum(value).over(inside), F.col(f"_inner_{name}"), F.col(f"_outer_{name}")]
        added = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0)) for p in parts])
        return F.when(F.coalesce(*parts).isNotNull(), added)

    spare = ["_place", "_range", "_run", *[f"{level}_{n}" for level in ("_inner", "_outer") for n in values]]
    return summed.withColumns({n: total(n, v) for n, v in values.items()}).drop(*spare)


def _placed(df: DataFrame, order_cols: Sequence[str], by: Sequence[str], rows_per_range: int, pieces: int = 1) -> DataFrame | None:
    """The rows, stored in the order of ``by`` and ``order_cols``, with the number of their range and their place in it.

    A small table is not placed: nothing is returned. Others have ``pieces`` ranges at least, unless these had few rows.
    """
    widths = [F.coalesce(_bytes(c, df.schema[c].dataType), F.lit(0)).cast("double") for c in (*by, *order_cols)]
    rows, key_bytes = df.agg(F.count(F.lit(1)), F.avg(reduce(lambda x, y: x + y, widths))).first()
    if rows <= min(rows_per_range, SMALL_ROWS):
        return None
    ranges, keys = range_cut(rows, key_bytes, min(rows_per_range, max(ROWS_PER_RUN, -(-rows // pieces))))
    cut = df.repartitionByRange(ranges, *by, *order_cols).sortWithinPartitions(*by, *order_cols)
    # The number has that of the range in its upper bits and that of the row in its range, from 0 on, in the lower 33.
    with _keys_per_range(df.sparkSession, keys):
        placed = materialise(cut.withColumn("_place", F.monotonically_increasing_id()), "places")
    return placed.withColumns({"_range": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))})


def dense_id(
    df: DataFrame, order_cols: Sequence[str], out: str = "sample_id", start: int = 0,
    by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Consecutive numbers from ``start`` in the given order, within ``by``.

    A place in a range already counts the rows before it there, so placed rows need only the counts of earlier ranges,
    of which there are few, and are not shuffled again. The result lies in the pieces of the ranges, one per core at least.
    """
    placed = _placed(df, order_cols, by, rows_per_range, df.sparkSession.sparkContext.defaultParallelism)
    if placed is None:
        whole = Window.partitionBy(*by).orderBy(*[F.col(c) for c in order_cols]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, (F.sum(F.lit(1)).over(whole) - 1 + start).cast("long"))
    sizes = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")
    numbered = lookup_join(placed, sizes.select(*by, "_range", offset), [*by, "_range"], "inner")
    return numbered.withColumn(out, (F.col("_place") + F.col("_offset") + start).cast("long")).drop("_place", "_range", "_offset")


def next_id(df: DataFrame, id_col: str) -> int:
    """One above the largest id, 0 for an empty table."""
    largest = df.agg(F.max(id_col)).first()[0]
    return 0 if largest is None else largest + 1


def seeded_shuffle(df: DataFrame, id_cols: Sequence[str], seed: int = 42, keep_key: bool = False) -> DataFrame:
    """Rows in a seeded random order: range-partitioned and sorted by a hash of the id."""
    keyed = df.withColumn("shuffle_key", shuffle_key(seed, *[F.col(c) for c in id_cols]))
    ordered = keyed.orderBy("shuffle_key", *id_cols)
    return ordered if keep_key else ordered.drop("shuffle_key")


def first_of_class(
    df: DataFrame, order_col: str, sizes: DataFrame, by: Sequence[str], size_col: str = "n",
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The first ``n`` rows of every class, ``n`` taken from a per-class table.

    Equals a cyclic repetition to length ``n`` wherever repeated rows cannot change the outcome.
    """
    ranked = dense_id(df, [order_col], "_ordinal", 1, by, rows_per_range)
    sized = lookup_join(ranked, sizes.select(*by, F.col(size_col).alias("_size")), by, "inner", spread=[order_col])
    return sized.filter(F.col("_ordinal") <= F.col("_size")).drop("_ordinal", "_size")

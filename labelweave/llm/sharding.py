"""Weighted shards by rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import col, fresh

ROWS_PER_BUCKET = 100_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose score for ``key`` is highest; a shard of twice the weight gets twice the rows.

    Score: -weight / ln(u) with u a hash of (key, shard) in (0, 1). A shard that is added changes
    no other shard's score, so rows move only into it.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above zero")
    shards = [(i, float(w)) for i, w in enumerate(weights) if w > 0]

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        return F.struct((F.lit(-weight) / F.log((bits + 0.5) / float(1 << 53))).alias("score"), F.lit(-shard).alias("n"))

    return (-F.array_max(F.array(*[score(i, w) for i, w in shards])).n).cast("int")


def number_rows(df: DataFrame, group: str, row: str, out: str) -> DataFrame:
    """Gapless numbers from 0 within each group of a stored table.

    Rows are spread over small buckets by the hash of their row number; each bucket's rows are numbered
    on their own, after the sizes of the buckets before it. No task sees a whole group.
    """
    session = df.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16 * parts, df.count() // ROWS_PER_BUCKET)
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(row), F.lit(buckets)))
    sizes = spread.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(
        Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = materialise(sizes.select(group, "_bucket", F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(row)) - 1
    numbered = spread.withColumn("_within", within).join(starts, [group, "_bucket"])
    return numbered.withColumn(out, F.col("_start") + F.col("_within")).drop("_bucket", "_within", "_start")


def assign_shards(
    docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", new_weight: float = 1.0
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``shard`` follows the law ``key``: the record key and the shards alone decide. ``slot`` numbers the rows of
    a shard without gaps from 0. ``grown_shard`` is the shard with one more of ``new_weight``: the same,
    or the new one.

    - size: bytes of the text in UTF-8 plus 8; missing text has none and checksum 0.
    - Rows with the same id share a shard, and have slots of their own.
    - Rows without an id take the digest of their text as key, so that they spread over all shards.
    - An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(col(text_col), F.lit("")).cast("binary")
    key = _key(col(id_col), text)
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"),
    )
    placed = materialise(
        narrow.select(
            "row", "doc_id", "size", "text_crc32", rendezvous(F.col("key"), weights).alias("shard"),
            rendezvous(F.col("key"), [*weights, new_weight]).alias("grown_shard"),
        ),
        "placed",
    )
    return number_rows(placed, "shard", "row", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _key(id_: Column, text: Column) -> Column:
    return F.when(id_.isNotNull(), F.xxhash64(F.lit("id"), id_.cast("string"))).otherwise(F.xxhash64(F.lit("text"), text))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents, whole rows, into one folder per shard (``shard=n``), without a shuffle."""
    key = _key(col(id_col), F.coalesce(col(text_col), F.lit("")).cast("binary"))
    name = fresh(docs.columns, "shard")
    docs.withColumn(name, rendezvous(key, weights)).write.partitionBy(name).parquet(path)

"""Benchmark items found inside documents: size-partitioned MinHash containment search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import NOT_SPACES, col, fresh, with_row_ids

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of benchmark items up to which they are broadcast.
BLOCK_BYTES = 16 << 20
PROBES = 4


def words(text: Column) -> Column:
    """Lower-case words; letters and digits only, so that punctuation and spacing do not matter."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+", "")
    return F.regexp_extract_all(plain, F.lit(NOT_SPACES), F.lit(0))


def _positions(list_: Column, size: Column) -> Column:
    """Start positions of the shingles: one for each run of ``size`` words."""
    last = F.size(list_) - size
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hashes(word_hashes: Column, sizes: Sequence[int]) -> Column:
    """A 64-bit hash of each distinct shingle of any of the sizes, from the hashes of its words."""

    def of_size(size: int) -> Column:
        return F.transform(_positions(word_hashes, F.lit(size)), lambda i: F.xxhash64(*[F.get(word_hashes, i + k) for k in range(size)]))

    lists = [of_size(size) for size in sizes]
    return F.array_distinct(lists[0] if len(lists) == 1 else F.concat(*lists))


def _shingles(list_: Column, size: Column) -> Column:
    """The distinct shingles themselves."""
    return F.array_distinct(F.transform(_positions(list_, size), lambda i: F.concat_ws(" ", F.slice(list_, i + 1, size))))


def item_sketches(items: DataFrame, id_col: str, text_col: str, size: int, containment: float) -> DataFrame:
    """(item_id, words, shingles, sketch, n): distinct items with the MinHash sketch their size calls for.

    Shingles have ``size`` words; an item of fewer is one shingle of all its words, whose number ``words`` keeps.

    An item of n shingles may miss m = n - ceil(containment * n) of them in a document that holds it. Its
    sketch is its m + 1 least hashes, so a document that holds the item holds one of the sketch at
    least. Items are thereby partitioned by size: each size class has its own sketch length.
    """
    listed = items.select(col(id_col).alias("item_id"), words(col(text_col)).alias("w")).filter(F.size("w") > 0).distinct()
    hashed = listed.withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))
    length = F.least(F.size("w"), F.lit(size))
    hashes = reduce(lambda rest, k: F.when(length == k, _hashes(F.col("wh"), [k])).otherwise(rest), range(1, size), _hashes(F.col("wh"), [size]))
    both = hashed.select("item_id", length.alias("words"), _shingles(F.col("w"), length).alias("shingles"), F.array_sort(hashes).alias("hashes"))
    n = F.size("shingles")
    missing = n - F.ceil(F.round(n * F.lit(containment), 9)).cast("int")
    return both.select("item_id", "words", "shingles", F.slice("hashes", F.lit(1), missing + 1).alias("sketch"), n.alias("n"))


def _table(hashes: list[int]) -> tuple[Column, int]:
    """An open-addressed table of the hashes, as one constant: each stands in one of ``PROBES`` places from its own."""
    size = 1 << max(4, (4 * len(hashes)).bit_length())
    while True:
        slots: list[int | None] = [None] * (size + PROBES)
        for h in hashes:
            at = next((i for i in range(h & (size - 1), (h & (size - 1)) + PROBES) if slots[i] is None), None)
            if at is None:
                break
            slots[at] = h
        else:
            text = ",".join("" if h is None else str(h) for h in slots)
            return F.split(F.lit(text), ",").try_cast("array<bigint>"), size
        size *= 2


def _known(hash_: Column, table: Column, size: int) -> Column:
    start = hash_.bitwiseAND(F.lit(size - 1)).cast("int")
    found = [F.get(table, start + k).eqNullSafe(hash_) for k in range(PROBES)]
    return reduce(lambda a, b: a | b, found)


def _hashed(docs: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``docs`` with its words, ``w``, and the hashes of its shingles."""
    listed = docs.withColumn("w", words(F.col("text"))).withColumn("wh", F.transform("w", lambda w: F.xxhash64(w)))
    return listed.withColumn("hashes", _hashes(F.col("wh"), sizes)).drop("wh")


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SHINGLE,
    containment: float = CONTAINMENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment): one row for each document that holds an item.

    A document holds an item if it has ``containment`` or more of the item's distinct shingles of ``size`` words
    (lower case, letters and digits only). An item with fewer words is one shingle of its own length, and documents are
    hashed at each such length that occurs as well.

    Items are the query set. Up to ``block_bytes`` of them go to all tasks: their sketch hashes as one constant table, the items
    by broadcast. Document hashes that stand in the table make a candidate, judged once, in the row it was found in,
    by the shingles themselves; nothing of the documents is shuffled. A larger set meets the documents' hashes by one shuffle
    of hashes and row numbers, and only candidates' texts are moved.

    - Missing and empty texts, of documents or items, match nothing.
    - Each row of ``docs`` is judged on its own: repeated rows give repeated results; item rows repeated
      exactly count once.
    - Empty tables give an empty result; other columns are ignored, whatever their names.
    """
    listed_items = item_sketches(items, item_id_col, item_text_col, size, containment)
    sketches = materialise(listed_items.withColumn("item", F.monotonically_increasing_id()), "sketches")
    total = sketches.agg(
        F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s) + 16) + F.size("sketch") * 48)
    ).first()[0] or 0
    # One to ``size`` word counts: those that occur.
    sizes = [r[0] for r in sketches.select("words").distinct().orderBy("words").collect()] or [size]
    # Each hash goes out with its item's number, each item once.
    probes = sketches.select(F.explode("sketch").alias("hash"), "item")
    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    if total <= block_bytes:
        table, slots = _table(sorted(r[0] for r in probes.select("hash").distinct().collect()))
        hashed = _hashed(narrow, sizes).select("doc_id", "w", "hashes")
        hits = hashed.select("doc_id", "w", "hashes", F.filter("hashes", lambda h: _known(h, table, slots)).alias("hits"))
        # The outer form: for the plain one the optimizer would add a filter that computes all hashes twice.
        hits = hits.select("doc_id", "w", "hashes", F.explode_outer("hits").alias("hash")).join(F.broadcast(probes), "hash")
        hits = hits.join(F.broadcast(sketches), "item")
        # Of the hits of one item in one document, the least stands for all.
        once = hits.filter(F.col("hash") == F.array_min(F.array_intersect("sketch", "hashes")))
    else:
        stored, row = with_row_ids(narrow)
        hashes = _hashed(stored, sizes).select(row, F.explode_outer("hashes").alias("hash"))
        candidates = hashes.join(probes, "hash").select(row, "item").distinct()
        once = stored.join(candidates, row).join(sketches, "item").withColumn("w", words(F.col("text")))
    shared = F.size(F.array_intersect("shingles", _shingles(F.col("w"), F.col("words"))))
    every = once.select("doc_id", "item_id", shared.alias("shared"), F.col("n").alias("n_shingles"))
    return every.withColumn("containment", F.col("shared") / F.col("n_shingles")).filter(
        F.col("shared") >= F.ceil(F.round(F.col("n_shingles") * F.lit(containment), 9))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    The verdict depends on the text alone, so documents are told by a 128-bit digest of it.
    """
    digest = fresh(docs.columns, "text_digest")
    keyed = docs.withColumn(digest, F.unhex(F.md5(col(text_col))))
    guilty = contained_items(keyed, items, digest, text_col, **options).select(F.col("doc_id").alias(digest)).distinct()
    stored = materialise(guilty, "contaminated")
    return keyed.join(stored, digest, "left_anti").select(*[col(c) for c in docs.columns])

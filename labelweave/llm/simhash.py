"""Near duplicates by SimHash fingerprints, with pigeonring filtering of candidates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import col, with_row_ids, without_rows
from .components import components

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 2
SEGMENTS = 8
#: Above this many members of a bucket, linking through changed bits costs less than comparing pairs.
PAIRED = 64
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(data: bytes, limit: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``limit`` bytes, so that memory stays bounded."""
    at = 0
    while at < len(data):
        found = _SPACE.search(data, at + limit) if at + limit < len(data) else None
        end = found.start() if found else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text: a bit is set if over half of the shingle hashes have it.

    Words are split at white space, A-Z lower-cased. With fewer than ``size`` words, the sequence is the only
    shingle; without words the fingerprint is 0.
    """
    total, counts, tail = 0, np.zeros(BITS, np.int64), []
    short = True
    for words in word_lists(data.lower()):
        words = tail + words
        if len(words) >= size:
            short = False
            text = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            starts = (ends - lengths)[: len(words) - size + 1].tolist()
            hashes = [xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
            bits = np.unpackbits(np.array(hashes, np.uint64).astype("<u8").view(np.uint8), bitorder="little")
            counts += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
            total += len(hashes)
        tail = words[-(size - 1) :] if size > 1 else []
    if short and tail:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED)
    if not total:
        return 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, row: Column, size: int = SHINGLE) -> DataFrame:
    """(row_id, doc_id, print): the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(value.as_py() or b"", size) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(prints)], ["row_id", "doc_id", "print"])

    narrow = docs.select(row.alias("row_id"), col(id_col).cast("long").alias("doc_id"), col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "row_id long, doc_id long, print long")


def _signed_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def ring_masks(distance: int, segments: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each start of the ring: the mask of the segments that must be equal, and (mask, budget) of longer chains.

    Pigeonring principle: if two fingerprints differ in at most ``distance`` bits, some start has every chain of l
    consecutive segments from it differ in at most l * distance / segments bits. While that is below one, the
    segments are equal: they are the join key. A longer chain need be checked only where the budget grows next.
    """
    edges = [i * BITS // segments for i in range(segments + 1)]
    pieces = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(segments)]
    out = []
    for start in range(segments):
        chain, masks = 0, []
        for length in range(1, segments + 1):
            chain |= pieces[(start + length - 1) % segments]
            masks.append((chain, length * distance // segments))
        key = max((m for m, budget in masks if budget == 0), default=0)
        checks = [m for m, following in zip(masks, [*masks[1:], (0, distance + 1)], strict=True) if 0 < m[1] < following[1]]
        out.append((key, checks))
    return out


def _differing(mask: int) -> Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(F.lit(_signed_long(mask))))


def links(prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, paired: int = PAIRED) -> DataFrame:
    """(u, v): pairs of fingerprints that differ in at most ``distance`` bits, enough of them to connect all such pairs.

    ``prints`` has distinct fingerprints in the column print. Buckets of the ring keys with up to ``paired`` members are
    compared pair by pair: chain budgets first, the full distance last. Fingerprints in larger
    buckets are linked, just as exactly, through shared values with half the bits changed: work in
    proportion to the members instead of its square.
    """
    if not 0 <= distance <= 3 or distance >= segments:
        raise ValueError("distance must be from 0 to 3 and below the number of segments")
    ring = ring_masks(distance, segments)
    masks = F.array(*[F.lit(_signed_long(key)) for key, _ in ring])
    keyed = prints.select("print", F.posexplode(masks).alias("start", "mask")).select(
        "start", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "print"
    )
    sizes = keyed.groupBy("start", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialise(keyed.join(materialise(sizes, "buckets"), ["start", "key"]), "members")
    cold = members.filter(F.col("n") <= paired)
    pairs = cold.select("start", "key", F.col("print").alias("a")).join(
        cold.select("start", "key", F.col("print").alias("b")), ["start", "key"]
    ).filter("a < b")
    within = reduce(
        lambda whole, i: whole | ((F.col("start") == i) & reduce(lambda x, y: x & y, [_differing(m) <= n for m, n in ring[i][1]], F.lit(True))),
        range(segments), F.lit(False),
    )
    compared = pairs.filter(within).filter(_differing((1 << 64) - 1) <= distance).select(F.col("b").alias("u"), F.col("a").alias("v"))
    hot = members.filter(F.col("n") > paired).select("print").distinct()
    return compared.unionAll(_links_by_changes(hot, distance)).distinct()


def _changes(bits: int) -> list[int]:
    return [sum(1 << b for b in chosen) for chosen in combinations(range(BITS), bits)]


def _links_by_changes(prints: DataFrame, distance: int) -> DataFrame:
    """Links through a value that both fingerprints reach by changing up to half of ``distance`` bits.

    Two members that reach a value by r changes each differ in 2r bits at most, and any two that differ so share
    one. For an odd distance, others that reach it by r + 1 changes link to a member of it as well.
    """
    half = distance // 2
    near = [_signed_long(m) for bits in range(half + 1) for m in _changes(bits)]

    def reach(masks: list[int]) -> DataFrame:
        flips = F.explode(F.array(*[F.lit(m) for m in masks]))
        return prints.select("print", flips.alias("mask")).select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("value"))

    reached = reach(near)
    hubs = reached.groupBy("value").agg(F.min("print").alias("hub"), F.count(F.lit(1)).alias("n"))
    shared = materialise(hubs if distance % 2 else hubs.filter("n > 1"), "hubs")
    joined = reached.join(shared, "value")
    if distance % 2:
        joined = joined.unionByName(reach([_signed_long(m) for m in _changes(half + 1)]).join(shared, "value"))
    return joined.filter("print <> hub").select(F.greatest("print", "hub").alias("u"), F.least("print", "hub").alias("v"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None,
    size: int = SHINGLE, distance: int = DISTANCE,
) -> DataFrame:
    """One row per document: row_id, doc_id, fingerprint (16 hex digits), component_id, kept.

    Documents whose fingerprints differ in at most ``distance`` bits are linked; component_id is the smallest id
    that links reach. One document of each component is kept: the one with that id.

    - Missing text counts as empty. Texts without words have fingerprint 0 and are linked like others.
    - Rows without an id come last; a component without any id has a missing component_id.
    - Of rows that repeat the smallest id, one is kept.
    - An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    row = col(row_col) if row_col else F.monotonically_increasing_id()
    marked = materialise(with_fingerprints(docs, id_col, text_col, row, size), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    distinct = materialise(marked.groupBy("print").agg(first.alias("first")), "distinct")
    roots = materialise(components(links(distinct.select("print"), distance)), "roots")
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "first", F.coalesce("root", "print").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = materialise(rooted.select("print", "root").join(materialise(least, "leasts"), "root").select("print", "least"), "named")
    return marked.join(named, "print").select(
        "row_id", "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.col("least.doc_id").alias("component_id"), (F.col("row_id") == F.col("least.row_id")).alias("kept"),
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """One document of each component, with all its columns."""
    rows, row_col = with_row_ids(docs)
    groups = near_groups(rows, id_col, text_col, row_col, size, distance)
    dropped = groups.filter(~F.col("kept")).select(F.col("row_id").alias(row_col))
    return without_rows(rows, row_col, dropped, docs.columns)

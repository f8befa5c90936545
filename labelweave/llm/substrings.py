"""Passages that repeat across documents, found by recompression."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import col, release

WINDOW = 13
ROUNDS = 8
#: Words that are parsed together.
PIECE_WORDS = 1 << 17
#: Rows that a task holds to combine them before they are shuffled.
HELD_ROWS = 1 << 21
NO_ID = (1 << 63) - 1
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(a) * _MIX[2] + b)


def _runs(name: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each run of one token as a symbol (token, length): names, marks, and what each symbol depends on.

    Where a run ends depends on the tokens beside it, so its range is one token wider on either side.
    """
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | mark[1:] | mark[:-1]
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(name))
    length = (ends - starts).astype(np.uint64)
    first = name[starts]
    symbol = np.where(length > 1, _pair(first, length), first)
    edge = mark[starts]
    return symbol, edge, np.where(edge, starts, starts - 1), np.where(edge, ends, ends + 1)


def anchors(name: np.ndarray, mark: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """For each window of tokens, the name of a symbol inside it that depends on the window's tokens alone.

    ``mark`` is set at separators, with one at either end. Round by round, runs of one token and then
    pairs of neighbours become symbols. A pair is joined if a bit of its left name is 0 and of its right name 1, drawn
    anew each round; a name is a hash of what it stands for, so all tasks give equal strings equal names
    without having to meet. With every symbol goes the range of tokens that settled it. Equal windows
    hold the same settled symbols; the highest, then the first, of them is taken. Windows without any
    take 0 (their caller names them by their whole content).
    """
    size = len(name)
    symbol, edge, low, high = _runs(name, mark)
    levels = []
    for k in range(rounds):
        bit = (_mixed(symbol + np.uint64((k + 1) * int(_MIX[2]) % (1 << 64))) >> np.uint64(63)).astype(bool)
        left, right = ~bit & ~edge, bit & ~edge
        joins = np.zeros(len(symbol), bool)
        joins[:-1] = left[:-1] & right[1:]
        at = np.flatnonzero(~np.concatenate([[False], joins[:-1]]))
        after, before = np.minimum(at + 1, len(symbol) - 1), np.maximum(at - 1, 0)
        merged, lone_left, lone_right = joins[at], left[at] & ~joins[at], right[at]
        symbol, low, high, edge = (
            np.where(merged, _pair(symbol[at], symbol[after]), symbol[at]),
            np.where(lone_right, low[before], low[at]),
            np.where(merged | lone_left, high[after], high[at]),
            edge[at],
        )
        fits = merged & (high - low <= window)
        # What else is parsed together must not matter: all rounds run, also after one in which nothing fits.
        if fits.any():
            levels.append((symbol[fits], low[fits], high[fits]))
    out = np.zeros(size, np.uint64)
    open_ = np.ones(size, bool)
    places = np.arange(size)
    for names, lows, highs in reversed(levels):
        following = np.full(size, len(names), np.int64)
        following[lows[::-1]] = np.arange(len(names))[::-1]
        following = np.minimum.accumulate(following[::-1])[::-1]
        found = np.minimum(following, len(names) - 1)
        use = open_ & (following < len(names)) & (highs[found] <= places + window)
        out[use] = names[found[use]]
        open_ &= ~use
    return out


def _content(halves: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of what stands in each window that begins at ``starts``."""
    out = []
    for side in range(2):
        total = np.zeros(len(starts), np.uint64)
        for k in range(window):
            total = total * _MIX[side] + halves[starts + k, side]
        out.append(_mixed(total))
    return out[0], out[1]


class Parsed:
    """Windows of some documents' words: document, place, symbol and content of each."""

    def __init__(self, lists: list[tuple[int, int, list[bytes]]], window: int) -> None:
        """``lists``: (document, place of the first word, words)."""
        blobs, sizes = [], []
        for _, _, words in lists:
            blobs.append(b"".join(map(xxhash.xxh3_128_digest, words)))
            blobs.append(b"\0" * 16)
            sizes.append(len(words))
        self.halves = np.frombuffer(b"\0" * 16 + b"".join(blobs), "<u8").reshape(-1, 2)
        lengths = np.array(sizes, np.int64)
        stops = np.cumsum(lengths + 1)
        mark = np.zeros(len(self.halves), bool)
        mark[0] = True
        mark[stops] = True
        starts = [np.arange(stop - n, stop - window + 1) for stop, n in zip(stops.tolist(), sizes, strict=True) if n >= window]
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        whose = [np.full(n - window + 1, doc) for (doc, _, _), n in zip(lists, sizes, strict=True) if n >= window]
        self.docs = np.concatenate(whose) if whose else np.zeros(0, np.int64)
        shift = [np.arange(first, first + n - window + 1) for (_, first, _), n in zip(lists, sizes, strict=True) if n >= window]
        self.places = np.concatenate(shift) if shift else np.zeros(0, np.int64)
        self.window = window
        names = anchors(self.halves[:, 0].copy(), mark, window)[self.starts]
        bare = np.flatnonzero(names == 0)
        if len(bare):
            names[bare] = _content(self.halves, self.starts[bare], window)[0]
        self.names = names.view(np.int64)

    def content(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = _content(self.halves, self.starts[chosen], self.window)
        return first.view(np.int64), second.view(np.int64)


def _parsed(texts: Iterable[tuple[int, bytes]], window: int, limit: int = PIECE_WORDS) -> Iterator[Parsed]:
    """Parse texts together, up to ``limit`` words; longer ones in parts that share ``window`` - 1 words."""
    lists, held = [], 0
    for doc, data in texts:
        words = data.split()
        for at in range(0, max(len(words) - window + 1, 0), limit):
            part = words[at : at + limit + window - 1]
            lists.append((doc, at, part))
            held += len(part)
            if held >= limit:
                yield Parsed(lists, window)
                lists, held = [], 0
    if lists:
        yield Parsed(lists, window)


def _texts(column: pa.Array) -> Iterator[tuple[int, bytes]]:
    return ((i, value.as_py() or b"") for i, value in enumerate(column))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column; missing ones are empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _symbols(docs: DataFrame, window: int, limit: int = HELD_ROWS) -> DataFrame:
    """(route, other, sure): the symbols that stand for the windows of each content, combined before they are shuffled.

    Of the contents a task sees, a symbol that one has goes out as (name, key, false). One that several have
    is known to be shared: all of them go out as (key, name, true), and one as (name, key, false), so that a
    symbol of a third of all documents makes one row a task.
    """

    def combined(keys: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((keys, names))
        k, n = keys[order], names[order]
        first = np.ones(len(n), bool)
        first[1:] = n[1:] != n[:-1]
        new = first.copy()
        new[1:] |= k[1:] != k[:-1]
        group = np.cumsum(first) - 1
        several = (np.bincount(group[new], minlength=group[-1] + 1) > 1)[group] & new
        # In the order of the documents, where equal keys stand together and compress well.
        lone, sure = np.sort(order[first]), np.sort(order[several])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([names[lone], keys[sure]])), pa.array(np.concatenate([keys[lone], names[sure]])),
             pa.array(np.arange(len(lone) + len(sure)) >= len(lone))],
            ["route", "other", "sure"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            for parsed in _parsed(_texts(batch.column(0)), window):
                doc, name = parsed.docs, parsed.names
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
                held.append((keys[doc[new]], name[new]))
                size += len(held[-1][0])
                if size >= limit:
                    yield combined(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield combined(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("text", "key").mapInArrow(run, "route long, other long, sure boolean")


def _windows(docs: DataFrame, window: int, limit: int = HELD_ROWS) -> DataFrame:
    """(k1, k2, order, key, place): windows whose symbol is shared, by 96 bits of their content.

    Of equal windows a task sees, those of the smallest order go out to meet others, the first place of each document
    for all; the rest, of which an earlier owner is known already, have -1 - place.
    """
    names = ["k1", "k2", "order", "key", "place"]

    def combined(k1, k2, orders, keys, places) -> pa.RecordBatch:
        by = np.lexsort((places, keys, orders, k2, k1))
        k1, k2, orders, keys, places = (c[by] for c in (k1, k2, orders, keys, places))
        first, again = np.ones(len(by), bool), np.zeros(len(by), bool)
        first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        again[1:] = ~first[1:] & (orders[1:] == orders[:-1]) & (keys[1:] == keys[:-1])
        late = orders > orders[np.flatnonzero(first)][np.cumsum(first) - 1]
        # A document sends a window that it repeats once. Back in the order of the documents, whose columns compress well.
        sent = np.flatnonzero(late | ~again)
        sent = sent[np.lexsort((places[sent], keys[sent]))]
        k1, k2, orders, keys, places, sure = (c[sent] for c in (k1, k2, orders, keys, places, late))
        # Those only pass through the shuffle: they are dealt by their document, without random bytes.
        k1, k2, places = np.where(sure, keys, k1), np.where(sure, places, k2), np.where(sure, -1 - places, places)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (k1, k2, orders, keys, places)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            orders, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            shared = _arrays(batch.column(3))
            for parsed in _parsed(_texts(batch.column(0)), window):
                cuts = np.append(np.flatnonzero(np.diff(parsed.docs, prepend=-1)), len(parsed.docs))
                member = np.zeros(len(parsed.docs), bool)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    member[a:b] = np.isin(parsed.names[a:b], shared[parsed.docs[a]])
                chosen = np.flatnonzero(member)
                first, second = parsed.content(chosen)
                doc = parsed.docs[chosen]
                held.append((first, second.astype(np.int32), orders[doc], keys[doc], parsed.places[chosen].astype(np.int32)))
                size += len(chosen)
                if size >= limit:
                    yield combined(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if size:
            yield combined(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("text", "order", "key", "shared").mapInArrow(
        run, "k1 long, k2 int, order long, key long, place int"
    )


def _equal_places(words: list[bytes], places: np.ndarray, window: int) -> np.ndarray:
    """All places of a document whose windows equal one of those at ``places``."""
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    first, second = _content(halves, np.arange(len(words) - window + 1), window)
    found = np.flatnonzero(np.isin(first, first[places]))
    if len(found) == len(places):
        return places
    wanted = set(zip(first[places].tolist(), second[places].tolist(), strict=True))
    return np.array([p for p in found.tolist() if (int(first[p]), int(second[p])) in wanted])


def _cut(data: bytes, places: np.ndarray, window: int, whole: bool) -> tuple[int, int, bytes]:
    """Words, removed words and the words left. ``whole``: an earlier document has the same text."""
    words = data.split()
    if whole and len(words) >= window:
        return len(words), len(words), b""
    if not len(places):
        return len(words), 0, b" ".join(words)
    places = _equal_places(words, places, window)
    step = np.zeros(len(words) + 1, np.int64)
    step[places] += 1
    step[places + window] -= 1
    gone = np.cumsum(step[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return len(words), int(gone.sum()), b" ".join(kept)


def repeated_windows(docs: DataFrame, copies: DataFrame, window: int = WINDOW, held_rows: int = HELD_ROWS) -> DataFrame:
    """(key, order, place): where the windows of a content start that a document with a smaller order has as well.

    ``docs`` has doc_id, key, key2 and text; ``copies`` the first order of each content that several have (key, firsts).
    Round one gathers which symbols several contents have. Round two verifies: the windows behind such symbols meet by
    their own content, and the smallest order owns each. Of equal contents only the first takes part.
    """
    symbols = _symbols(docs, window, held_rows)
    every = Window.partitionBy("route", "sure")
    ends = symbols.withColumn("low", F.min("other").over(every)).withColumn("high", F.max("other").over(every))
    key, name = (F.when(F.col("sure"), F.col(a)).otherwise(F.col(b)) for a, b in (("route", "other"), ("other", "route")))
    shared = ends.filter("sure OR low < high").select(key.alias("key"), name.alias("name"))
    suspects = shared.groupBy("key").agg(F.collect_set("name").alias("shared")).join(copies, "key", "left")
    stored = materialise(suspects, "suspects")
    release(docs)
    order = F.coalesce("doc_id", F.lit(NO_ID))
    open_ = docs.join(stored, "key").withColumn("order", order).filter(F.col("order") <= F.coalesce(_first(), F.col("order")))
    by_content = Window.partitionBy("k1", "k2").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = _windows(open_, window, held_rows).withColumn("low", F.min("order").over(by_content))
    place = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place"))
    return owned.filter("place < 0 OR low < order").select("key", "order", place.alias("place"))


def _first() -> Column:
    """The first order of a row's content, if others have it too."""
    return F.get(F.filter("firsts", lambda c: c.key2 == F.col("key2")), 0).first


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, held_rows: int = HELD_ROWS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each document without the words of windows that an earlier one has.

    A window is ``window`` consecutive words of one document. Each word covered by a window whose words also start in
    a document with a smaller id goes; windows are judged on the input. ``kept`` joins the words left by one space. A task combines ``held_rows`` rows at a time.

    - Missing text has no words. Texts shorter than the window stay whole.
    - A missing id comes after every id; two documents without an id do not remove each other's words, nor do
      rows that share an id.
    - One row per input row, repeated ones too; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(col(text_col).cast("binary"), F.lit(b""))
    narrow = docs.select(
        col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("key2"), text.alias("text")
    )
    order = F.coalesce("doc_id", F.lit(NO_ID))
    contents = narrow.groupBy("key", "key2").agg(F.min(order).alias("first"), F.max(order).alias("last")).filter("first < last")
    copies = materialise(contents.groupBy("key").agg(F.collect_list(F.struct("key2", "first")).alias("firsts")), "copies")
    repeats = repeated_windows(narrow, copies, window, held_rows)
    found = repeats.groupBy("key").agg(F.collect_set(F.struct("order", "place")).alias("found"))
    verdicts = found.join(copies, "key", "full")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, whole = _arrays(batch.column(2)), batch.column(3).to_pylist()
            rows = [_cut(data, found[i], window, whole[i]) for i, data in _texts(batch.column(1))]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                 pa.array([c.decode() for c in columns[2]], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    # Places belong to the first document of a content; whoever comes later goes whole.
    own = F.filter("found", lambda p: p.order == order)
    joined = narrow.join(verdicts, "key", "left").select(
        "doc_id", "text", F.coalesce(F.transform(own, lambda p: p.place), F.array().cast("array<int>")).alias("places"),
        F.coalesce(order > _first(), F.lit(False)).alias("whole"),
    )
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")

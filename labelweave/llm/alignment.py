"""Alignment of two tokenizers' tokens by the byte places where both end one, and links between their ids."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import col
from .segments import HELD_BYTES, byte_characters, load_tokenizer, packed, read_text, slices

#: Id pairs whose counts are broadcast: 24 bytes each. Rarer pairs are joined by shuffle.
HOT_PAIRS = 1 << 19
#: Characters of text whose rows make one batch.
BATCH_CHARS = 1 << 18
#: Links of a group that are written out one by one.
GROUP_LINKS = 1 << 12
# Both vocabularies begin a token at a single space between two other characters.
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
# Letters without combining forms, then marks: two pre-tokens of the byte-level vocabulary.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library: ids of a space and a text, and the bytes of each id."""

    def __init__(self, definition: str) -> None:
        self.tokenizer = load_tokenizer(definition, plain=True)
        characters = byte_characters()
        back, names = {c: b for b, c in characters.items()}, self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(names.values(), default=-1) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(back[c] for c in name)
        self.written = str.maketrans({chr(c): "".join(characters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)})
        self.space = characters[0x20]

    def encode_all(self, segments: list[str]) -> list[bytes]:
        """Letters after a space are one pre-token, marks after them another: these go to the tokenizer's model at once."""
        out: list[bytes | None] = [None] * len(segments)
        tokenize, others = self.tokenizer.model.tokenize, []
        for i, segment in enumerate(segments):
            found = _PLAIN.fullmatch(segment)
            if found:
                letters, marks = found.groups()
                ids = [t.id for t in tokenize(self.space + (letters if letters.isascii() else letters.translate(self.written)))]
                out[i] = packed(ids + [t.id for t in tokenize(marks)] if marks else ids, 4)
            else:
                others.append(i)
        encoded = self.tokenizer.encode_batch([" " + segments[i] for i in others], add_special_tokens=False)
        for i, e in zip(others, encoded, strict=True):
            out[i] = packed(e.ids, 4)
        return out


class PieceLevel:
    """A sentencepiece model, which sets the space before a text itself."""

    def __init__(self, model: bytes) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = []
        for i in range(self.processor.get_piece_size()):
            piece = self.processor.id_to_piece(i)
            byte = _BYTE.fullmatch(piece) if self.processor.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode_all(self, segments: list[str]) -> list[bytes]:
        return [packed(ids, 4) for ids in self.processor.encode(segments, num_threads=1)]


class Encoder:
    """Ids of whole texts by two vocabularies, through one cache of segments.

    Segments end where a space and a word begin, which no token of either crosses; the vocabularies set that space again.
    """

    def __init__(self, definition: str, model: bytes, limit: int = HELD_BYTES) -> None:
        self.sides = ByteLevel(definition), PieceLevel(model)
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in self.sides]
        count = max(map(len, self.lengths))
        self.numbers = [f"{i}{mark}" for mark in ",|;" for i in range(count)]
        self.limit, self.held = limit, 0
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.odd: set[str] = set()

    def _learn(self, segments: set[str]) -> None:
        if self.held > self.limit:
            self.known, self.older, self.held = {}, self.known, 0
        known, older = self.known, self.older
        missing = [s for s in segments if s not in known]
        again = [s for s in missing if s in older]
        known.update((s, older[s]) for s in again)
        new = [s for s in missing if s not in known] if again else missing
        if new:
            found = [side.encode_all(new) for side in self.sides]
            known.update(zip(new, zip(*found, strict=True), strict=True))
            self.odd.update(self._unfaithful(new, found))
        # Ids take four bytes for a character at most.
        self.held += 9 * sum(map(len, missing)) + 330 * len(missing)

    def _unfaithful(self, segments: list[str], found: list[list[bytes]]) -> set[str]:
        """Segments whose tokens, joined, are not a space and the segment, on either side."""
        texts = [b" " + s.encode() for s in segments]
        sizes, whole, out = np.array([len(t) for t in texts]), b"".join(texts), set()
        for side, ids in enumerate(found):
            every = b"".join(ids)
            of = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
            same = np.bincount(of, self.lengths[side][np.frombuffer(every, np.uint32)], len(ids)) == sizes
            # Equal as a whole and in each length: then all are equal one by one.
            if not same.all() or self._joined(side, every) != whole:
                out.update(s for s, x, t in zip(segments, ids, texts, strict=True) if self._joined(side, x) != t)
        return out

    def _joined(self, side: int, ids: bytes) -> bytes:
        return b"".join(map(self.sides[side].bytes.__getitem__, memoryview(ids).cast("I")))

    def ids(self, texts: list[str]) -> Iterator[tuple[bytes, bytes] | None]:
        """For each text, the ids of both sides; None for a text without tokens."""
        parts = [[_CUT.split(part[1:] if k else part) for k, part in enumerate(slices(text, _CUT))] if text else [] for text in texts]
        self._learn({s for text in parts for segments in text for s in segments})
        for text, found in zip(texts, parts, strict=True):
            pairs = [pair for segments in found for pair in map(self.known.__getitem__, segments)]
            sides = [b"".join([pair[k] for pair in pairs]) for k in (0, 1)]
            suspect = self.odd and not all(self.odd.isdisjoint(segments) for segments in found)
            if not text or suspect and not self._joined(0, sides[0]) == self._joined(1, sides[1]) == b" " + text.encode():
                yield None
            else:
                yield sides[0], sides[1]


@lru_cache(maxsize=2)
def encoder(definition: str, model: bytes) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(definition, model)


def gallop(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each value of ``short``, the place of the first value of ``long`` that is not below it.

    Both ascend. From ``start``, a first guess for each, steps of 1, 2, 4, … bracket the place on either side, then
    halving finds it; all values go in step. The cost per value is the logarithm of how far the guess is off.
    """
    last = len(long)
    low = np.clip(start, 0, last)
    high = low.copy()
    step = 1
    open_ = np.flatnonzero((low > 0) & (long[np.maximum(low - 1, 0)] >= short))  # the place is before the guess
    while len(open_):
        high[open_] = low[open_]
        low[open_] = np.maximum(low[open_] - step, 0)
        step *= 2
        at = low[open_]
        open_ = open_[(at > 0) & (long[np.maximum(at - 1, 0)] >= short[open_])]
    step = 1
    # A guess that was too far has its bracket by now; elsewhere low = high, and the place is at or after it.
    open_ = np.flatnonzero((low == high) & (high < last) & (long[np.minimum(high, last - 1)] < short))
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(high[open_] + step, last)
        step *= 2
        at = high[open_]
        open_ = open_[(at < last) & (long[np.minimum(at, last - 1)] < short[open_])]
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        below = long[middle] < short[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def common_ends(a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into two ascending lists of ends where they hold the same place. The shorter drives the search.

    The lists may be those of several texts in a row, which begin at ``start_a`` and ``start_b``.
    """
    if len(b) < len(a):
        second, first = common_ends(b, a, start_b, start_a)
        return first, second
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Tokens are about evenly long, so the share of a text's list is the first guess.
    size_a, size_b = np.diff(start_a, append=len(a)), np.diff(start_b, append=len(b))
    inside = np.arange(len(a)) - np.repeat(start_a, size_a)
    guess = np.repeat(start_b, size_a) + inside * np.repeat(size_b, size_a) // np.repeat(np.maximum(size_a, 1), size_a)
    places = gallop(a, b, guess)
    found = np.flatnonzero((places < len(b)) & (b[np.minimum(places, len(b) - 1)] == a))
    return found, places[found]


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.int64) << 32 | right


class Aligned:
    """Groups of some texts' tokens, one text after another.

    ``start_a`` and ``start_b`` are the ranks of each text's first tokens; ``cuts_a`` and ``cuts_b`` those after which groups end.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> None:
        self.a, self.b, self.start_a, self.start_b = a, b, start_a, start_b
        at_a, at_b = common_ends(ends_a, ends_b, start_a, start_b)
        self.cuts_a, self.cuts_b = at_a + 1, at_b + 1
        self.sizes_a = np.diff(self.cuts_a, prepend=0)
        self.sizes_b = np.diff(self.cuts_b, prepend=0)
        # Groups before each text; the last entry counts all.
        self.groups = np.append(np.searchsorted(self.cuts_a, start_a, "right"), len(self.cuts_a))
        self.text_of = np.repeat(np.arange(len(start_a)), np.diff(self.groups))

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, id pair (A's id in the high 32 bits) and number of links of each distinct linked pair of a text.

        Within a group, each token of one side is linked with each of the other. Groups of many links are counted by
        their distinct ids, so a long stretch without common ends is not written out.
        """
        sizes = self.sizes_a * self.sizes_b
        small = np.flatnonzero(sizes <= GROUP_LINKS)
        counts = sizes[small]
        group = np.repeat(small, counts)
        inside = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
        width = self.sizes_b[group]
        left = self.a[(self.cuts_a - self.sizes_a)[group] + inside // width]
        right = self.b[(self.cuts_b - self.sizes_b)[group] + inside % width]
        texts, pairs, times = [self.text_of[group]], [_joined(left, right)], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(sizes > GROUP_LINKS).tolist():
            ids_a, n_a = np.unique(self.a[self.cuts_a[g] - self.sizes_a[g] : self.cuts_a[g]], return_counts=True)
            ids_b, n_b = np.unique(self.b[self.cuts_b[g] - self.sizes_b[g] : self.cuts_b[g]], return_counts=True)
            pairs.append(_joined(np.repeat(ids_a, len(ids_b)), np.tile(ids_b, len(ids_a))))
            times.append(np.outer(n_a, n_b).ravel())
            texts.append(np.full(len(times[-1]), self.text_of[g]))
        text, pair, time = map(np.concatenate, (texts, pairs, times))
        order = np.lexsort((pair, text))
        text, pair, time = text[order], pair[order], time[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        return text[first], pair[first], np.add.reduceat(time, first) if len(first) else time

    def written(self, numbers: list[str]) -> list[str]:
        """Each text's groups as a1,a2|b1;a3|b2,b3. ``numbers``: decimal numbers with a comma, with a bar, then with a semicolon."""
        size = len(numbers) // 3
        flat_a, flat_b = self.a.astype(np.int64), self.b.astype(np.int64)
        flat_a[self.cuts_a - 1] += size
        flat_b[self.cuts_b - 1] += 2 * size
        flat = np.empty(len(self.a) + len(self.b), np.int64)
        flat[np.arange(len(self.a)) + np.repeat(self.cuts_b - self.sizes_b, self.sizes_a)] = flat_a
        flat[np.arange(len(self.b)) + np.repeat(self.cuts_a, self.sizes_b)] = flat_b
        names = list(map(numbers.__getitem__, flat.tolist()))
        begins = (self.start_a + self.start_b).tolist()
        return ["".join(names[x:y])[:-1] for x, y in zip(begins, [*begins[1:], len(names)], strict=True)]


def align(docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts, pairs, times, groups_sha256): both token lists of each text and their groups.

    A's ids are those of a space and the text, B's those of the text, before which the model sets a space; strings of
    special tokens are ordinary text. Byte places where tokens of both end cut the lists into groups: group g ends
    after ``a_cuts[g]`` tokens of A and ``b_cuts[g]`` of B. ``pairs`` are the distinct linked id pairs, A's id in the high
    32 bits, and ``times`` how many links each has.

    - Missing and empty texts have no tokens, nor have texts whose tokens, joined, differ from space and text (a
      literal U+2581, for instance): empty lists and an empty digest.
    - One row per input row, repeated ones too; an empty table gives an empty result; other columns are ignored.
    - Long texts are encoded in slices; lists are in proportion to the text.

    The vocabularies are files of the driver's machine; they are sent along.
    """
    context = docs.sparkSession.sparkContext
    with open(piece_model, "rb") as file:
        model = context.broadcast(file.read())
    definition = context.broadcast(read_text(byte_vocabulary))
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    names = ["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts", "pairs", "times", "groups_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(definition.value, model.value)
        for batch in batches:
            texts, begin, held = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held >= BATCH_CHARS:
                    yield _aligned(batch.column(0)[begin : i + 1], texts, own, names)
                    texts, begin, held = [], i + 1, 0
            if texts:
                yield _aligned(batch.column(0)[begin:], texts, own, names)

    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    schema = f"doc_id {kind}, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, pairs array<long>, times array<long>, groups_sha256 string"
    return narrow.mapInArrow(run, schema)


def _aligned(doc_ids: pa.Array, texts: list[str], own: Encoder, names: list[str]) -> pa.RecordBatch:
    ids = list(own.ids(texts))
    sides = [[np.frombuffer(pair[k], np.uint32) if pair else np.zeros(0, np.uint32) for pair in ids] for k in (0, 1)]
    sizes = [np.array([len(x) for x in side]) for side in sides]
    a, b = map(np.concatenate, sides)
    start_a, start_b = (np.cumsum(n) - n for n in sizes)
    # All texts here cover the same bytes on both sides, so their ends can be counted on over texts.
    found = Aligned(a, b, np.cumsum(own.lengths[0][a]), np.cumsum(own.lengths[1][b]), start_a, start_b)
    of, pairs, times = found.links()
    groups = found.groups
    per_text = np.searchsorted(of, np.arange(len(texts) + 1))
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in found.written(own.numbers)]
    cuts_a, cuts_b = found.cuts_a - start_a[found.text_of], found.cuts_b - start_b[found.text_of]
    columns = [(a, np.append(start_a, len(a))), (b, np.append(start_b, len(b))), (cuts_a, groups), (cuts_b, groups)]
    lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.astype(np.int32))) for v, o in columns]
    lists += [pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.array(v.astype(np.int64))) for v in (pairs, times)]
    return pa.RecordBatch.from_arrays([doc_ids, *lists, pa.array(digests, pa.string())], names)


def pair_counts(aligned: DataFrame, pairs_col: str = "pairs") -> DataFrame:
    """(pair, n, best): documents that hold each linked id pair, and whether no pair of the same A id has more.

    Pairs are counted per task before they are shuffled. The maxima are one row per id of A's vocabulary, which bounds
    what is broadcast.
    """
    counts = materialise(
        aligned.select(F.explode(pairs_col).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts"
    )
    a_id = F.shiftright("pair", 32)
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("n").alias("highest"))
    joined = counts.withColumn("a_id", a_id).join(F.broadcast(highest), "a_id")
    return joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _hot_count(counts: DataFrame, limit: int) -> int:
    """The least power of two such that at most ``limit`` pairs are held by that many documents."""
    power = F.length(F.bin("n")) - 1
    sizes = {r["power"]: r["pairs"] for r in counts.groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    total, least = 0, 64
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > limit:
            break
        least = k
    return 1 << min(least, 62)


def link_scores(
    docs: DataFrame, byte_vocabulary: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): the alignment of each text, scored corpus-wide.

    An id pair's count is the number of rows that hold it linked. ``n_best`` are the links whose pair has the highest
    count of all pairs of its A id, ties included; ``count_sum`` adds up the counts of all links. Cases as for ``align``;
    texts without tokens have zeros.

    Aligned lists are stored once. Links meet the counts in two ways: the at most ``hot_pairs`` most frequent pairs are
    broadcast, and only links of rarer pairs are shuffled, whose counts bound what one key can hold.
    """
    key = F.struct(col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    found = align(docs.select(key.alias("key"), col(text_col).alias("text")), byte_vocabulary, piece_model, "key")
    links_in = F.aggregate("times", F.lit(0).cast("long"), lambda s, t: s + t)
    sizes = {"n_a": F.size("a_ids"), "n_b": F.size("b_ids"), "n_groups": F.size("a_cuts"), "n_links": links_in}
    aligned = materialise(found.select(
        "doc_id.doc_id", "doc_id.row", *[c.cast("long").alias(n) for n, c in sizes.items()], "pairs", "times", "groups_sha256"
    ), "aligned")
    counts = materialise(pair_counts(aligned), "pairs")
    least = _hot_count(counts, hot_pairs)
    links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select(
        "row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times")
    )
    hot = F.broadcast(counts.filter(F.col("n") >= least))
    if least == 1:
        totals = _sums(links.join(hot, "pair"))
    else:
        known = links.join(hot, "pair", "left")
        rare = known.filter(F.col("n").isNull()).select("row", "pair", "times").join(counts.filter(F.col("n") < least), "pair")
        both = _sums(known.filter(F.col("n").isNotNull())).unionByName(_sums(rare))
        totals = both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zeros = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_best", "count_sum")]
    return aligned.join(totals, "row", "left").select("doc_id", *sizes, *zeros, "groups_sha256")


def _sums(links: DataFrame) -> DataFrame:
    best = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    return links.groupBy("row").agg(best.alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))

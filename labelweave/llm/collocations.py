"""Collocations: phrases of two to four words that occur more often than their parts suggest, for each language."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise
from .common import col

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if a longer one that holds it has this share (in hundredths) of its occurrences.
HELD_SHARE = 80
SCALE = 2_000_000
#: Bits of the filters of frequent phrases: 8 MB.
FILTER_BITS = 1 << 26
#: Rows that a task combines before they are shuffled, and text bytes taken up at a time.
HELD_ROWS, CHUNK_BYTES = 1 << 18, 1 << 19
#: Words, and bytes of them, whose counts a task holds, and words in one Arrow batch.
HELD_WORDS, HELD_BYTES, SENT_WORDS = 1 << 17, 16 << 20, 1 << 15
#: Text bytes of one language that are turned into keys together.
CODED_BYTES = 1 << 20
#: Word keys that are handled together, which stay in a core's cache.
CHUNK_WORDS = 1 << 16
#: Candidate phrases in one trie, and groups of first words that tries are put together from.
TRIE_PHRASES, FIRST_GROUPS = 1 << 18, 4096
#: The texts of one such part, by their hash, name most candidates; the others are searched for the rest.
NAMING_PARTS = 16
#: Bytes of one Arrow batch of texts or keys. Larger buffers are not pooled, and an executor does not give all of them back.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Parts of the phrase keys, by their first bits, in which counts are added up.
KEY_PART_BITS = 12
#: Parts into which a language's candidates are dealt for ranking.
RANK_PARTS = 64

# Bytes that end a piece become 0xFF, which no UTF-8 text holds.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)
_END = b"\xff"
_TEXT_END = b"\xfe"
_BREAK = re.compile(rb"[ \t.,;:!?\x0a-\x0d]")
_SHIFTS = (0, 32)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[2] + (b ^ (b >> np.uint64(29))) * _MIX[0]
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    return x ^ (x >> np.uint64(29))


def _tokens(data: bytes) -> list[bytes]:
    """Words, and a 0xFF where a piece ends."""
    return _marked(data).split()


def _marked(data: bytes) -> bytes:
    """In lower case, with a 0xFF for every mark."""
    return data.lower().translate(_ENDS).replace(_END, b" \xff ")


def _slices(data: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """(tokens, own tokens) of a text; long ones are cut at white space or a mark, and each slice looks ahead."""
    at, before = 0, []
    while len(data) - at > size:
        found = _BREAK.search(data, at + size)
        if found is None:
            break
        tokens = _tokens(data[at : found.start()])
        at = found.start()
        if len(tokens) < LONGEST:  # too few to look ahead into
            before += tokens
            continue
        if before:
            yield before + tokens[: LONGEST - 1], len(before)
        before = tokens
    tokens = _tokens(data[at:])
    if before:
        yield before + tokens[: LONGEST - 1], len(before)
    if tokens:
        yield tokens, len(tokens)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            if text.is_valid:
                yield lang.as_py(), text.as_py()


class _Words(dict):
    """Word -> its number here, for one language, with keys and counts by number. Ends of pieces and texts have key 0.

    Texts wait until they are as long as a chunk; only its distinct words are looked up one by one.
    """

    def __init__(self, lang: str, seed: int) -> None:
        super().__init__({_END: 0, _TEXT_END: 1})
        self.lang, self.seed, self.bytes = lang, xxhash.xxh3_64_intdigest(lang.encode(), seed), 0
        self.keys, self.counts = np.zeros(2, np.uint64), np.zeros(2, np.int64)
        self.texts: list[bytes] = []
        self.owned: list[int] = []
        self.waiting = 0

    def add(self, marked: bytes, own: int = -1) -> None:
        """A text, of whose words the first ``own`` are counted."""
        self.texts += [marked, _TEXT_END]
        self.owned.append(own)
        self.waiting += len(marked)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        numbers = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            numbers[new] = np.arange(len(self), len(self) + len(new))
            self.update(zip(fresh, numbers[new].tolist(), strict=True))
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, fresh, repeat(self.seed)), np.uint64, len(fresh))
            self.keys = np.append(self.keys, np.maximum(keys, np.uint64(1)))
            self.counts = np.append(self.counts, np.zeros(len(new), np.int64))
            self.bytes += sum(map(len, fresh))
        return numbers

    def coded(self) -> pa.RecordBatch:
        """(keys, own) of the texts that wait."""
        # Bytes that no UTF-8 text holds mark the ends; the functions used here look at white space alone.
        line = pa.array([b" ".join(self.texts).strip()], pa.large_binary()).view(pa.large_string())
        found = pc.ascii_split_whitespace(line).flatten().dictionary_encode()
        codes = found.indices.to_numpy()
        words = found.dictionary.view(pa.large_binary()).to_pylist()
        numbers = self._numbers(words)
        ends = np.flatnonzero(codes == words.index(_TEXT_END)) + 1
        starts = np.append(0, ends[:-1])
        owned = np.array(self.owned)
        owned = np.where(owned < 0, ends - starts - 1, owned)
        counted = np.bincount(codes, minlength=len(words))
        for i in np.flatnonzero(owned < ends - starts - 1):
            counted -= np.bincount(codes[starts[i] + owned[i] : ends[i]], minlength=len(words))
        self.counts[numbers] += counted
        keys = self.keys[numbers][codes]
        offsets = pa.py_buffer((np.append(0, ends) * 8).astype(np.int32))
        self.texts, self.owned, self.waiting = [], [], 0
        n = len(ends)
        return _rows([None] * n, [None] * n, [None] * n, [None] * n, pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(keys)]), owned)

    def counted(self) -> pa.RecordBatch:
        """(lang, word, key, n) of all words."""
        n = len(self) - 2
        words = pa.array(list(self)[2:], pa.binary()).cast(pa.string())
        return _rows([self.lang] * n, words, self.keys[2:].view(np.int64), self.counts[2:], [None] * n, [None] * n)

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.texts:
            yield self.coded()
        words = self.counted()
        for at in range(0, words.num_rows, SENT_WORDS):
            yield words.slice(at, SENT_WORDS)


_CODED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("own", pa.int32())])


def _rows(*columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _CODED, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=_CODED)


def coded(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(lang, word, key, n, keys, own): one reading of the texts gives both words and texts in keys.

    A row is either a word with its key and its count in some texts, or a text: the 64-bit ``keys`` of its words, 0 where a piece
    ends. Only phrases that begin at its first ``own`` places are counted there: a long text comes in slices, each followed by a
    few words of the next. Keys depend on the language.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Words] = {}
        waiting = 0
        for i, (lang, data) in enumerate(_texts(batches)):
            words = held.get(lang)
            if words is None:
                words = held[lang] = _Words(lang, seed)
            parts = [(_marked(data), -1)] if len(data) <= CHUNK_BYTES else ((b" ".join(t), own) for t, own in _slices(data))
            for marked, own in parts:
                words.add(marked, own)
                waiting += len(marked)
                if words.waiting >= CODED_BYTES:
                    waiting -= words.waiting
                    yield words.coded()
            if i % 100 == 0 or len(data) > CHUNK_BYTES:
                many = sum(map(len, held.values())) > HELD_WORDS or sum(w.bytes for w in held.values()) > HELD_BYTES
                if many or waiting > HELD_BYTES:
                    for words in held.values():
                        yield from words.rest()
                    held, waiting = {}, 0
        for words in held.values():
            yield from words.rest()

    return _narrow(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, key long, n long, keys binary, own int")


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send at most ``BATCH_BYTES`` to Python at a time."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def coded_words(docs: DataFrame, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(key, lang, word, n), the occurrences of every word, and (keys, own), the texts.

    No two words have the same key: where that happens, all keys are made again with another seed.
    """
    seed = 0
    while True:
        stored = materialise(coded(docs, lang_col, text_col, seed), "coded")
        counted = stored.filter("word IS NOT NULL").groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))
        words = materialise(counted, "words")
        if words.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return words, stored.filter("keys IS NOT NULL").select("keys", "own")
        seed += 1


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns keys and own as (word keys in a row, which places are own), about ``CHUNK_WORDS`` at a time."""
    for batch in batches:
        column = batch.column(0)
        wide = pa.types.is_large_binary(column.type)
        ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] // 8
        if not len(column) or ends[0] == ends[-1]:
            continue
        data = np.frombuffer(column.buffers()[2], np.uint64, ends[-1])
        owned = batch.column(1).to_numpy()
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK_WORDS, "right")) - 1)
            first = int(ends[at])
            keys = data[first : ends[to]]
            own = np.ones(len(keys), bool)
            for row in np.flatnonzero(owned[at:to] < np.diff(ends[at : to + 1]) - 1) + at:
                own[ends[row] - first + owned[row] : ends[row + 1] - first] = False
            yield keys, own
            at = to


def _start(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the words that pass a filter."""
    at = np.flatnonzero(keys)
    return _passing(at, keys[at], bits)


def _passing(at: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    passes = _in_filter(keys, bits)
    return at[passes], keys[passes]


def _longer(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the phrases that are one word longer: the key comes from those of the first and the last words."""
    both = np.flatnonzero(at[1:] == at[:-1] + 1)
    return at[both], _pair(keys[both], keys[both + 1])


def _combined(keys: np.ndarray) -> pa.RecordBatch:
    """(part, keys, counts): a row for each part of the keys, with its distinct ones and how often they occur."""
    distinct, counts = np.unique(keys, return_counts=True)
    bounds = np.searchsorted(distinct, np.arange(1, 1 << KEY_PART_BITS, dtype=np.uint64) << np.uint64(64 - KEY_PART_BITS))
    ends = np.concatenate([[0], bounds, [len(distinct)]])

    def cut(values: np.ndarray) -> pa.Array:
        offsets = (ends * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    columns = [pa.array(np.arange(len(ends) - 1, dtype=np.int32)), cut(distinct), cut(counts.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"]).filter(pa.array(np.diff(ends) > 0))


def _added(table: pa.Table, least: int) -> pa.Table:
    """(key): keys of one part that occur ``least`` times in all."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.int32)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    return pa.table({"key": keys[first][total >= least]})


def _in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set."""
    out = np.ones(len(keys), bool)
    for shift in _SHIFTS:
        at = keys >> np.uint64(shift) & np.uint64(8 * len(bits) - 1)
        out &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _narrow(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang = F.coalesce(col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), col(text_col).cast("binary").alias("text"))


def _filter_of(keys: DataFrame) -> Broadcast:
    """Two bits for each key, 8 MB whatever the number of keys, so a few others pass as well."""
    places = [F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(FILTER_BITS - 1)) + 1 for shift in _SHIFTS]  # bitmaps count from one
    parts = keys.select(F.explode(F.array(*places)).alias("place")).select(
        F.bitmap_bucket_number("place").alias("part"), F.bitmap_bit_position("place").alias("bit")
    )
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        piece = np.frombuffer(row["bits"], np.uint8)
        bits[(row["part"] - 1) * len(piece) : row["part"] * len(piece)] = piece
    return keys.sparkSession.sparkContext.broadcast(bits)


def _bounds(texts: DataFrame, size: int, filters: list[Broadcast], least: int) -> DataFrame:
    """(key): keys of phrases of ``size`` words that may occur ``least`` times.

    Apriori: only phrases count whose first and last size - 1 words may be frequent too. Phrases of one key are
    counted together, so sums bound the counts from above and no frequent phrase is lost.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for keys, own in _chunks(batches):
            at, found = _longer(*_start(keys, filters[0].value))
            for bits in filters[1:]:
                at, found = _longer(*_passing(at, found, bits.value))
            held.append(found[own[at]])
            count += len(held[-1])
            if count >= HELD_ROWS:
                yield _combined(np.concatenate(held))
                held, count = [], 0
        if count:
            yield _combined(np.concatenate(held))

    counted = texts.mapInArrow(run, "part int, keys binary, counts binary").groupBy("part")
    return counted.applyInArrow(lambda table: _added(table, least), "key long")


def _phrases(texts: DataFrame, filters: list[Broadcast], wanted: list[Broadcast]) -> DataFrame:
    """(words, key, parts): word keys of the phrases behind the keys that pass ``wanted``, by length from two words on.

    ``filters``, from one word on, are those that longer phrases rest on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for keys, own in _chunks(batches):
            at, found = _start(keys, filters[0].value)
            for size, (bits, chosen) in enumerate(zip(filters[1:], wanted, strict=True), 2):
                at, found = _passing(*_longer(at, found), bits.value)
                place, named = at[own[at]], found[own[at]]
                if chosen is not bits:
                    place, named = _passing(place, named, chosen.value)
                distinct, first = np.unique(named, return_index=True)
                fresh = np.array([k not in seen for k in distinct.tolist()], bool)
                if not fresh.any():
                    continue
                seen.update(distinct[fresh].tolist())
                parts = keys[place[first[fresh]][:, None] + np.arange(size)].view(np.int64)
                ends = pa.array(np.arange(len(parts) + 1, dtype=np.int32) * size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(parts), size, np.int32)), pa.array(distinct[fresh].view(np.int64)),
                     pa.ListArray.from_arrays(ends, pa.array(parts.ravel()))],
                    ["words", "key", "parts"],
                )
            if len(seen) > HELD_ROWS // 2:
                seen.clear()

    return materialise(texts.mapInArrow(run, "words int, key long, parts array<long>").dropDuplicates(["words", "key"]), "phrases")


def _candidates(texts: DataFrame, filters: list[Broadcast], safe: list[DataFrame]) -> DataFrame:
    """(words, key, parts): the phrases behind the keys in ``safe``, by length from two words on.

    A frequent phrase is likely to occur in any sixteenth of the texts, so these are named first; then all texts are searched
    for keys that are still without a phrase. A key names one phrase; that two frequent phrases share all 64 bits has a chance
    of one in ten million at a million phrases. What is counted afterwards are words, not keys of phrases.
    """
    keys = reduce(DataFrame.unionByName, safe)
    part = texts.filter(F.pmod(F.xxhash64("keys"), F.lit(NAMING_PARTS)) == 0)
    first = materialise(_phrases(part, filters, filters[1:]).join(keys, ["words", "key"], "left_semi"), "named")
    rest = materialise(keys.join(first, ["words", "key"], "left_anti"), "unnamed")
    wanted = [_filter_of(rest.filter(F.col("words") == size)) for size in range(2, len(filters) + 1)]
    second = _phrases(texts, filters, wanted).join(rest, ["words", "key"], "left_semi")
    for bits in wanted:
        bits.destroy()
    return first.unionByName(second.select(*first.columns))


class Trie:
    """A double-array trie of phrases: ``base[s] + digit`` is the child of state s, if ``check`` there is s.

    State numbers are places in the arrays. Words have codes from 1 on, and a word is a step for each digit of its code, to
    base 256, so that no node has more than 256 children. Every language has a root of its own.
    """

    def __init__(self, langs: list[str], phrases: list[list[bytes]]) -> None:
        """``phrases`` are lists of words; ``ends`` are their states."""
        self.codes = {w: i for i, w in enumerate(sorted({w for p in phrases for w in p}), 1)}
        self.roots = {lang: i for i, lang in enumerate(sorted(set(langs)))}
        longest = max(map(len, phrases))
        table = np.zeros((len(phrases), longest), np.int64)
        for k in range(longest):
            table[:, k] = [self.codes[p[k]] if k < len(p) else 0 for p in phrases]
        self._build(np.array([self.roots[lang] for lang in langs]), table, len(self.codes))

    @classmethod
    def of_keys(cls, parts: pa.ListArray) -> tuple[Trie, np.ndarray, np.ndarray]:
        """A trie of one root for lists of word keys; the keys, whose places are the codes less one; the codes of first words.

        All is done in arrays, as a list of Python's numbers takes many times the bytes.
        """
        trie = cls.__new__(cls)
        trie.codes, trie.roots = {}, {"": 0}
        sizes = pc.list_value_length(parts).to_numpy()
        known, codes = np.unique(parts.flatten().to_numpy(), return_inverse=True)
        table = np.zeros((len(sizes), sizes.max()), np.int32)
        table[np.arange(sizes.max()) < sizes[:, None]] = codes + 1
        trie._build(np.zeros(len(sizes), np.int64), table, len(known))
        return trie, known, np.unique(table[:, 0])

    def _build(self, node: np.ndarray, table: np.ndarray, words: int) -> None:
        """``node`` has the roots of the phrases and ``table`` the codes of their words, 0 behind the last."""
        self.shifts = [8 * i for i in reversed(range(-(-words.bit_length() // 8)))]
        # Nodes are numbered level by level, roots first; an edge is (parent, digit) and its child the next number.
        parents, codes, total = [], [], len(self.roots)
        for k in range(table.shape[1]):
            rows = np.flatnonzero(table[:, k])
            for shift in self.shifts:
                edge, child = np.unique(node[rows] * 512 + self._digit(table[rows, k], shift), return_inverse=True)
                parents.append((edge // 512).astype(np.int32))
                codes.append((edge % 512).astype(np.int32))
                node[rows] = total + child
                total += len(edge)
        self._place(np.concatenate(parents), np.concatenate(codes), node)

    @staticmethod
    def _digit(codes: np.ndarray, shift: int) -> np.ndarray:
        return (codes >> shift & 255) + 1

    def _place(self, parents: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> None:
        """Give every node with children a base, at random, so that no two children share a place; most children first.

        Edges come sorted by parent and digit, as levels follow one another.
        """
        roots, edges = len(self.roots), len(parents)
        begins = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        owners, sizes = parents[begins], np.diff(np.append(begins, edges))
        self.size, failed = roots + 4 * edges + 1024, 0
        used, base = np.zeros(self.size, bool), np.zeros(len(owners), np.int64)
        used[:roots] = True
        draw = np.random.default_rng(7)
        waiting = np.argsort(-sizes, kind="stable")
        # Ever larger groups of ever smaller nodes: a large node alone, then some thousand small ones in each round.
        while len(waiting):
            many = 1 if sizes[waiting[0]] > 64 else 64 if sizes[waiting[0]] > 8 else len(waiting)
            nodes = waiting[:many]
            count = sizes[nodes]
            edge = np.repeat(begins[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())
            highest = codes[begins[nodes] + count - 1]
            tried = draw.integers(roots, self.size - highest)
            places = np.repeat(tried, count) + codes[edge]
            of = np.repeat(np.arange(len(nodes)), count)
            # Of nodes that want one place in this round, the first may have it.
            _, first = np.unique(places, return_index=True)
            alone = np.zeros(len(places), bool)
            alone[first] = True
            fits = np.bincount(of, used[places] | ~alone, len(nodes)) == 0
            failed = 0 if fits.any() else failed + 1
            if failed == 1000:  # too full for a node of many children
                used, failed = np.concatenate([used, np.zeros(self.size, bool)]), 0
                self.size = len(used)
            used[places[fits[of]]] = True
            base[nodes[fits]] = tried[fits]
            waiting = np.concatenate([nodes[~fits], waiting[many:]])
        state = np.arange(roots + edges)
        bases = np.zeros(roots + edges, np.int64)
        bases[owners] = base
        state[roots:] = bases[parents] + codes
        self.base, self.check = np.zeros(self.size, np.int32), np.full(self.size, -1, np.int32)
        self.base[state[owners]] = base
        self.check[state[roots:]] = state[parents]
        self.ends = state[ends]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """States after one more word; -1 where there is none. Word code 0 and state -1 lead nowhere."""
        states = np.where(codes > 0, states, -1)
        for shift in self.shifts:
            alive = states >= 0
            at = self.base[states * alive] + self._digit(codes, shift)
            alive &= at < self.size
            at = at * alive
            states = np.where(alive & (self.check[at] == states), at, -1)
        return states


def _codes_of(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places among the sorted ``known``, from one on; 0 for other keys."""
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[place] == keys, place + 1, 0)


def _trie_counts(texts: DataFrame, tries: Broadcast, longest: int) -> DataFrame:
    """(words, key, n): how often the phrases of a trie occur. All places of a chunk go down the trie together, level by level.

    Only places whose word begins a phrase of this trie are looked at further. Every task sends one row for each phrase
    it met, so there are as many tasks as cores, however many texts there are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, first_codes, ends, words, phrases = tries.value
        total, held, count = np.zeros(len(ends), np.int64), [], 0

        def add() -> None:
            met, n = np.unique(np.concatenate(held), return_counts=True)
            place = np.minimum(np.searchsorted(ends, met), len(ends) - 1)
            whole = ends[place] == met
            total[place[whole]] += n[whole]

        firsts = known[first_codes - 1]
        begins = own.step(np.zeros(len(firsts), np.int64), first_codes)
        for keys, mine in _chunks(batches):
            signed = keys.view(np.int64)
            first = _codes_of(signed, firsts)
            at = np.flatnonzero(mine & (first > 0))
            states = begins[first[at] - 1]
            for level in range(1, longest):
                # A text ends with a break, so no place lies behind the chunk.
                following = _codes_of(signed[at + level], known)
                alive = np.flatnonzero(following)
                at, states = at[alive], own.step(states[alive], following[alive])
                alive = np.flatnonzero(states >= 0)
                at, states = at[alive], states[alive]
                held.append(states)
                count += len(states)
            if count >= HELD_ROWS:
                add()
                held, count = [], 0
        if count:
            add()
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(words[found]), pa.array(phrases[found]), pa.array(total[found])], ["words", "key", "n"])

    few = texts.coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    return materialise(few.mapInArrow(run, "words int, key long, n long").groupBy("words", "key").agg(F.sum("n").alias("n")), "states")


def _blocks(candidates: DataFrame, limit: int) -> list[Column]:
    """Conditions that deal the candidates out to blocks of ``limit`` or a little more.

    Phrases of one first word stay together as far as possible, so that a place of the texts concerns one block. A group of first
    words that is too large alone is divided by the phrases' keys.
    """
    group = F.pmod(F.xxhash64(F.col("parts")[0]), F.lit(FIRST_GROUPS))
    sizes = sorted(candidates.groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("n")).collect())
    blocks, begin, held = [], 0, 0
    for number, n in sizes:
        if held and held + n > limit:
            blocks.append(group.between(begin, number - 1))
            begin, held = number, 0
        if n > limit:
            parts = -(-n // limit)
            blocks += [(group == number) & (F.pmod(F.xxhash64("key"), F.lit(parts)) == i) for i in range(parts)]
            begin = number + 1
        else:
            held += n
    return [*blocks, group.between(begin, FIRST_GROUPS)] if held else blocks


def _counted(texts: DataFrame, candidates: DataFrame, longest: int, limit: int) -> list[DataFrame]:
    """(words, key, n) by blocks of candidates, each as large as one trie may be, and each stored.

    Of a block nothing stays on the driver once its phrases are counted.
    """
    context, out = texts.sparkSession.sparkContext, []
    for block in _blocks(candidates, limit):
        rows = candidates.filter(block).select("words", "key", "parts").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        # Keys depend on the language, so one root serves all.
        trie, known, firsts = Trie.of_keys(rows["parts"].combine_chunks())
        order = np.argsort(trie.ends)
        words, keys = (rows[c].to_numpy()[order] for c in ("words", "key"))
        tries = context.broadcast((trie, known, firsts, trie.ends[order], words, keys))
        del rows, trie, known, order, words, keys
        out.append(_trie_counts(texts, tries, longest))
        tries.destroy()
    return out


def _spelled(counted: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, words, phrase, n) of phrases that are given by the keys of their words."""
    parts = counted.select("words", F.col("key").alias("id"), "n", F.posexplode("parts").alias("place", "key"))
    found = parts.join(words.select("key", "lang", "word"), "key")
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ")
    return found.groupBy("id", "words", "n").agg(F.first("lang").alias("lang"), spelled.alias("phrase")).select("lang", "words", "phrase", "n")


def _sub_phrases(first: int, last: int) -> Column:
    """Contiguous parts of the words in ``w`` that have ``first`` to ``last`` words, shorter than the whole."""
    sizes = F.sequence(F.lit(first), F.least(F.lit(last), F.size("w") - 1))
    return F.flatten(F.transform(sizes, lambda k: F.transform(
        F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")
    )))


def _digits(value: Column) -> Column:
    """A count as an exact number that products cannot overflow."""
    return value.cast("decimal(19,0)")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP,
    trie_phrases: int = TRIE_PHRASES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of every language.

    A-Z become lower case; pieces end at ``. , ; : ! ?`` and line ends, and consist of words between blanks and tabs. n counts
    all words of the language, a the phrase. Cut after k words, its parts have l and r occurrences, and the score is
    floor(2000000 a / (l + r)); the lowest cut counts, the first of several. Phrases of two to ``longest`` words with a >= ``least``
    are candidates; one that lies inside a longer candidate goes if that has 80 % of its occurrences. Order: score, then a, descending,
    then the phrase by its bytes.

    The texts are read once: words are counted, and each text is stored as 64-bit keys of its words, no two words having the
    same key. Rounds over these: for each length, bounds of the counts, by keys of phrases, decide which phrases may be frequent
    (their parts must be); candidates go into double-array tries, at most ``trie_phrases`` each, which are broadcast and count all
    occurrences exactly, word by word. Filters of frequent keys have a fixed size.

    - Missing language: und. Missing and empty texts have no words. Repeated rows count as often as they occur.
    - An empty table gives an empty result. Other columns are ignored. Long texts are taken up in slices.
    """
    with _small_batches(docs.sparkSession):
        words, texts = coded_words(docs, lang_col, text_col)
        frequent = words.filter(F.col("n") >= least)
        filters, safe = [_filter_of(frequent)], []
        for size in range(2, longest + 1):
            safe.append(materialise(_bounds(texts, size, filters, least).withColumn("words", F.lit(size)), "bounds"))
            filters.append(_filter_of(safe[-1]))
        candidates = materialise(_candidates(texts, filters, safe), "candidates")
        counts = frequent.select("lang", F.lit(1).alias("words"), F.col("word").alias("phrase"), "n")
        counted = _counted(texts, candidates, longest, trie_phrases)
        if counted:
            enough = reduce(DataFrame.unionByName, counted).filter(F.col("n") >= least)
            counts = counts.unionByName(_spelled(candidates.join(enough, ["words", "key"]), frequent))
        counts = materialise(counts, "counts")
        for bits in filters:
            bits.destroy()
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    return _ranked(_independent(counts), counts, totals, top)


def _independent(counts: DataFrame) -> DataFrame:
    """Candidates without those that a longer one holds."""
    longer = counts.filter("words > 2").withColumn("w", F.split("phrase", " "))
    inside = longer.select("lang", F.explode(F.array_distinct(_sub_phrases(2, LONGEST))).alias("phrase"), F.col("n").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = _digits(F.col("longer")) * 100 >= _digits(F.col("n")) * HELD_SHARE
    joined = counts.filter("words > 1").join(most, ["lang", "phrase"], "left")
    return joined.filter(F.col("longer").isNull() | ~held).drop("longer")


def _ranked(chosen: DataFrame, counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    cuts = chosen.withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("rest"),
    )
    firsts = counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rests = counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    exact = F.expr(f"cast(a as decimal(19,0)) * cast({SCALE} as decimal(10,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"]).withColumn("score", exact)
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut")).select(
        "lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score"
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First within parts of a language, so that no task ranks all its phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part")
    best = lowest.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    final = best.filter(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    joined = final.filter(F.col("rank") <= top).join(totals, "lang")
    return joined.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

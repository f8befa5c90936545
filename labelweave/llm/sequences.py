"""Token ids as Arrow files of equal-length sequences with masks, and random access to them."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, stage_path
from .common import col
from .segments import HELD_BYTES, byte_characters, load_tokenizer, packed, read_text, slices

LENGTH = 1024
#: Sequences in a record batch: 1 MB of ids. All batches of a file but the last have as many.
BATCH_ROWS = 256
#: Documents in a record batch of the index.
INDEX_ROWS = 8192
#: Ids that a reading task puts into one batch.
READ_IDS = 1 << 20
#: Bytes of text in a file, and how many files at most (beyond that they grow).
FILE_BYTES = 16 << 20
MAX_FILES = 50_000
# A pre-token of this vocabulary never holds white space, which it drops.
_CUT = re.compile(r" ")
# Letters that Unicode normalisation leaves alone among themselves, then marks: two pre-tokens, whatever the case of the letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?()\[\]{}\"|*#<>/$%-]*)")


class WordIds(dict):
    """Word -> the bytes of its ids, by a tokenizer whose pre-tokens hold no white space.

    Words are encoded when first met. Above ``limit`` bytes a new generation begins; words met again move into it.
    """

    def __init__(self, definition: str, width: int, limit: int = HELD_BYTES) -> None:
        super().__init__()
        self.tokenizer, self.width, self.limit = load_tokenizer(definition, plain=False), width, limit
        self.tokenize = self.tokenizer.model.tokenize
        # A byte-level vocabulary writes these letters, two bytes in UTF-8, as two characters.
        self.letters = str.maketrans({chr(c): "".join(byte_characters()[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)})
        self.older: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            plain = _PLAIN.fullmatch(word)
            if plain is None:
                found = packed(self.tokenizer.encode(word, add_special_tokens=False).ids, self.width)
            else:
                letters, marks = plain[1].lower(), plain[2]
                if letters == word:
                    written = word if word.isascii() else word.translate(self.letters)
                    found = packed([t.id for t in self.tokenize(written)], self.width)
                else:
                    found = self[letters] + self[marks] if marks else self[letters]
        self[word] = found
        self.held += len(word) + len(found) + 200
        return found

    def ids(self, text: str) -> list[bytes]:
        """The ids of a text, in parts."""
        if self.held > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        return [b"".join(map(self.__getitem__, s.replace("\n", " ").split(" "))) for s in slices(text, _CUT)]


@lru_cache(maxsize=2)
def word_encoder(definition: str, width: int) -> WordIds:
    """One encoder for all tasks of a Python worker."""
    return WordIds(definition, width)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there; plain paths and file: addresses are local."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


class _Writer:
    """Two Arrow files: sequences (ids, mask), and where each document begins among the ids."""

    def __init__(self, folder: str, name: str, length: int, width: int, id_type: pa.DataType) -> None:
        system, root = _place(folder)
        system.create_dir(root, recursive=True)
        self.name, self.length, self.cells, self.width = name, length, length * BATCH_ROWS, np.dtype(f"u{width}")
        ids = pa.from_numpy_dtype(self.width)
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.streams = [system.open_output_stream(f"{root}/{name}.{kind}.arrow") for kind in ("ids", "docs")]
        self.files = [pa.ipc.new_file(s, t) for s, t in zip(self.streams, (self.schema, self.index_schema), strict=True)]
        self.parts: list[np.ndarray] = []
        self.held = self.total = self.docs = self.index_batches = 0
        self.index: list[tuple] = []

    def add(self, doc_id: pa.Scalar, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.docs += 1
        if self.held >= self.cells:
            self._flush(self.held // self.cells * self.cells)
        if len(self.index) >= INDEX_ROWS:
            self._flush_index()

    def _flush(self, count: int) -> None:
        """Write ``count`` ids, padded to whole sequences, as record batches."""
        ids = np.concatenate(self.parts)
        self.parts, self.held = [ids[count:]], len(ids) - count
        for at in range(0, count, self.cells):
            part = ids[at : min(at + self.cells, count)]
            padded = np.zeros(-(-len(part) // self.length) * self.length, self.width)
            padded[: len(part)] = part
            mask = np.arange(len(padded)) < len(part)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(c), self.length) for c in (padded, mask)]
            self.files[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _flush_index(self) -> None:
        doc_ids, starts, sizes = zip(*self.index, strict=True)
        kind = self.index_schema.field(0).type
        columns = [pa.array([i.as_py() for i in doc_ids], kind), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
        self.files[1].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.index_schema))
        self.index = []
        self.index_batches += 1

    def close(self) -> tuple[str, int, int, int]:
        """(name, ids, documents, batches of the index)."""
        if self.held:
            self._flush(self.held)
        if self.index:
            self._flush_index()
        for file in (*self.files, *self.streams):
            file.close()
        return self.name, self.total, self.docs, self.index_batches


class SequenceFile:
    """Random access to the sequences of one file.

    A local file is mapped into memory: sequences (NumPy) and masks (Arrow, a bit per id) are views of the file, nothing is copied.
    The footer gives the place of every record batch, and all batches but the last hold the same number of sequences.
    """

    def __init__(self, folder: str, name: str) -> None:
        system, root = _place(folder)
        local = isinstance(system, fs.LocalFileSystem)
        self.sources = [
            pa.memory_map(f"{root}/{name}.{kind}.arrow") if local else system.open_input_file(f"{root}/{name}.{kind}.arrow")
            for kind in ("ids", "docs")
        ]
        self.file, self.index = map(pa.ipc.open_file, self.sources)
        self.length = self.file.schema.field("ids").type.list_size
        self._held: tuple[int, np.ndarray, pa.BooleanArray] | None = None

    def _batch(self, number: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if self._held is None or self._held[0] != number:
            batch = self.file.get_batch(number)
            self._held = number, batch.column(0).flatten().to_numpy().reshape(-1, self.length), batch.column(1).flatten()
        return self._held[1], self._held[2]

    def __len__(self) -> int:
        batches = self.file.num_record_batches
        return (batches - 1) * BATCH_ROWS + len(self._batch(batches - 1)[0]) if batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence ``i``; the mask is false where a last sequence is padded."""
        ids, mask = self._batch(i // BATCH_ROWS)
        return ids[i % BATCH_ROWS], mask.slice(i % BATCH_ROWS * self.length, self.length)

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on; a view where they lie in one record batch."""
        cells, parts = self.length * BATCH_ROWS, []
        while count > 0:
            batch, at = divmod(start, cells)
            part = self._batch(batch)[0].reshape(-1)[at : at + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])

    def documents(self, batch: int) -> pa.RecordBatch:
        """(doc_id, start, n_tokens) of one batch of the index."""
        return self.index.get_batch(batch)

    def close(self) -> None:
        self._held = None
        for source in self.sources:
            source.close()


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) in ranges of ascending ids; equal ids by a digest of their text, and spread over ranges."""
    spread = F.monotonically_increasing_id()
    keyed = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("digest"), spread.alias("spread")
    )
    keys = [F.col("doc_id").asc_nulls_last(), F.col("digest"), F.col("spread")]
    size = docs.agg(F.sum(F.octet_length(col(text_col)))).first()[0] or 0
    ranges = min(MAX_FILES, max(1, -(-size // FILE_BYTES)))
    return keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write_sequences(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, length: int = LENGTH,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the ids of all texts, in ascending id order, as Arrow files; the result lists them.

    Result: (part, folder, name, n_tokens, n_docs, index_batches), one row per file, in the order of ``part``. Each file
    holds a range of documents as one run of ids, ``end_id`` after each document, cut into sequences of ``length``;
    only its last sequence is padded, where the mask is false. Ids have 16 bits where
    the vocabulary allows, else 32. An index file beside it says where documents begin.

    Texts are encoded by the tokenizers library, without added special tokens. The vocabulary's pre-tokens hold no
    white space, so words are encoded apart and each distinct one once; this gives the ids of the whole text.

    - Missing and empty texts have the end id alone. A missing doc_id comes after all others; rows of one id
      are in the order of their texts' digests. One entry per row, repeated ones too.
    - An empty table writes no file. Other columns are ignored. Long texts are encoded in slices.
    - A task that is run again writes a file of another name; only files in the result count.

    ``folder`` must be shared by all executors (default: a stage folder). ``vocabulary`` is a file of the driver's
    machine; it is sent along.
    """
    spark = docs.sparkSession
    folder = folder or stage_path(spark, "sequences")
    definition = spark.sparkContext.broadcast(read_text(vocabulary))
    size = max(load_tokenizer(definition.value, plain=False).get_vocab_size(), end_id + 1)
    width = 2 if size <= 1 << 16 else 4
    end = packed([end_id], width)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(definition.value, width)
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            writer = writer or _Writer(folder, f"part-{part:06d}-{uuid.uuid4().hex}", length, width, batch.schema.field(0).type)
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                writer.add(doc_id, np.frombuffer(b"".join([*encoder.ids(text.as_py()), end]), f"u{width}"))
        if writer and writer.docs:
            row = (part, folder, *writer.close())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["part", "folder", "name", "n_tokens", "n_docs", "index_batches"])

    manifest = _ordered(docs, id_col, text_col).mapInArrow(
        run, "part long, folder string, name string, n_tokens long, n_docs long, index_batches long"
    )
    return materialise(manifest, "manifest")


def _splits(manifest: DataFrame) -> DataFrame:
    """(folder, name, base, batch): one row per batch of a file's index; ``base`` ids lie in the files before it."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    batches = F.explode(F.sequence(F.lit(0), F.col("index_batches") - 1))
    rows = based.select("folder", "name", "base", batches.alias("batch"))
    return rows.repartition(max(1, manifest.agg(F.sum("index_batches")).first()[0] or 0), "name", "batch")


def _read(manifest: DataFrame, schema: str, columns, names: list[str]) -> DataFrame:
    """``columns(file, base, index rows)`` gives the columns after the index rows' own; the index comes first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                file = SequenceFile(split["folder"], split["name"])
                index = file.documents(split["batch"])
                sizes = index.column(2).to_numpy()
                groups = (np.cumsum(sizes) - sizes) // READ_IDS
                cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(sizes)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = index.slice(a, b - a)
                    starts = pa.array(part.column(1).to_numpy() + split["base"])
                    yield pa.RecordBatch.from_arrays([part.column(0), starts, part.column(2), columns(file, part)], names)
                file.close()

    return _splits(manifest).mapInArrow(run, schema)


def _id_type(docs: DataFrame, id_col: str) -> str:
    return docs.select(col(id_col)).schema[0].dataType.simpleString()


def read_documents(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents in the files of ``write_sequences``.

    ``start`` counts the ids of all documents before. Files are read by batches of their index, each reaching
    only the sequences it needs. An empty manifest gives an empty table.
    """

    def ids(file: SequenceFile, part: pa.RecordBatch) -> pa.Array:
        starts, sizes = part.column(1).to_numpy(), part.column(2).to_numpy()
        values = file.ids(int(starts[0]), int(sizes.sum()))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))

    return _read(manifest, f"doc_id {id_type}, start long, n_tokens long, ids array<int>", ids, ["doc_id", "start", "n_tokens", "ids"])


def read_checksums(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): as ``read_documents``, with the CRC-32 of the ids as little-endian 32-bit integers."""

    def checksums(file: SequenceFile, part: pa.RecordBatch) -> pa.Array:
        spans = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
        return pa.array([zlib.crc32(file.ids(start, size).astype("<u4")) for start, size in spans], pa.int64())

    return _read(
        manifest, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long", checksums, ["doc_id", "start", "n_tokens", "ids_crc32"]
    )


def token_file_checksums(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as sequences, read the files back, and give start, size and checksum of every document."""
    return read_checksums(write_sequences(docs, vocabulary, end_id, id_col=id_col, text_col=text_col), _id_type(docs, id_col))


def sequence_files(spark: SparkSession, manifest: DataFrame) -> Iterator[SequenceFile]:
    """The files one by one, in order, for a reader outside Spark such as a training loop."""
    for row in manifest.orderBy("part").select("folder", "name").toLocalIterator():
        yield SequenceFile(row["folder"], row["name"])

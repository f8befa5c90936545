"""SentencePiece encoding that keeps the byte span of every piece, and decoding."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import col

SPACE = "▁".encode()
SEGMENT_CHARS = 1 << 15
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_BYTE = re.compile(r"<0x[0-9A-F]{2}>")


class CharMap:
    """The compiled character map of a model: a double-array trie from source prefixes to replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest entry that ``data`` has at ``at``."""
        units, best, node = self.units, None, 0
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        return best[0], self.strings[best[1] : self.strings.index(0, best[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)


class Normaliser:
    """Normalised bytes of a text and, for each of them, the source byte it stems from."""

    def __init__(self, spec) -> None:
        self.chars = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.trim, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The array has one entry more than the bytes: the end of the source."""
        if self.chars is None and not self.trim:
            return self._spaces_only(data)
        return self._mapped(data)

    def _spaces_only(self, data: bytes) -> tuple[bytes, np.ndarray]:
        source = np.frombuffer(data, np.uint8)
        if not self.escape:
            out = (b" " if self.prefix and data else b"") + data
            return out, np.concatenate([np.zeros(len(out) - len(data), np.int64), np.arange(len(data) + 1)])
        counts = np.where(source == 0x20, len(SPACE), 1)
        align = np.repeat(np.arange(len(data)), counts)
        text = data.replace(b" ", SPACE)
        if self.prefix and data:
            text, align = SPACE + text, np.concatenate([np.zeros(len(SPACE), np.int64), align])
        return text, np.append(align, len(data))

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source length and replacement of what stands at ``at``: an entry of the map, or one character."""
        found = self.chars.longest_prefix(data, at) if self.chars else None
        if found:
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, data[at : at + size]

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        space = SPACE if self.escape else b" "
        parts = []
        at = 0
        while at < len(data):
            size, text = self._prefix(data, at)
            parts.append((at, text))
            at += size
        if self.trim:
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)
        out, align = bytearray(), []
        if self.prefix and parts:
            out += space
            align += [parts[0][0]] * len(space)
        after_space = self.trim
        for start, text in parts:
            if self.trim and after_space:
                text = text.lstrip(b" ")
            if text:
                after_space = self.trim and text.endswith(b" ")
                text = text.replace(b" ", space)
                out += text
                align += [start] * len(text)
        if self.trim:
            while out.endswith(space):
                del out[-len(space) :], align[-len(space) :]
        end = len(data)
        if self.trim and parts:
            end = align and min(len(data), align[-1] + self._prefix(data, align[-1])[0]) or 0
        return bytes(out), np.array([*align, end], np.int64)


class Pieces:
    """A model with what is needed to place its pieces in the source text."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            blob = file.read()
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        self.normalise = Normaliser(model.normalizer_spec)
        self.names = [str(i) for i in range(len(model.pieces))]
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.unknown = model.trainer_spec.unk_id
        self.lengths = np.array(
            [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64
        )
        spec = model.normalizer_spec
        # A space between two words may be cut at if no piece holds one inside, and the dummy prefix can stand for it.
        self.divisible = (
            spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
            and not any("▁" in p.piece.lstrip("▁") for p in model.pieces)
            and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
            and model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
            and not model.trainer_spec.treat_whitespace_as_suffix
        )

    def segments(self, text: str, size: int = SEGMENT_CHARS) -> Iterator[tuple[int, str]]:
        """(bytes before, text): pieces of a long text that can be encoded one by one."""
        if not self.divisible or len(text) <= size:
            yield 0, text
            return
        at = before = 0
        while at < len(text):
            found = _CUT.search(text, at + size)
            end = found.start() if found else len(text)
            part = text[at:end]
            yield before, part
            before += len(part.encode()) + 1
            at = end + 1

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the first and last source byte offset of each, exactly as the library encodes the whole text."""
        ids, begins, ends = [], [], []
        for before, part in self.segments(text):
            own = self.processor.encode(part)
            data, align = self.normalise(part.encode())
            if self.unknown in own:
                lengths = np.array([1 if _BYTE.fullmatch(p) else len(p.encode()) for p in self.processor.encode(part, out_type=str)])
            else:
                lengths = self.lengths[np.array(own, np.int64)]
            stops = np.cumsum(lengths)
            if len(own) and stops[-1] != len(data):
                raise ValueError("the pieces do not cover the normalised text")
            ids += own
            begins.append(align[stops - lengths] + before)
            ends.append(align[stops] + before)
        if len(begins) > 1:
            for i in range(1, len(begins)):  # the space that was cut at belongs to the piece after it
                begins[i][0] -= 1
        return ids, np.concatenate(begins), np.concatenate(ends)

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)

    def joined(self, ids: list[int]) -> str:
        return ",".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


def _strings(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends): the ids of each whole text, and the byte span of each id in it.

    Ids are those of the sentencepiece library, without begin and end marks and without sampling. Spans are byte
    offsets into the UTF-8 text; pieces of one normalised unit share its span's start.

    - Missing and empty texts have no ids.
    - Long texts are encoded in parts where no piece can cross, so memory stays in proportion to the text.
    - One row per input row, repeated ones too; an empty table gives an empty result; other columns are ignored.

    ``model`` is a path that every executor can open.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for i, text in enumerate(_strings(batch.column(1))):
                ids, begins, ends = pieces.encode(text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i : i + 1], pa.array([len(ids)], pa.int64()), _list(ids, pa.int32()),
                     _list(begins, pa.int64()), _list(ends, pa.int64())],
                    ["doc_id", "n_tokens", "ids", "begins", "ends"],
                )

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    return _narrow(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids array<int>, begins array<long>, ends array<long>"
    )


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): decoded ids. Missing ids decode to an empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            texts = [pieces.decode(value.as_py() or []) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.select(col(id_col)).schema[0].dataType.simpleString()
    return _narrow(encoded, id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256, source_bytes) of encoding, then decoding each text.

    The same work as ``encode`` and ``decode`` in one pass, for checks that need no token lists. Spans are
    digested as little-endian 64-bit begins, then ends. Cases as for ``encode``.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "source_bytes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            rows = []
            for text in _strings(batch.column(1)):
                ids, begins, ends = pieces.encode(text)
                spans = hashlib.sha256(begins.astype("<i8").tobytes() + ends.astype("<i8").tobytes())
                rows.append((len(ids), _sha(pieces.joined(ids)), _sha(pieces.decode(ids)), spans.hexdigest(), len(text.encode())))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names
            )

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    return _narrow(docs, id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, source_bytes long"
    )


def _narrow(docs: DataFrame, id_col: str, value_col: str) -> DataFrame:
    return docs.select(col(id_col).alias("doc_id"), col(value_col).alias("value"))


def _list(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()

"""Token counts that follow edits: segment trees over pre-token blocks."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

# Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 256
# A pre-token always begins at a single space between two other characters.
_CUT = re.compile(r"(?<=\S) (?=\S)")
EDIT = "struct<start:int,stop:int,text:string>"


class TokenCounter:
    """Counts the tokens of a text by a byte-level vocabulary."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


@lru_cache(maxsize=4)
def load(path: str) -> TokenCounter:
    return TokenCounter(path)


def cut(text: str, size: int = LEAF_CHARS) -> list[str]:
    """Blocks of at least ``size`` characters, cut only where a pre-token begins in any context."""
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + size) if len(text) - at > size else None
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class CountTree:
    """A text as blocks under a tree whose nodes hold the characters and the tokens below them."""

    def __init__(self, text: str, counter: TokenCounter, size: int = LEAF_CHARS) -> None:
        self.text, self.counter, self.size = text, counter, size
        blocks = cut(text, size) or [""]
        self.width = 1 << (len(blocks) - 1).bit_length()
        self.chars = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        for i, block in enumerate(blocks):
            self.chars[self.width + i], self.tokens[self.width + i] = len(block), counter.count(block)
        for i in range(self.width - 1, 0, -1):
            self._sum(i)
        self.encoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _set(self, leaf: int, block: str) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = len(block), self.counter.count(block) if block else 0
        while node > 1:
            node //= 2
            self._sum(node)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at``, or the last that has any, and where it begins."""
        node, begin = 1, 0
        at = min(at, max(self.chars[1] - 1, 0))
        while node < self.width:
            node *= 2
            if at - begin >= self.chars[node]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def _valid(self, text: str, at: int) -> bool:
        return at in (0, len(text)) or _CUT.match(text, at) is not None

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters [start, stop) by ``new``; bounds beyond the text are moved into it.

        Blocks that the edit touches are encoded anew, with their neighbours as long as the outer bounds are not
        places where a pre-token begins in the new text; sums change on the paths above them only.
        """
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        first, begin = self._leaf(start)
        last, last_begin = self._leaf(max(stop - 1, start))
        end = last_begin + self.chars[self.width + last]
        text = self.text[:start] + new + self.text[stop:]
        shift = len(text) - len(self.text)
        while not self._valid(text, begin) or (begin == start and begin and first):
            first, begin = self._leaf(begin - 1)
        while not self._valid(text, end + shift) or (end == stop and end < len(self.text)):
            last, last_begin = self._leaf(end)
            end = last_begin + self.chars[self.width + last]
        region = text[begin : end + shift]
        blocks = cut(region, self.size)
        slots = last - first + 1
        if len(blocks) > slots:
            blocks[slots - 1 :] = ["".join(blocks[slots - 1 :])]
        self.text = text
        self.encoded += len(region)
        for i in range(slots):
            self._set(first + i, blocks[i] if i < len(blocks) else "")


def count_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, chars, tokens): each text's tree, as two arrays with the root at 1 and children of i at 2i, 2i+1.

    Missing text counts as empty. One row per input row; an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in batches:
            trees = [CountTree(v.as_py() or "", counter) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.total for t in trees], pa.int64()),
                 pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int64()))],
                ["doc_id", "n_tokens", "chars", "tokens"],
            )

    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, chars array<int>, tokens array<long>")


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the column edits: the edits (id, order, start, stop, text) of each document, in their order."""
    listed = edits.groupBy(col(id_col)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("order", "start", "stop", "text"))), lambda e: F.struct(e.start, e.stop, e.text)).alias("edits")
    )
    return docs.join(listed, id_col, "left")


def edited_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits"
) -> DataFrame:
    """(doc_id, n_tokens, n_after, n_chars, n_chars_after, n_encoded): token counts before and after a document's edits.

    ``edits_col`` lists (start, stop, text): replace these characters. Each edit refers to the text the ones before it
    left. ``n_encoded`` is how many characters had to be encoded again.

    - Missing text counts as empty, missing edits as none; missing bounds are 0, a missing replacement is empty.
    - One row per input row, repeated ones too; an empty table gives an empty result; other columns are ignored.
    """
    names = ["doc_id", "n_tokens", "n_after", "n_chars", "n_chars_after", "n_encoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(vocabulary)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                tree = CountTree(text, counter)
                before = tree.total
                for edit in edits.as_py() or []:
                    if edit is not None:
                        tree.edit(edit["start"] or 0, edit["stop"] or 0, edit["text"] or "")
                rows.append((before, tree.total, len(text), len(tree.text), tree.encoded))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names)

    narrow = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(edits_col).cast(f"array<{EDIT}>").alias("edits"))
    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))

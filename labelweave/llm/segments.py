"""What the encoders of whole texts share: long texts in slices, vocabularies sent along with the job."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

#: Bytes of segments and ids that a task keeps.
HELD_BYTES = 96 << 20
#: Characters of a long text that are cut into segments at a time.
SLICE_CHARS = 1 << 19


def slices(text: str, cut: re.Pattern, size: int = SLICE_CHARS) -> Iterator[str]:
    """Parts of at least ``size`` characters that begin where ``cut`` matches; a short text is one part."""
    at = 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def packed(ids: Iterable[int], width: int) -> bytes:
    """Ids as integers of ``width`` bytes, as this machine orders them."""
    return array({2: "H", 4: "I"}[width], ids).tobytes()


def load_tokenizer(definition: str, plain: bool):
    """A tokenizer from its JSON text. ``plain``: strings of special tokens inside texts are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.encode_special_tokens = plain
    return tokenizer


def read_text(path: str) -> str:
    """A vocabulary file of the driver's machine, to be sent along with the job."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one above 255."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

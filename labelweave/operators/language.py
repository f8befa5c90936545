"""Language identification by character trigrams, trained on a labelled table.

A trigram is a whole number, three code points of 21 bits. Texts are read in Arrow batches; all trigrams of a batch are looked up
at once in a packed profile whose size was measured. No row per character or trigram occurrence is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_spaces
from ..session import materialise, ship
from .lookups import lookup_join

#: Bytes of a packed profile up to which it is sent to every task.
MAX_PROFILE_BYTES = 64 << 20
#: Characters whose trigrams are handled together.
CHUNK_CHARS = 1 << 20


def normalised(text: Column) -> Column:
    """Lower-cased, white space collapsed; the trigrams of a text are those of this form."""
    return F.lower(collapse_spaces(text))


@dataclass
class LanguageProfile:
    """Per trigram the languages it was seen in, as (language, logarithm of count + 1), stored once.

    ``grams``: (gram, seen). ``languages`` has (language, log prior, log of the smoothed total) for each, in the order of
    their codes.
    """

    grams: DataFrame
    languages: list[tuple[str, float, float]]


def _trigrams(texts: Iterable[str | None], size: int = CHUNK_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigrams, index of the text of each), some texts or a part of one at a time."""
    parts, rows, held = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text or "") - 2, 0), size):
            part = text[at : at + size + 2]
            parts.append(part)
            rows.append(i)
            held += len(part)
            if held >= size:
                yield _of_parts(parts, rows)
                parts, rows, held = [], [], 0
    if parts:
        yield _of_parts(parts, rows)


def _of_parts(parts: list[str], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
    grams = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    lengths = np.array([len(p) for p in parts])
    place = np.repeat(np.arange(len(parts)), lengths)
    inside = place[:-2] == place[2:]
    return grams[inside], np.array(rows)[place[:-2][inside]]


def _counts(df: DataFrame, key_col: str, text_col: str) -> DataFrame:
    """(key, gram, n): trigrams of the texts of each key, counted in tasks over parts of the table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            code = keys.indices.to_numpy()
            for grams, rows in _trigrams(v.as_py() for v in batch.column(1)):
                of = code[rows]
                order = np.lexsort((grams, of))
                g, c = grams[order], of[order]
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [keys.dictionary.take(pa.array(c[first])), pa.array(g[first]), pa.array(np.diff(np.append(first, len(g))))],
                    ["key", "gram", "n"],
                )

    ship(df.sparkSession)
    narrow = df.select(F.col(key_col).alias("key"), normalised(F.col(text_col)).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, gram long, n long")


def fit_profile(df: DataFrame, text_col: str, language_col: str, min_count: int = 1) -> LanguageProfile:
    """Add-one smoothed trigram probabilities of any number of languages.

    ``min_count`` above 1 leaves out trigrams seen less often in all languages together.
    """
    labelled = df.filter(F.col(language_col).isNotNull()).select(F.col(language_col).alias("language"), F.col(text_col).alias("text"))
    seen = _counts(labelled, "language", "text").groupBy("gram", F.col("key").alias("language")).agg(F.sum("n").alias("n"))
    grams = seen.groupBy("gram").agg(F.collect_list(F.struct("language", "n")).alias("seen"), F.sum("n").alias("n"))
    kept = materialise(grams.filter(F.col("n") >= min_count).select("gram", "seen"), "grams")
    totals = kept.select(F.explode("seen").alias("s")).groupBy("s.language").agg(F.sum("s.n").alias("total"))
    sizes = labelled.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.join(totals, "language", "left").orderBy("language").collect()
    vocabulary = kept.count()
    documents = sum(r["n"] for r in rows)
    languages = [
        (r["language"], math.log(r["n"] / documents), math.log(max((r["total"] or 0) + vocabulary, 1))) for r in rows
    ]
    logs = F.transform("seen", lambda s: F.struct(s.language.alias("language"), F.log(s.n + 1).alias("log")))
    return LanguageProfile(kept.select("gram", logs.alias("logs")), languages)


class _Packed:
    """A profile as sorted trigrams and a matrix of their logarithms, one column per language."""

    def __init__(self, grams: np.ndarray, entries: np.ndarray, columns: np.ndarray, logs: np.ndarray, languages) -> None:
        """``entries``, ``columns`` and ``logs``: place of the trigram, of the language, and the value."""
        order = np.argsort(grams)
        self.grams = grams[order]
        self.logs = np.zeros((len(grams), len(languages)))
        place = np.empty(len(grams), np.int64)
        place[order] = np.arange(len(grams))
        self.logs[place[entries], columns] = logs
        self.codes = [code for code, _, _ in languages]
        self.priors, self.totals = (np.array([entry[i] for entry in languages]) for i in (1, 2))

    def best(self, texts: list[str | None]) -> list[str | None]:
        sums, known = np.zeros((len(texts), len(self.codes))), np.zeros(len(texts))
        for grams, rows in _trigrams(texts):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            hit = np.flatnonzero(self.grams[at] == grams)
            at, rows = at[hit], rows[hit]
            known += np.bincount(rows, minlength=len(texts))
            for k in range(len(self.codes)):
                sums[:, k] += np.bincount(rows, self.logs[at, k], len(texts))
        score = sums - known[:, None] * self.totals + self.priors
        return [self.codes[k] if n else None for k, n in zip(score.argmax(axis=1).tolist(), known.tolist(), strict=True)]


def _packed(profile: LanguageProfile) -> _Packed:
    """The profile on the driver, whose caller has measured it."""
    table = profile.grams.toArrow().combine_chunks()
    column = {code: k for k, (code, _, _) in enumerate(profile.languages)}
    lists = table["logs"].combine_chunks()
    offsets = lists.offsets.to_numpy()
    flat = lists.values
    entries = np.repeat(np.arange(len(lists)), np.diff(offsets))
    columns = np.array([column[c] for c in flat.field("language").to_pylist()], np.int64)
    grams = table["gram"].to_numpy()
    return _Packed(grams, entries, columns, flat.field("log").to_numpy(), profile.languages)


def identify(
    df: DataFrame, id_col: str, text_col: str, profile: LanguageProfile, out: str = "language", max_bytes: int = MAX_PROFILE_BYTES
) -> DataFrame:
    """(id, language): most probable language, ties by code; NULL where no trigram is known.

    A profile of at most ``max_bytes`` goes to all tasks and texts are scored row by row. Of a larger one, the distinct trigrams of
    each text, counted in the task, meet it by a shuffle.
    """
    size = profile.grams.count()
    if not profile.languages or not size:
        return df.select(id_col, F.lit(None).cast("string").alias(out))
    if size * 8 * (1 + len(profile.languages)) > max_bytes:
        return _identify_shuffled(df, id_col, text_col, profile, out)
    packed = df.sparkSession.sparkContext.broadcast(_packed(profile))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = packed.value.best(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [id_col, out])

    ship(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, normalised(F.col(text_col)).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, `{out}` string")


def _identify_shuffled(df: DataFrame, id_col: str, text_col: str, profile: LanguageProfile, out: str) -> DataFrame:
    known = lookup_join(_counts(df, id_col, text_col), profile.grams, ["gram"], "inner", spread=["key"])
    # The entry without a language counts how many trigrams of a text are known at all.
    every = F.array(F.struct(F.lit(None).cast("string").alias("language"), F.lit(1.0).alias("log")))
    entries = known.select("key", "n", F.explode(F.concat("logs", every)).alias("s"))
    parts = entries.groupBy("key", "s.language").agg(F.sum(F.col("n") * F.col("s.log")).alias("sum"))
    sums = parts.groupBy("key").agg(
        F.max(F.when(F.col("language").isNull(), F.col("sum"))).alias("_known"),
        F.map_from_entries(F.collect_list(F.when(F.col("language").isNotNull(), F.struct("language", "sum")))).alias("_sums"),
    )
    scored = [
        F.struct(
            (F.coalesce(F.try_element_at("_sums", F.lit(code)), F.lit(0.0)) - F.col("_known") * total + prior).alias("score"),
            F.lit(-rank).alias("rank"), F.lit(code).alias("code"),
        )
        for rank, (code, prior, total) in enumerate(profile.languages)
    ]
    best = sums.select(F.col("key").alias(id_col), F.array_max(F.array(*scored)).code.alias(out))
    return df.select(id_col).join(best, id_col, "left")


def keep_language(df: DataFrame, id_col: str, text_col: str, profile: LanguageProfile, target: str = "en") -> DataFrame:
    """Rows whose identified language is the target; undecidable rows are dropped."""
    hits = identify(df, id_col, text_col, profile, "_language").filter(F.col("_language") == target)
    return df.join(hits.select(id_col), id_col, "left_semi")

"""Seeded text augmentation: synonym replacement, insertion, swap and deletion.

All random choices are hashes of (seed, row id, operation, position), so the outcome does not
depend on partitioning or retries. Token arrays are only ever sorted or filtered, never searched
per element, so a text of many thousand words costs n log n. A thesaurus of few words is looked up inside
each row, without a shuffle; all variants of a row are then made by one call. For a larger one texts are spread by row id
once; token rows, their grouping and the final join all reuse that partitioning.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Mapping, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.text import default_stop_words, has_tokens, normalise_synonym, tokens
from .lookups import lookup_join

MIN_TOKENS = 4
#: Words and bytes of a thesaurus up to which it is a constant of the plan.
LITERAL_LIMIT, LITERAL_BYTES = 1000, 1 << 20
INSERT_TRIES = 10
METHODS = ("synonym", "insert", "swap", "delete")

# Executors need not have this package installed: its task functions travel with the job.
register_pickle_by_value(sys.modules[__name__])


def synonym_table(pairs: DataFrame) -> DataFrame:
    """(word, synonyms): normalised, sorted, without the word itself, from (word, synonym) rows."""
    cleaned = pairs.select("word", normalise_synonym(F.col("synonym")).alias("synonym"))
    kept = cleaned.filter(F.col("synonym") != F.col("word"))
    return kept.groupBy("word").agg(F.sort_array(F.collect_set("synonym")).alias("synonyms"))


def budget(alpha: float, words: Column) -> Column:
    """Number of changes for a text: a share of its words, at least one."""
    return F.greatest(F.lit(1), F.floor(F.lit(float(alpha)) * words).cast("int"))


def _pick(options: Column, u: Column) -> Column:
    return F.element_at(options, (F.floor(u * F.size(options)) + 1).cast("int"))


def _joined(parts: Column) -> Column:
    """Texts of an array of (…, w) structs in struct order."""
    return F.array_join(F.transform(F.sort_array(parts), lambda s: s["w"]), " ")


def _of_each(kind: str, make: Callable[[list[str], str | None], object]) -> Callable[[Column, Column], Column]:
    """A column of ``kind``: ``make`` of each row's words and key; missing where the words are."""

    @F.pandas_udf(kind)
    def run(words: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else make(list(w), k) for w, k in zip(words, keys, strict=True)], dtype=object)

    return run


def _draw(start: str, place: object) -> float:
    return int.from_bytes(md5(f"{start}{place}".encode()).digest()[:4]) / 4294967296.0


def _start(seed: int, key: str | None, operation: str) -> str:
    return ":".join(str(p) for p in (seed, key, operation) if p is not None) + ":"


def _draws(seed: int, key: str | None, operation: str, places: Iterable[object]) -> np.ndarray:
    """``functions.hashing.uniform`` of (seed, key, operation, place) for each place."""
    start = _start(seed, key, operation)
    return np.frombuffer(b"".join([md5(f"{start}{p}".encode()).digest()[:4] for p in places]), ">u4") / 4294967296.0


def _changes(alpha: float, words: int) -> int:
    """``budget`` of a text of so many words."""
    return max(1, math.floor(alpha * words))


def _swapped(words: Sequence[str], seed: int, key: str | None, alpha: float) -> str:
    """In each round pairs of distinct positions, in hash order, trade places, until ``budget`` pairs have."""
    count = len(words)
    if count < 2:
        return " ".join(words)
    left, k, now = _changes(alpha, count), 0, np.array(words, dtype=object)
    while left > 0:
        order = np.argsort(_draws(seed, key, "swap" if k == 0 else f"swap{k}", range(count)), kind="stable")
        pairs = min(left, count // 2)
        odd, even = order[: 2 * pairs : 2], order[1 : 2 * pairs : 2]
        now[odd], now[even] = now[even], now[odd]
        left, k = left - pairs, k + 1
    return " ".join(now)


def _shortened(words: Sequence[str], seed: int, key: str | None, share: float) -> str:
    if len(words) == 1:
        return words[0]
    kept = _draws(seed, key, "delete", range(len(words))) > share
    return " ".join([w for w, stays in zip(words, kept.tolist(), strict=True) if stays])


def swap_rounds(alpha: float) -> int:
    """How often every position must be open to a swap, so that any text gets all its swaps."""
    return max(-(-max(1, math.floor(alpha * n)) // (n // 2)) for n in range(2, 64))


def swap_words(df: DataFrame, id_col: str, seed: int, alpha: float, words: str = "_words") -> DataFrame:
    """Add ``_swap``: as many swaps of two words as ``budget`` gives.

    A round swaps up to half of the positions with the others; what is left goes to another round on its result, with
    positions drawn anew. Each round is one sort of a text's words.
    """

    return df.withColumn("_swap", _of_each("string", lambda w, key: _swapped(w, seed, key, alpha))(F.col(words), F.col(id_col).cast("string")))


def delete_words(df: DataFrame, id_col: str, seed: int, share: float, words: str = "_words") -> DataFrame:
    """Add ``_delete``: every word stays with probability 1 - share; an only word always stays."""

    return df.withColumn("_delete", _of_each("string", lambda w, key: _shortened(w, seed, key, share))(F.col(words), F.col(id_col).cast("string")))


def _synonym_hits(df: DataFrame, id_col: str, synonyms: DataFrame, stop_words: Sequence[str], seed: int) -> DataFrame:
    """Per row: its words that have synonyms, with hash rank, chosen synonyms and positions."""
    key = F.col(id_col)
    # The outer form keeps the optimizer from tokenising a second time for a not-empty filter.
    occurrences = df.select(id_col, F.posexplode_outer("_words").alias("pos", "word"))
    found = lookup_join(occurrences, synonyms, ["word"], "inner", spread=[id_col, "pos"])
    rank = F.when(~F.col("word").isin(*stop_words), uniform(seed, key, "replace", F.col("pos")))
    found = found.select(
        id_col, "pos", "word", rank.alias("u"),
        _pick(F.col("synonyms"), uniform(seed, key, "replacement", F.col("pos"))).alias("replacement"),
        _pick(F.col("synonyms"), uniform(seed, key, "insertion", F.col("pos"))).alias("insertion"),
    )
    per_word = found.groupBy(id_col, "word").agg(
        F.min("u").alias("first_u"),
        F.min_by("replacement", "u").alias("replacement"),
        F.collect_list("u").alias("us"),
        F.collect_list("pos").alias("positions"),
        F.collect_list(F.struct(F.col("pos"), F.lit(0).alias("rank"), F.col("insertion").alias("w"))).alias("inserts"),
    )
    return per_word.groupBy(id_col).agg(
        F.collect_list(F.struct("first_u", "replacement", "positions")).alias("_hits"),
        F.sort_array(F.flatten(F.collect_list("us"))).alias("_us"),
        F.flatten(F.collect_list("inserts")).alias("_inserts"),
    )


def _small_table(synonyms: DataFrame) -> dict[str, list[str]]:
    """The thesaurus, if it has few enough words and bytes for a constant of the plan; else nothing."""
    size = F.sum(F.octet_length(F.concat_ws(" ", F.col("word"), F.col("synonyms"))))
    few = synonyms.limit(LITERAL_LIMIT + 1).select("word", "synonyms")
    words, total = few.agg(F.count(F.lit(1)), size).first()
    return {r["word"]: r["synonyms"] for r in few.collect()} if words <= LITERAL_LIMIT and (total or 0) <= LITERAL_BYTES else {}


def _replaced(words: Sequence[str], table: Mapping[str, Sequence[str]], stops: frozenset, seed: int, key: str | None, alpha: float) -> str:
    """The text as ``replace_words`` makes it."""
    places = [i for i, w in enumerate(words) if w in table and w not in stops]
    if not places:
        return " ".join(words)
    hits = sorted(zip(_draws(seed, key, "replace", places).tolist(), places, strict=True))
    limit = hits[min(_changes(alpha, len(words)), len(hits)) - 1][0]
    firsts: dict[str, int] = {}
    for u, place in hits:
        if u <= limit:
            firsts.setdefault(words[place], place)
    draws = _draws(seed, key, "replacement", firsts.values()).tolist()
    new = {w: table[w][math.floor(u * len(table[w]))] for w, u in zip(firsts, draws, strict=True)}
    return " ".join([new.get(w, w) for w in words])


def _lengthened(words: Sequence[str], table: Mapping[str, Sequence[str]], seed: int, key: str | None, alpha: float) -> str:
    """The text as ``insert_words`` makes it."""
    known, count = [w in table for w in words], len(words)
    if not any(known):
        return " ".join(words)
    before: dict[int, list[str]] = {}
    tries, options_start, places = (_start(seed, key, operation) for operation in ("try", "insertion", "place"))
    for i in range(1, _changes(alpha, count) + 1):
        for j in range(1, INSERT_TRIES + 1):
            place = math.floor(_draw(tries, f"{i}:{j}") * count)
            if known[place]:
                options = table[words[place]]
                added = options[math.floor(_draw(options_start, place) * len(options))]
                before.setdefault(math.floor(_draw(places, i) * (count + 1)), []).append(added)
                break
    return " ".join([part for i in range(count + 1) for part in (*before.get(i, ()), *words[i : i + 1])])


def _first_per_position(parts: Column) -> Column:
    """Keep the first struct of every position of an array sorted by position."""
    behind = F.concat(F.array(F.lit(-1)), F.transform(parts, lambda s: s["pos"]))
    pairs = F.arrays_zip(parts.alias("s"), F.slice(behind, 1, F.size(parts)).alias("before"))
    return F.transform(F.filter(pairs, lambda z: z["s"]["pos"] != z["before"]), lambda z: z["s"])


def replace_words(df: DataFrame, alpha: float) -> DataFrame:
    """Add ``_synonym``: the first words in hash order are replaced everywhere in the text.

    Every occurrence of a word with synonyms counts towards the number of replacements.
    """
    limit = F.element_at(F.col("_us"), F.least(budget(alpha, F.size("_words")), F.size("_us")))
    chosen = df.withColumn("_limit", F.when(F.size("_us") > 0, limit))
    plain = F.transform("_words", lambda w, i: F.struct(i.alias("pos"), F.lit(1).alias("rank"), w.alias("w")))
    new = F.flatten(
        F.transform(
            F.filter("_hits", lambda h: h["first_u"] <= F.col("_limit")),
            lambda h: F.transform(
                h["positions"], lambda p: F.struct(p.alias("pos"), F.lit(0).alias("rank"), h["replacement"].alias("w"))
            ),
        )
    )
    merged = chosen.withColumn("_merged", F.sort_array(F.concat(plain, F.coalesce(new, F.slice(plain, 1, 0)))))
    return merged.withColumn("_synonym", _joined(_first_per_position(F.col("_merged")))).drop("_merged", "_limit")


def _options(df: DataFrame) -> DataFrame:
    """Add ``_options``, a synonym for each word that has any, from ``_inserts``."""
    nothing = F.transform("_words", lambda w, i: F.struct(i.alias("pos"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("w")))
    options = _first_per_position(F.col("_options_sorted"))
    laid = df.withColumn("_options_sorted", F.sort_array(F.concat(nothing, F.coalesce("_inserts", F.slice(nothing, 1, 0)))))
    return laid.withColumn("_options", F.transform(options, lambda s: s["w"])).drop("_options_sorted")


def insert_words(df: DataFrame, id_col: str, seed: int, alpha: float) -> DataFrame:
    """Add ``_insert``: synonyms of random words of the text at random places.

    Every insertion tries up to ten random words for one that has synonyms (``_options``).
    """
    # The array is referenced more than once on purpose: it must stay a computed column, or it
    # would be built again for every try.
    key, size = F.col(id_col), F.size("_options")
    tries = F.transform(
        F.sequence(F.lit(1), budget(alpha, size)),
        lambda i: F.struct(
            (F.floor(uniform(seed, key, "place", i) * (size + 1)) * 2).cast("int").alias("pos"),
            i.alias("rank"),
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.lit(INSERT_TRIES)),
                    lambda j: F.element_at(
                        F.col("_options"), (F.floor(uniform(seed, key, "try", i, j) * size) + 1).cast("int")
                    ),
                ),
                lambda w: w.isNotNull(),
            ).alias("w"),
        ),
    )
    added = F.transform(
        F.filter(tries, lambda s: F.size(s["w"]) > 0),
        lambda s: F.struct(s["pos"].alias("pos"), s["rank"].alias("rank"), s["w"][0].alias("w")),
    )
    plain = F.transform("_words", lambda w, i: F.struct((i * 2 + 1).alias("pos"), F.lit(0).alias("rank"), w.alias("w")))
    return df.withColumn("_insert", _joined(F.concat(plain, added))).drop("_options")


def augment(
    df: DataFrame,
    id_col: str,
    text_col: str,
    synonyms: DataFrame,
    seed: int = 42,
    alpha_replace: float = 0.1,
    alpha_insert: float = 0.1,
    alpha_swap: float = 0.1,
    share_delete: float = 0.1,
    stop_words: Sequence[str] | None = None,
) -> DataFrame:
    """(id, variant, method, text): four variants per text, or a short text itself as its only one.

    ``synonyms`` comes from ``synonym_table``.
    """
    stops = tuple(stop_words) if stop_words is not None else default_stop_words()
    many = has_tokens(F.col(text_col), MIN_TOKENS)
    short = df.filter(~many).select(
        id_col, F.lit(1).alias("variant"), F.lit("copy").alias("method"), F.col(text_col).alias("text")
    )
    long = df.filter(many).select(id_col, text_col)
    words = tokens(F.col(text_col)).alias("_words")
    table = _small_table(synonyms)
    if table:
        unchanged = frozenset(stops)

        def made(of: Sequence[str], key: str | None) -> list[str]:
            return [
                _replaced(of, table, unchanged, seed, key, alpha_replace), _lengthened(of, table, seed, key, alpha_insert),
                _swapped(of, seed, key, alpha_swap), _shortened(of, seed, key, share_delete),
            ]

        texts = long.select(id_col, _of_each("array<string>", made)(words, F.col(id_col).cast("string")).alias("_made"))
    else:
        long = long.repartition(id_col).select(id_col, words)
        rows = long.join(_synonym_hits(long, id_col, synonyms, stops, seed), id_col, "left")
        rows = insert_words(_options(replace_words(rows, alpha_replace)), id_col, seed, alpha_insert)
        rows = delete_words(swap_words(rows, id_col, seed, alpha_swap), id_col, seed, share_delete)
        texts = rows.select(id_col, F.array(*[f"_{m}" for m in METHODS]).alias("_made"))
    # The outer form keeps the optimizer from making the texts a second time for a not-empty filter.
    placed = texts.select(id_col, F.posexplode_outer("_made").alias("variant", "text"))
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), F.col("variant") + 1)
    variants = placed.select(id_col, (F.col("variant") + 1).alias("variant"), method.alias("method"), "text")
    return variants.unionByName(short)

"""Full cleaning with dictionaries of any size.

All steps after soft cleaning work on one white-space token at a time. So each distinct token is cleaned once, through joins
with the dictionaries. Texts are put together from the table of cleaned tokens, whose frequent ones every task holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import CONTRACTIONS, LEMMA_EXCEPTIONS
from ..functions.text import (
    contraction_parts,
    default_stop_words,
    put_contraction,
    remove_punctuation,
    soft_clean,
    squeeze_repeats,
    suffix_lemma,
    tokens,
)
from ..session import materialise
from .lookups import lookup_join, shared_ids
from .tables import require_columns

#: Cleaned tokens that a task holds, the most frequent ones, and the bytes of one; all others meet the texts by a join.
HELD_TOKENS, TOKEN_BYTES = 1 << 18, 64

# Executors need not have this package installed: its task functions travel with the job.
register_pickle_by_value(sys.modules[__name__])


def _in_order(parts: Column) -> Column:
    """The texts of an array of (place, …, w) structs, joined by blanks, empty ones left out."""
    return F.array_join(F.filter(F.transform(F.sort_array(parts), lambda p: p["w"]), lambda w: w != ""), " ")


def _pairs(spark, table: dict[str, str], names: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(table.items()), f"{names[0]} string, {names[1]} string")


def clean_tokens(words: DataFrame, contractions: DataFrame, lemmas: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(word, cleaned) for a table of distinct tokens: full cleaning of each, an empty text where nothing is left.

    ``contractions``: (short, long); ``lemmas``: (word, lemma), whose entries come before the suffix rules;
    ``stop_words``: (word). Keys are unique and in lower case.
    """
    head, core, tail = contraction_parts(F.col("word"))
    split = words.select("word", head.alias("_head"), core.alias("_core"), tail.alias("_tail"), F.lower(core).alias("short"))
    expanded = lookup_join(split, contractions.select("short", "long"), ["short"], spread=["word"])
    whole = put_contraction(F.col("word"), F.col("_head"), F.col("_core"), F.col("_tail"), F.col("long"))
    plain = remove_punctuation(F.lower(squeeze_repeats(whole)))
    parts = expanded.select(F.col("word").alias("token"), F.posexplode_outer(tokens(plain)).alias("_place", "word"))
    found = lookup_join(parts, lemmas.select("word", "lemma"), ["word"], spread=["token"])
    base = F.coalesce("lemma", suffix_lemma(F.col("word")))
    bases = found.select("token", "_place", F.posexplode_outer(tokens(base)).alias("_inner", "word"))
    marked = lookup_join(bases, stop_words.select("word", F.lit(True).alias("_stop")), ["word"], spread=["token"])
    kept = F.when(F.col("_stop").isNull(), F.coalesce("word", F.lit(""))).otherwise(F.lit(""))
    gathered = marked.groupBy("token").agg(F.collect_list(F.struct("_place", "_inner", kept.alias("w"))).alias("parts"))
    return gathered.select(F.col("token").alias("word"), _in_order(F.col("parts")).alias("cleaned"))


def _split(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(bounds of the rows, tokens) of softly cleaned texts, whose tokens lie between single blanks; an empty text is one empty token."""
    found = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
    return found.offsets.to_numpy(), found.flatten()


def token_counts(soft: DataFrame, soft_col: str) -> DataFrame:
    """(word, n): the tokens of softly cleaned texts and how often they occur."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _split(batch.column(0))[1].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])

    counted = soft.select(soft_col).mapInArrow(run, "word string, n long")
    return counted.filter("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def _lists(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _pieces(texts: pa.Array, words: pa.Array, cleaned: pa.Array) -> pa.Array:
    """(gaps, rare): the tokens that are not in ``words``, and the cleaned texts before, between and after them."""
    bounds, found = _split(texts)
    at = pc.index_in(found, words)
    rare = np.flatnonzero(at.is_null())
    new = cleaned.take(at)
    kept = pc.fill_null(pc.not_equal(new, ""), False)
    before = np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False)))
    cuts = np.sort(np.concatenate([bounds, rare + 1]), kind="stable")
    gaps = pc.binary_join(_lists(before[cuts], new.filter(kept)), pa.scalar(" ", pa.large_string())).cast(pa.string())
    held = np.searchsorted(rare, bounds)
    lists = [_lists(held + np.arange(len(bounds)), gaps), _lists(held, found.take(pa.array(rare)).cast(pa.string()))]
    return pa.StructArray.from_arrays(lists, ["gaps", "rare"])


def _held(table: DataFrame) -> tuple[Broadcast, int]:
    """(word, cleaned) of the most frequent short tokens of (word, n, cleaned) as arrays of the tasks, and their number."""
    short = table.filter((F.octet_length("word") <= TOKEN_BYTES) & (F.octet_length("cleaned") <= TOKEN_BYTES))
    level = F.floor(F.log2("n") * 4)
    total, least = 0, None
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > HELD_TOKENS:
            break
        least = row["level"]
    chosen = short.filter(level >= least if least is not None else F.lit(False)).select("word", "cleaned").toArrow()
    words, cleaned = ([""] + chosen[name].to_pylist() for name in ("word", "cleaned"))
    arrays = pa.array(words, pa.large_string()), pa.array(cleaned, pa.large_string())
    return table.sparkSession.sparkContext.broadcast(arrays), chosen.num_rows


def _from_held(soft: DataFrame, id_col: str, table: DataFrame) -> DataFrame:
    """``soft`` with ``_text``, for unique ids: only tokens that no task holds become rows of their own."""
    held, number = _held(table)
    pieces = F.arrow_udf(lambda texts: _pieces(texts, *held.value), "gaps array<string>, rare array<string>")
    cut = soft.withColumn("_pieces", pieces("_soft"))
    if number == table.count():
        return cut.withColumn("_text", F.col("_pieces.gaps")[0]).drop("_pieces", "_soft")
    cut = materialise(cut.drop("_soft"), "pieces")
    rare = cut.filter(F.col(id_col).isNotNull()).select(id_col, F.posexplode("_pieces.rare").alias("_place", "word"))
    joined = lookup_join(rare, table.select("word", "cleaned"), ["word"], "inner", spread=[id_col, "_place"])
    parts = F.sort_array(F.collect_list(F.struct("_place", "cleaned")))
    found = joined.groupBy(id_col).agg(F.transform(parts, lambda p: p["cleaned"]).alias("_found"))
    filled = F.concat(F.coalesce("_found", F.array().cast("array<string>")), F.array(F.lit("")))
    whole = F.flatten(F.zip_with("_pieces.gaps", filled, lambda gap, word: F.array(gap, word)))
    text = F.array_join(F.filter(whole, lambda w: w != ""), " ")
    return cut.join(found, id_col, "left").withColumn("_text", text).drop("_pieces", "_found")


def _from_rows(soft: DataFrame, id_col: str, table: DataFrame) -> DataFrame:
    """``soft`` with ``_text``, put together from a row for each token; rows that share an id share their tokens."""
    places = soft.select(id_col, F.posexplode(tokens(F.col("_soft"))).alias("_place", "word"))
    known = table.filter(F.col("cleaned") != "").select("word", "cleaned")
    joined = lookup_join(places, known, ["word"], "inner", spread=[id_col, "_place"])
    rebuilt = joined.groupBy(id_col).agg(_in_order(F.collect_list(F.struct("_place", F.col("cleaned").alias("w")))).alias("_text"))
    return soft.join(rebuilt, id_col, "left").drop("_soft")


def clean_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    out: str = "full_text",
    contractions: DataFrame | None = None,
    lemmas: DataFrame | None = None,
    stop_words: DataFrame | Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with the fully cleaned text, as ``functions.text.full_clean`` makes it, for dictionaries of any size.

    Tables that are not given are those of ``full_clean``. Ids are unique (rows that share one get the tokens
    of all, rows without one an empty text); a missing text stays missing. The ``HELD_TOKENS`` most frequent tokens at most are
    broadcast and replaced inside each text, so only rarer ones are shuffled.
    """
    require_columns(df, [id_col, text_col])
    spark = df.sparkSession
    contractions = contractions if contractions is not None else _pairs(spark, CONTRACTIONS, ("short", "long"))
    lemmas = lemmas if lemmas is not None else _pairs(spark, LEMMA_EXCEPTIONS, ("word", "lemma"))
    if not isinstance(stop_words, DataFrame):
        words = default_stop_words() if stop_words is None else stop_words
        stop_words = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    soft = F.replace(soft_clean(F.col(text_col)), F.lit("’"), F.lit("'"))
    stored = materialise(df.withColumn("_soft", soft), "soft")
    words = materialise(token_counts(stored, "_soft"), "words")
    cleaned = clean_tokens(words.select("word"), contractions, lemmas, stop_words)
    table = materialise(words.join(cleaned, "word"), "cleaned")
    shared = shared_ids(stored, id_col)
    if shared.isEmpty():
        rebuilt = _from_held(stored, id_col, table)
    else:
        single = _from_held(lookup_join(stored, shared, [id_col], "left_anti"), id_col, table)
        rebuilt = single.unionByName(_from_rows(lookup_join(stored, shared, [id_col], "left_semi"), id_col, table))
    own = F.when(F.col(id_col).isNotNull(), F.coalesce("_text", F.lit(""))).otherwise(F.lit(""))
    text = F.when(F.col(text_col).isNotNull(), own)
    ordered = rebuilt.select(id_col, *[c for c in df.columns if c != id_col], "_text")
    return ordered.withColumn(out, text).drop("_text")

"""Fixed-length integer rows for sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_text, tokens
from .lookups import lookup_join

PAD, UNKNOWN = 0, 1
FIRST_WORD_ID = 2


def vocabulary(df: DataFrame, text_col: str, size: int = 50_000) -> DataFrame:
    """(word, word_id): the ``size`` most frequent lower-case words, ids from 2 on, ties by word.

    The numbering window runs over the vocabulary only.
    """
    words = df.select(F.explode_outer(tokens(F.lower(as_text(F.col(text_col), True)))).alias("word"))
    counts = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    order = Window.orderBy(F.desc("n"), "word")
    return top.select("word", (F.row_number().over(order) + FIRST_WORD_ID - 1).cast("int").alias("word_id"))


def fixed_length_ids(
    df: DataFrame, id_cols: list[str], text_col: str, words: DataFrame, length: int = 128,
    label_col: str | None = None,
) -> DataFrame:
    """Word ids cut and padded to ``length`` with their mask: (ids…, input_ids, attention_mask[, labels]).

    Missing texts are read as the word ``nan``. Ids, not texts, are shuffled.
    """
    taken = F.slice(tokens(F.lower(as_text(F.col(text_col), True))), 1, length)
    exploded = df.select(*id_cols, F.posexplode_outer(taken).alias("_pos", "word"))
    coded = lookup_join(exploded, words, ["word"], spread=[*id_cols, "_pos"])
    pair = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("word_id", F.lit(UNKNOWN)).alias("id")))
    lists = coded.groupBy(*id_cols).agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    ids = F.transform("_pairs", lambda p: p["id"])
    fill = F.lit(length) - F.size("_pairs")
    out = lists.select(
        *id_cols,
        F.concat(ids, F.array_repeat(F.lit(PAD), fill)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("_pairs")), F.array_repeat(F.lit(0), fill)).alias("attention_mask"),
    )
    if label_col is None:
        return out
    return out.join(df.select(*id_cols, F.col(label_col).cast("int").alias("labels")), id_cols)

"""Joins of a large table with a lookup table whose size is measured, not assumed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOT_SPACE, SPACE
from ..session import materialise

#: Bytes of a lookup, as text, up to which it is broadcast.
MAX_BROADCAST_BYTES = 32 << 20
#: Words and characters of a replacement table up to which it is a constant of the plan.
LITERAL_LIMIT, LITERAL_BYTES = 1000, 1 << 20
#: Rows of the hottest key that one task may get in a shuffle join.
ROWS_PER_SALT = 1_000_000


def pin(small: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """``small``, stored once unless it is local already, and whether all its rows stay below ``max_bytes``."""
    if small._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() != "LocalRelation":
        small = materialise(small, "lookup")
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))
    return small, (small.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: Sequence[str] = (),
    max_bytes: int = MAX_BROADCAST_BYTES,
    salts: int | None = None,
) -> DataFrame:
    """Join on null-safe keys; broadcast a lookup of proven bytes, else a salted shuffle join.

    ``spread`` names columns of ``left`` that tell the rows of one hot key apart; rows of the
    key are spread over ``salts`` tasks by their hash and each lookup row is copied to all of
    them. Without ``salts``, the rows of the hottest key decide.
    """
    stored, small = pin(lookup, max_bytes)
    if small:
        return keyed_join(left, F.broadcast(stored), on, how)
    if salts is None and spread:
        hottest = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        salts = -(-hottest // ROWS_PER_SALT)
    if not spread or salts <= 1:
        return keyed_join(left, stored, on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed_join(salted, copies, [*on, "_salt"], how).drop("_salt")


def keyed_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys of ``left`` stay."""
    keys = {c: f"_right_{c}" for c in on}
    right = right.withColumnsRenamed(keys)
    condition = None
    for name, renamed in keys.items():
        match = F.col(name).eqNullSafe(F.col(renamed))
        condition = match if condition is None else condition & match
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*keys.values())


def replace_tokens(
    df: DataFrame, id_col: str, text_col: str, table: DataFrame, out: str | None = None
) -> DataFrame:
    """Replace white-space tokens through a (word, replacement) table of any size.

    Token-level form of the literal lookups of ``functions.text``; white space is kept. A table of few words is looked up
    inside each row, so that no token is shuffled; only rows that share an id are put together from their tokens.
    """
    changes = _few_words(table)
    if changes is None:
        return _replaced_by_join(df, id_col, text_col, table, out)
    target = out or text_col
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{SPACE}+|{NOT_SPACE}+"), F.lit(0))
    new = F.array_join(F.transform(pieces, lambda w: _changed(w, changes)), "")
    shared = shared_ids(df, id_col)
    # A row without an id finds no tokens of its own.
    text = F.when(F.col(id_col).isNotNull() | F.col(text_col).isNull(), new).otherwise(F.lit(""))
    if shared.isEmpty():
        return df.withColumn(target, text)
    single = lookup_join(df, shared, [id_col], "left_anti").withColumn(target, text)
    several = lookup_join(df, shared, [id_col], "left_semi")
    return single.unionByName(_replaced_by_join(several, id_col, text_col, table, out))


def shared_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Ids of more than one row, stored; a missing id is none."""
    counted = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    return materialise(counted.filter("_n > 1").select(id_col), "shared_ids")


def _few_words(table: DataFrame) -> dict[str, str] | None:
    """The table, if it has few words, each once; else nothing."""
    rows = table.select("word", "replacement").limit(LITERAL_LIMIT + 1).collect()
    found = {r["word"]: r["replacement"] for r in rows}
    size = sum(len(p or "") for pair in found.items() for p in pair)
    return found if len(rows) <= LITERAL_LIMIT and len(found) == len(rows) and size <= LITERAL_BYTES else None


def _changed(word: Column, changes: Mapping[str, str | None]) -> Column:
    known = {w: new for w, new in changes.items() if w is not None and new is not None}
    if not known:
        return word
    entries = F.create_map(*[F.lit(part) for pair in known.items() for part in pair])
    return F.when(word.isin(*known), F.element_at(entries, word)).otherwise(word)


def _replaced_by_join(df: DataFrame, id_col: str, text_col: str, table: DataFrame, out: str | None) -> DataFrame:
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"{SPACE}+|{NOT_SPACE}+"), F.lit(0))
    exploded = df.select(id_col, F.posexplode_outer(pieces).alias("_pos", "word")).filter(F.col("word").isNotNull())
    looked_up = lookup_join(exploded, table.select("word", "replacement"), ["word"], spread=[id_col, "_pos"])
    rebuilt = looked_up.groupBy(id_col).agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("replacement", "word").alias("w")))),
                lambda s: s.w,
            ),
            "",
        ).alias("_text")
    )
    target = out or text_col
    text = F.when(F.col(text_col).isNull(), F.lit(None)).otherwise(F.coalesce("_text", F.lit("")))
    return df.join(rebuilt, id_col, "left").withColumn(target, text).drop("_text")


def last_value_per_key(df: DataFrame, key: str, value: str, order_col: str) -> DataFrame:
    """(key, value) table in which the last row of each key wins."""
    return df.groupBy(key).agg(F.max_by(value, order_col).alias(value))


def add_looked_up(df: DataFrame, table: DataFrame, key: str, default: Column | None = None,
                  value: str = "value", spread: Sequence[str] = ()) -> DataFrame:
    """Add ``value`` from a (key, value) table, with a default for unknown keys."""
    out = lookup_join(df, table.select(key, value), [key], spread=spread)
    return out.withColumn(value, F.coalesce(F.col(value), default)) if default is not None else out

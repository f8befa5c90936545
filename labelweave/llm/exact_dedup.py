"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import col, fresh, with_row_ids, without_rows

# Runs of white space that are not one plain space already.
IRREGULAR_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
LEAST_CHARS = 512
MOST_CHARS = 4096


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; missing text as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), IRREGULAR_SPACES, " ")


def chunks(text: Column, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> Column:
    """Pieces that end at the first sentence end after ``least`` characters, or after ``most``.

    Cut points depend on the text nearby, so an edit changes only the pieces around it. The
    pieces joined together are the text.
    """
    pattern = rf"(?s).{{{least},{most - 1}}}?[.!?。！？](?:\x20|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _name(chunk: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def _shared_names(docs: DataFrame, text: Column, bits: int) -> DataFrame:
    """Chunk names that more than one chunk text has. Equal chunks meet after map-side removal of copies."""
    # The outer form: for the plain one the optimizer would add a filter that cuts all texts twice.
    pieces = docs.select(F.explode_outer(chunks(normalised(text))).alias("chunk"))
    distinct = pieces.filter("chunk IS NOT NULL").select(_name(F.col("chunk"), bits).alias("name"), "chunk").distinct()
    return distinct.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")


def _recipes(docs: DataFrame, id_col: str, text: Column, row: Column, bits: int) -> DataFrame:
    """(row_id, doc_id, text_sha256, recipe): the ordered identifiers of each document's chunks.

    A chunk's identifier is its 64-bit name. That is verified first: where two chunk texts share a
    name, the identifier is the name and the text's rank among them.
    """
    shared = materialise(_shared_names(docs, text, bits), "names")
    whole = docs.select(row.alias("row_id"), col(id_col).alias("doc_id"), normalised(text).alias("text"))
    digest = F.sha2("text", 256).alias("text_sha256")
    if shared.isEmpty():
        names = F.transform(chunks(F.col("text")), lambda c: _name(c, bits))
        return whole.select("row_id", "doc_id", digest, names.alias("recipe"))
    whole = materialise(whole, "texts")
    named = whole.select("row_id", F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).withColumn(
        "name", _name(F.col("chunk"), bits)
    )
    variants = named.join(shared, "name", "left_semi").select("name", "chunk").distinct()
    ranked = variants.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("chunk")))
    part = F.struct("pos", F.array(F.col("name"), F.coalesce("rank", F.lit(0)).cast("long")).alias("id"))
    lists = named.join(ranked, ["name", "chunk"], "left").groupBy("row_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(part)), lambda p: p.id)).alias("recipe")
    )
    return whole.select("row_id", "doc_id", digest).join(lists, "row_id", "left").withColumn(
        "recipe", F.coalesce("recipe", F.array().cast("array<bigint>"))
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, name_bits: int = 64
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (and ``row_col`` if given).

    Texts are equal when they are the same after replacing every run of white space by one space.
    Each chunk text moves once, to have its identifier verified; after that only lists of
    identifiers are grouped and compared, never documents.

    - Missing text counts as empty; all empty texts are one group.
    - The row with the smallest id stays. A missing id comes after every id, so ``keep_id`` is
      missing only if the whole group has none.
    - Of rows that repeat both id and text exactly one stays.
    - An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    row = col(row_col) if row_col else F.monotonically_increasing_id()
    recipes = materialise(_recipes(docs, id_col, col(text_col), row, name_bits), "recipes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    groups = recipes.groupBy("recipe").agg(F.count(F.lit(1)).alias("size"), first.alias("first"))
    # Stored, so that the join below is between two plain shuffles, which adaptive execution can split.
    several = materialise(groups.filter("size > 1"), "groups")
    joined = recipes.join(several, "recipe", "left")
    single = F.col("size").isNull()
    out = joined.select(
        "row_id", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row_id") == F.col("first.row_id"))).alias("kept"),
        "text_sha256",
    )
    if row_col is None:
        return out.drop("row_id")
    return out.withColumnRenamed("row_id", fresh(out.drop("row_id").columns, row_col))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, row_col = with_row_ids(docs)
    groups = exact_groups(rows, id_col, text_col, row_col)
    return without_rows(rows, row_col, groups.filter(~F.col("kept")), docs.columns)

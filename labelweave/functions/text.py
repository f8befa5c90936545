"""Text cleaning as column expressions; no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    ASTRAL,
    CONTRACTIONS,
    EMOJI_BLOCKS,
    LEMMA_EXCEPTIONS,
    NOT_SPACE,
    NOT_WORD_NOT_SPACE,
    SPACE,
    SPACE_NOT_BLANK,
    WORD,
)

LITERAL_LIMIT = 1000


@lru_cache(maxsize=1)
def default_stop_words() -> tuple[str, ...]:
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def as_text(col: Column, null_as_text: bool = False) -> Column:
    """Cast to string; optionally turn missing values into the word ``nan``."""
    text = col.cast("string")
    return F.coalesce(text, F.lit("nan")) if null_as_text else text


def tokens(col: Column) -> Column:
    """White-space tokens, never an empty one."""
    return F.regexp_extract_all(col, F.lit(NOT_SPACE + "+"), F.lit(0))


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(NOT_SPACE + "+"))


def has_tokens(col: Column, n: int) -> Column:
    """At least ``n`` tokens; reads no further than the n-th."""
    return col.rlike(f"(?:{NOT_SPACE}+{SPACE}+){{{n - 1}}}{NOT_SPACE}")


def hashtag_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit("#" + WORD + "+"))


def emoji_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(ASTRAL))


def is_blank(col: Column) -> Column:
    return col.rlike("^" + SPACE + "*$")


def remove_mentions(col: Column) -> Column:
    return F.regexp_replace(col, "@" + WORD + "+", "")


def remove_urls(col: Column) -> Column:
    return F.regexp_replace(col, f"http{NOT_SPACE}+|www\\.{NOT_SPACE}+", "")


def remove_hash_sign(col: Column) -> Column:
    return F.replace(col, F.lit("#"), F.lit(""))


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "(?d)<.*?>", "")


def collapse_spaces(col: Column) -> Column:
    # Single blanks, the usual case, are not matched at all.
    return F.trim(F.regexp_replace(col, f" {SPACE}+|{SPACE_NOT_BLANK}{SPACE}*", " "))


def remove_emoji(col: Column) -> Column:
    return F.regexp_replace(col, EMOJI_BLOCKS, "")


def remove_non_ascii(col: Column) -> Column:
    return F.regexp_replace(col, r"[^\x00-\x7F]+", "")


def remove_punctuation(col: Column) -> Column:
    return F.regexp_replace(col, NOT_WORD_NOT_SPACE, "")


def squeeze_repeats(col: Column) -> Column:
    """Runs of three or more equal characters become two; line feeds are left alone."""
    return F.regexp_replace(col, r"(?d)(.)\1{2,}", "$1$1")


def soft_clean(col: Column) -> Column:
    """Mentions, links, hash signs and tags go; white space is collapsed."""
    for step in (remove_mentions, remove_urls, remove_hash_sign, strip_tags, collapse_spaces):
        col = step(col)
    return col


def _lookup(key: Column, table: Mapping[str, str], otherwise: Column) -> Column:
    """Literal-table lookup: a hash-set test first, so that misses stay cheap."""
    if len(table) > LITERAL_LIMIT:
        raise ValueError("use operators.cleaning.clean_texts for large tables")
    entries = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.when(key.isin(*table), F.element_at(entries, key)).otherwise(otherwise)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def contraction_parts(piece: Column) -> tuple[Column, Column, Column]:
    """Punctuation before, core and punctuation after of a piece with an apostrophe; other pieces are all core."""
    shape = r"(?s)^([^\p{L}\p{N}']*)(.*?)([^\p{L}\p{N}]*)$"
    marked = piece.contains("'")
    head, core, tail = (F.when(marked, F.regexp_extract(piece, shape, k)) for k in (1, 2, 3))
    return head.otherwise(""), core.otherwise(piece), tail.otherwise("")


def put_contraction(piece: Column, head: Column, core: Column, tail: Column, long: Column) -> Column:
    """The piece with its core written out as ``long``, if there is one; a capital stays."""
    capital = F.concat(F.upper(F.substring(long, 1, 1)), F.substr(long, F.lit(2)))
    cased = F.when(core.rlike("^[A-Z]"), capital).otherwise(long)
    return F.when(long.isNull(), piece).otherwise(F.concat(head, cased, tail))


def expand_contractions(col: Column, table: Mapping[str, str] = CONTRACTIONS) -> Column:
    """Replace contracted words; surrounding punctuation and white space stay."""
    bare = [re.escape(k) for k in table if "'" not in k]
    worth = f"'|(?iu)(?:^|{SPACE})(?:{'|'.join(bare)})(?:{SPACE}|$)" if bare else "'"

    def expand(piece: Column) -> Column:
        head, core, tail = contraction_parts(piece)
        return put_contraction(piece, head, core, tail, _lookup(F.lower(core), table, F.lit(None)))

    def expanded(plain: Column) -> Column:
        pieces = F.regexp_extract_all(plain, F.lit(f"{SPACE}+|{NOT_SPACE}+"), F.lit(0))
        return F.when(plain.rlike(worth), F.array_join(F.transform(pieces, expand), "")).otherwise(plain)

    return _once(F.replace(col, F.lit("’"), F.lit("'")), expanded)


def _restore_stem(stem: Column) -> Column:
    return (
        F.when(stem.rlike("(bb|dd|gg|mm|nn|pp|rr|tt)$"), F.substr(stem, F.lit(1), F.length(stem) - 1))
        .when(stem.rlike("(at|iz|bl|v|c|u)$"), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )


def lemma(word: Column, exceptions: Mapping[str, str] = LEMMA_EXCEPTIONS) -> Column:
    """Dictionary form of a lower-case word: exception table, then suffix rules."""
    return _lookup(word, exceptions, suffix_lemma(word))


def suffix_lemma(word: Column) -> Column:
    """Dictionary form of a lower-case word by its ending."""
    size = F.length(word)

    def cut(n: int) -> Column:
        return F.substr(word, F.lit(1), size - n)

    return (
        F.when((size > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((size > 4) & word.endswith("es") & word.rlike("(ss|sh|ch|x|z)es$"), cut(2))
        .when((size > 3) & word.endswith("s") & ~word.rlike("(ss|us|is)$"), cut(1))
        .when((size > 5) & word.endswith("ing") & word.rlike("[aeiouy].*ing$"), _restore_stem(cut(3)))
        .when((size > 4) & word.endswith("ed") & word.rlike("[aeiouy].*ed$"), _restore_stem(cut(2)))
        .otherwise(word)
    )


def lemmatise(col: Column, exceptions: Mapping[str, str] = LEMMA_EXCEPTIONS) -> Column:
    return F.array_join(F.transform(tokens(col), lambda w: lemma(w, exceptions)), " ")


def remove_stop_words(col: Column, stop_words: Iterable[str] | None = None) -> Column:
    words = tuple(stop_words) if stop_words is not None else default_stop_words()
    return F.array_join(F.filter(tokens(col), lambda w: ~F.lower(w).isin(*words)), " ")


def full_clean(
    col: Column,
    contractions: Mapping[str, str] = CONTRACTIONS,
    exceptions: Mapping[str, str] = LEMMA_EXCEPTIONS,
    stop_words: Iterable[str] | None = None,
) -> Column:
    """Soft cleaning, then contractions, repeats, case, punctuation, lemmas and stop words."""
    return full_clean_of_soft(soft_clean(col), contractions, exceptions, stop_words)


def full_clean_of_soft(
    col: Column,
    contractions: Mapping[str, str] = CONTRACTIONS,
    exceptions: Mapping[str, str] = LEMMA_EXCEPTIONS,
    stop_words: Iterable[str] | None = None,
) -> Column:
    """The steps of ``full_clean`` after soft cleaning."""
    col = expand_contractions(col, contractions)
    col = remove_punctuation(F.lower(squeeze_repeats(col)))
    if any(" " in lemma_text for lemma_text in exceptions.values()):
        return remove_stop_words(lemmatise(col, exceptions), stop_words)
    words = tuple(stop_words) if stop_words is not None else default_stop_words()
    kept = F.filter(F.transform(tokens(col), lambda w: lemma(w, exceptions)), lambda w: ~w.isin(*words))
    return F.array_join(kept, " ")


def preprocess(col: Column, soft: bool = True, **tables) -> Column:
    """Soft cleaning, or full cleaning of the softly cleaned text with the given word tables."""
    cleaned = soft_clean(col)
    return cleaned if soft else full_clean(cleaned, **tables)


def normalise_synonym(col: Column) -> Column:
    """Thesaurus spelling to text spelling: blanks for ``_`` and ``-``, lower case."""
    return F.lower(F.translate(col, "_-", "  "))

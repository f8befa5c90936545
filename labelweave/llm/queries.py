"""One query for each corpus operator, over whole tables and with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import (
    alignment, chat, collocations, decontaminate, exact_dedup, licenses, pieces, quality, sequences, sharding, simhash, substrings, token_counts,
)

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = 24


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(_table(spark, folder, "documents"), PIECE_MODEL)


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    lines = chat.transcript_lines(_table(spark, folder, "conversations"))
    return chat.parse_lines(lines, chat.train(lines))


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, folder, "documents"), [1.0] * SHARDS)


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(_table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def edits_of(docs: DataFrame) -> DataFrame:
    """Documents with three edits each, placed by the hash of the id: a replacement, an insertion and a removal."""
    length = F.char_length(F.coalesce("text", F.lit("")))

    def place(k: int):
        return F.pmod(F.xxhash64("doc_id", F.lit(k)), length + 1).cast("int")

    def edit(k: int, size: int, text: str):
        return F.struct(place(k).alias("start"), (place(k) + size).alias("stop"), F.lit(text).alias("text"))

    return docs.withColumn("edits", F.array(edit(1, 20, " replaced words"), edit(2, 0, "Inserted, with care. "), edit(3, 200, "")))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.edited_counts(edits_of(_table(spark, folder, "documents")), VOCABULARY)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_notices(_table(spark, folder, "documents"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    removed = substrings.remove_repeats(_table(spark, folder, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.token_file_checksums(_table(spark, folder, "documents"), WORD_VOCABULARY, END_ID)


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.link_scores(_table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_MODEL)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(_table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_decontamination, op3_sentencepiece, op4_chat_format, op5_quality_classifier,
        op6_sharding, op7_simhash, op8_token_counts, op9_license_scan, op10_substring_dedup, op11_token_files,
        op12_alignment, op13_collocations,
    )
}

_ITEM_WORDS = (
    r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+', '', 'g'), "
    r"'[^\x20\x09-\x0D]+')"
)


def _shingle_rows(key: str, table: str, sizes: str) -> str:
    """Distinct shingles of the sizes that an SQL list gives, which may use the number of words, n."""
    return (
        f"SELECT DISTINCT {key}, k, array_to_string(w[i:i + k - 1], ' ') AS s "
        f"FROM (SELECT {key}, w, k, unnest(range(1, len(w) - k + 2)) AS i "
        f"FROM (SELECT {key}, w, unnest({sizes}) AS k FROM (SELECT {key}, w, len(w) AS n FROM (SELECT {key}, {_ITEM_WORDS} AS w FROM {table}))) "
        f"WHERE len(w) >= k AND k > 0)"
    )


ORACLE = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY t)
    """,
    "op2_decontamination": f"""
        WITH d AS ({_shingle_rows('doc_id', 'documents', '[1, 2, 3, 4, 5]')}), b AS ({_shingle_rows('item_id', 'benchmark', '[least(n, 5)]')}),
        n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
        SELECT doc_id, item_id, CAST(count(*) AS INTEGER) AS shared, CAST(any_value(n_shingles) AS INTEGER) AS n_shingles,
               CAST(count(*) AS DOUBLE) / any_value(n_shingles) AS containment
        FROM d JOIN b USING (k, s) JOIN n USING (item_id)
        GROUP BY doc_id, item_id HAVING count(*) * 5 >= any_value(n_shingles) * 4
    """,
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
        f AS (SELECT s, min(doc_id) AS low FROM v GROUP BY s),
        r AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone
              FROM v JOIN f USING (s) WHERE low < doc_id GROUP BY doc_id),
        u AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        g AS (SELECT doc_id, unnest(gone) AS i, TRUE AS away FROM r),
        k AS (SELECT u.doc_id, string_agg(u.w[u.i], ' ' ORDER BY u.i) AS kept
              FROM u LEFT JOIN g ON u.doc_id = g.doc_id AND u.i = g.i WHERE away IS NULL GROUP BY u.doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op13_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
              FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
        g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n
              FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w)) GROUP BY ALL),
        total AS (SELECT lang, sum(n)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
        f AS (SELECT * FROM g WHERE n >= 30),
        inside AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(n) AS longer
              FROM (SELECT *, unnest(range(1, len(w) - j + 2)) AS i
                    FROM (SELECT lang, n, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS j FROM f WHERE k > 2)) GROUP BY ALL),
        c AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase)
              WHERE k > 1 AND (longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * f.n)),
        cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
              FROM (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM c)),
        scored AS (SELECT cuts.*, l.n AS l, r.n AS r, (2000000::HUGEINT * a // (l.n::HUGEINT + r.n))::BIGINT AS score
              FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = head JOIN f r ON r.lang = cuts.lang AND r.phrase = rest
              QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cuts.k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
}

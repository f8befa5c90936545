"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..functions.hashing import uniform
from ..operators import (
    augment,
    balance,
    build,
    cleaning,
    duplicates,
    encode,
    epochs,
    evaluate,
    labels,
    language,
    lookups,
    model,
    ordering,
    profile,
    similarity,
    split,
    tables,
)
from ..plans import balancing, judging, prepare
from ..session import drop_stored, materialise, settled, stage_path
from ..sources import readers, writers
from ..streaming import stateless
from .inputs import LINE_ID, SEED, STOP_WORDS, class_probabilities, labelled_documents, scored_lines, synonyms, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- text -------------------------------------------------------------------------------------


@query
def soft_clean(spark, sf):
    return docs(spark, sf).select("doc_id", text.soft_clean(F.col("text")).alias("soft"))


@query
def soft_clean_pages(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", text.soft_clean(F.concat_ws(" ", "url", "html")).alias("soft"))


@query
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("stripped"))


@query
def remove_parts(spark, sf):
    raw = F.col("text")
    return docs(spark, sf).select(
        "doc_id",
        text.remove_mentions(raw).alias("no_mentions"),
        text.remove_hash_sign(raw).alias("no_hash_sign"),
        text.remove_emoji(raw).alias("no_emoji"),
        text.remove_non_ascii(raw).alias("ascii_only"),
        text.remove_punctuation(raw).alias("no_punctuation"),
        text.collapse_spaces(raw).alias("one_space"),
    )


@query
def tokens(spark, sf):
    words = text.tokens(F.col("text"))
    return docs(spark, sf).select(
        "doc_id", F.size(words).alias("n_tokens"), F.array_join(words, "|").alias("tokens"),
        F.length("text").alias("n_characters"),
    )


@query
def squeeze_repeats(spark, sf):
    return docs(spark, sf).select("doc_id", text.squeeze_repeats(F.col("text")).alias("squeezed"))


@query
def expand_contractions(spark, sf):
    raw = F.regexp_replace(F.regexp_replace("text", "of", "don't"), "is ", "You're gonna ")
    return docs(spark, sf).select("doc_id", text.expand_contractions(raw).alias("expanded"))


@query
def lemmatise(spark, sf):
    return docs(spark, sf).select("doc_id", text.lemmatise(F.lower("text")).alias("lemmas"))


@query
def remove_stop_words(spark, sf):
    return docs(spark, sf).select("doc_id", text.remove_stop_words(F.col("text"), STOP_WORDS).alias("content"))


@query
def full_clean(spark, sf):
    return docs(spark, sf).select("doc_id", text.full_clean(F.col("text"), stop_words=STOP_WORDS).alias("full_text"))


@query
def preprocess_full(spark, sf):
    cleaned = text.preprocess(F.col("text"), soft=False, stop_words=STOP_WORDS)
    return table(spark, sf, "conversations").select("conv_id", "turn", cleaned.alias("full_text"))


@query
def preprocess_soft(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.preprocess(F.col("text")).alias("soft_text"))


@query
def clean_by_dictionary(spark, sf):
    """Full cleaning with a lemma dictionary of over 100 000 entries, partly the words of the texts."""
    frame = docs(spark, sf).select("doc_id", "text")
    own = frame.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    more = spark.range(100_000).select(F.concat(F.lit("qz"), F.col("id").cast("string")).alias("word"))
    lemmas = own.unionByName(more).select("word", F.substring("word", 1, 5).alias("lemma"))
    cleaned = cleaning.clean_texts(frame, "doc_id", "text", lemmas=lemmas, stop_words=STOP_WORDS)
    return cleaned.select("doc_id", "full_text")


@query
def replace_tokens(spark, sf):
    changes = spark.createDataFrame([("the", "THE"), ("que", "QUE"), ("und", "")], "word string, replacement string")
    return lookups.replace_tokens(docs(spark, sf).select("doc_id", "text"), "doc_id", "text", changes)


# --- projections and filters -------------------------------------------------------------------


def with_labels(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")


@query
def null_as_text(spark, sf):
    frame = with_labels(spark, sf)
    return frame.select("doc_id", text.as_text(F.col("toxic"), True).alias("toxic_text"))


@query
def drop_class(spark, sf):
    kept = tables.drop_class(with_labels(spark, sf), "toxic", 1)
    return kept.select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query
def drop_missing(spark, sf):
    return tables.drop_missing(with_labels(spark, sf), ["toxic", "quality"]).select("doc_id", "toxic", "quality")


@query
def empty_to_null(spark, sf):
    frame = with_labels(spark, sf).select("doc_id", F.col("toxic").cast("string").alias("toxic_text"), "lang")
    return tables.empty_to_null(frame, ["toxic_text", "lang"], ["", "0", "de"])


@query
def keep_renamed(spark, sf):
    return tables.keep_renamed(docs(spark, sf), {"doc_id": "row_id", "text": "tweet_text", "lang": "label"})


@query
def class_slice(spark, sf):
    inside, outside = tables.class_slice(with_labels(spark, sf), "toxic", 1)
    return inside.select("doc_id", F.lit("inside").alias("part")).unionByName(
        outside.select("doc_id", F.lit("outside").alias("part"))
    )


@query
def keep_flagged(spark, sf):
    return tables.keep_flagged(with_labels(spark, sf), F.col("quality") == 1).select("doc_id", "lang")


# --- labels -----------------------------------------------------------------------------------


@query
def binary_label(spark, sf):
    return labels.add_binary_label(with_labels(spark, sf), "lang", "en").select("doc_id", "label")


@query
def ordinal_labels(spark, sf):
    return labels.add_ordinal_label(docs(spark, sf), "lang").select("doc_id", "lang", "label")


@query
def event_type_codes(spark, sf):
    return labels.add_ordinal_label(table(spark, sf, "events"), "event_type").select("event_id", "event_type", "label")


@query
def label_map(spark, sf):
    return labels.label_map(docs(spark, sf), "source")


@query
def label_map_json(spark, sf):
    return writers.label_map_json(labels.label_map(docs(spark, sf), "lang"))


@query
def one_vs_rest(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label")
    return labels.one_vs_rest(rows, "label", 10).select("vec_id", "class", "indicator")


@query
def last_label_per_source(spark, sf):
    return lookups.last_value_per_key(docs(spark, sf), "source", "lang", "doc_id")


@query
def label_names(spark, sf):
    frame = docs(spark, sf)
    names = lookups.last_value_per_key(frame, "source", "lang", "doc_id")
    names = names.filter(F.col("lang") != "en").withColumnRenamed("lang", "value")
    named = lookups.add_looked_up(frame.select("doc_id", "source"), names, "source", F.lit("unknown"), spread=["doc_id"])
    return named.withColumnRenamed("value", "category")


@query
def build_dataset(spark, sf):
    frame = docs(spark, sf).select("doc_id", "text", "lang")
    return build.build_dataset(frame, "text", "lang", negative="en", stop_words=STOP_WORDS).drop("text")


# --- profiles ---------------------------------------------------------------------------------


@query
def class_distribution(spark, sf):
    return profile.class_distribution(docs(spark, sf), "source")


@query
def class_sizes(spark, sf):
    return profile.class_sizes(with_labels(spark, sf), "toxic")


@query
def imbalance_ratio(spark, sf):
    return rounded(profile.imbalance_ratio(docs(spark, sf), "lang"), ["imbalance_ratio"])


@query
def binary_shares(spark, sf):
    return rounded(profile.binary_shares(with_labels(spark, sf), "toxic"), ["share"])


@query
def missing_and_blank(spark, sf):
    return profile.missing_and_blank(with_labels(spark, sf))


@query
def text_means(spark, sf):
    means = profile.text_means(table(spark, sf, "conversations"), "text")
    return rounded(means, means.columns)


@query
def hashtag_emoji_means(spark, sf):
    means = profile.text_means(docs(spark, sf), "text")
    return rounded(means, means.columns)


@query
def surplus_duplicates(spark, sf):
    return duplicates.surplus_duplicates(docs(spark, sf), "text")


@query
def duplicate_summary(spark, sf):
    return duplicates.duplicate_summary(docs(spark, sf), "text", "source", "doc_id")


@query
def duplicate_labels(spark, sf):
    return duplicates.duplicate_labels(docs(spark, sf), "text", "source", "doc_id")


@query
def price_histogram(spark, sf):
    bins = profile.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)
    return rounded(bins, ["bin_start", "bin_end"], 4)


@query
def before_after_counts(spark, sf):
    frame = docs(spark, sf)
    kept = duplicates.drop_duplicates_and_conflicts(frame, "text", "source", "doc_id")
    return profile.before_after_counts(frame, kept, "source")


@query
def overview(spark, sf):
    frame = with_labels(spark, sf).select("doc_id", "text", "source", "toxic")
    return rounded(profile.overview(frame, "text", "source", "doc_id", "toxic"), ["value"])


# --- duplicates -------------------------------------------------------------------------------


@query
def dedupe_conflicts(spark, sf):
    return duplicates.drop_duplicates_and_conflicts(docs(spark, sf), "text", "source", "doc_id").select("doc_id", "source")


@query
def dedupe_multi(spark, sf):
    frame = build.add_soft_text(docs(spark, sf), "text", "soft")
    return duplicates.drop_duplicates_and_conflicts(frame, ["text", "soft"], "source", "doc_id").select("doc_id", "source")


@query
def removal_report(spark, sf):
    frame = build.add_soft_text(docs(spark, sf), "text", "soft")
    return duplicates.removal_report(frame, ["text", "soft"], "source", "doc_id")


# --- order, ids, splits -----------------------------------------------------------------------


@query
def dense_id(spark, sf):
    frame = table(spark, sf, "orders").select("o_orderkey")
    return ordering.dense_id(frame, ["o_orderkey"], rows_per_range=20_000)


@query
def running_quantity(spark, sf):
    frame = table(spark, sf, "lineitem").select(*LINE_ID, "l_returnflag", "l_quantity")
    totals = {"running_quantity": F.col("l_quantity").cast("double"), "running_rows": F.lit(1)}
    return ordering.running_total(frame, LINE_ID, totals, ["l_returnflag"], 20_000)


@query
def first_of_class(spark, sf):
    frame = docs(spark, sf).select("doc_id", "lang")
    sizes = frame.groupBy("lang").agg((F.count(F.lit(1)) / 3).cast("int").alias("n"))
    return ordering.first_of_class(frame, "doc_id", sizes, ["lang"])


@query
def seeded_shuffle(spark, sf):
    return ordering.seeded_shuffle(docs(spark, sf).select("doc_id", "lang"), ["doc_id"], SEED, keep_key=True)


@query
def next_free_id(spark, sf):
    largest = ordering.next_id(docs(spark, sf), "doc_id")
    return docs(spark, sf).select((F.col("doc_id") + F.lit(largest)).alias("new_id"))


@query
def stratified_split(spark, sf):
    return split.split(labelled_documents(spark, sf), "doc_id", "toxic").select("doc_id", "toxic", "split")


@query
def stratified_split_lines(spark, sf):
    return split.split(table(spark, sf, "lineitem").select(*LINE_ID, "l_returnflag"), LINE_ID, "l_returnflag")


@query
def plain_split(spark, sf):
    return split.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", None, [0.1], ["test", "train"])


@query
def split_quotas(spark, sf):
    return split.split_quotas(table(spark, sf, "events"), F.col("event_type"), [0.1, 0.19 / 0.9])


# --- sets and joins ---------------------------------------------------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), "role", "text")


@query
def texts_in_benchmark(spark, sf):
    """Of documents and benchmark items in one table, those whose text is a benchmark item's."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    pooled = tables.stack(docs(spark, sf).select("doc_id", "text"), items)
    return tables.rows_with_text_in(pooled, "text", items).select("doc_id", F.length("text").alias("n_characters"))


@query
def texts_not_in_documents(spark, sf):
    frame = docs(spark, sf)
    repeated = duplicates.text_groups(frame, ["text"], "source", "doc_id").filter("n_text > 1").select("first_id")
    copies = frame.join(repeated, frame.doc_id == repeated.first_id, "left_semi")
    return tables.rows_with_text_in(frame, "text", copies, keep=False).select("doc_id")


@query
def key_difference(spark, sf):
    """Customers without an order."""
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return tables.key_difference(table(spark, sf, "customer"), buyers, ["c_custkey"])


@query
def distinct_labels(spark, sf):
    return docs(spark, sf).select("lang", "source").distinct()


@query
def stack_tables(spark, sf):
    left = docs(spark, sf).select("doc_id", "text", "lang")
    right = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tables.stack(left, right).select("doc_id", "lang", F.length("text").alias("n_characters"))


def versions(spark: SparkSession, sf: str) -> DataFrame:
    frame = with_labels(spark, sf)
    soft = build.add_soft_text(frame, "text").select("doc_id", "toxic", "tweet_soft")
    plain = frame.select("doc_id", "toxic", F.lower("text").alias("tweet_full"))
    return tables.align_versions(soft, plain, ["doc_id", "toxic"], "tweet_soft", "tweet_full")


@query
def align_versions(spark, sf):
    return versions(spark, sf).withColumn("toxic", F.coalesce("toxic", F.lit(-1)))


@query
def alignment_violations(spark, sf):
    return tables.alignment_violations(versions(spark, sf), ["tweet_soft", "tweet_full", "toxic"])


# --- similarity -------------------------------------------------------------------------------


def blended(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding added to its own mirror image."""
    mixed = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + y.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", "label", mixed.alias("embedding"))


@query
def nearest_label(spark, sf):
    target = table(spark, sf, "embeddings").select(F.col("vec_id").alias("match_id"), F.col("label").alias("match_label"), "embedding")
    best = similarity.nearest(blended(spark, sf), target, "vec_id", "match_id", carry=["match_id", "match_label"])
    return rounded(best, ["similarity_score"])


@query
def nearest_within_label(spark, sf):
    target = table(spark, sf, "embeddings").select(F.col("vec_id").alias("match_id"), "label", "embedding")
    best = similarity.nearest(blended(spark, sf), target, "vec_id", "match_id", carry=["match_id"], by=["label"])
    return rounded(best, ["similarity_score"])


@query
def predict_class(spark, sf):
    source = blended(spark, sf).withColumn("tweet_text", F.concat(F.lit("s"), F.col("vec_id").cast("string")))
    target = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("target_id"), F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("tweet_text"),
        F.col("label").cast("string").alias("target"), "embedding",
    )
    return rounded(similarity.predict_class(source, target, "vec_id", "target_id", threshold=0.7), ["similarity_score"])


@query
def similarity_histogram(spark, sf):
    best = nearest_label(spark, sf)
    return rounded(profile.histogram(tables.keep_scored(best, 0.0), "similarity_score", 30), ["bin_start", "bin_end"])


@query
def cosine(spark, sf):
    mirrored = F.reverse("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(arrays.cosine(F.col("embedding"), mirrored), 6).alias("similarity"),
        F.round(arrays.cosine(F.col("embedding"), F.transform("embedding", lambda x: x * 0)), 6).alias("to_zero"),
    )


@query
def mean_word_vectors(spark, sf):
    items = table(spark, sf, "benchmark")
    vectors = table(spark, sf, "embeddings")
    count = vectors.count()
    place = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % F.lit(count)
    words = items.select(F.explode(text.tokens(F.col("text"))).alias("word")).distinct()
    known = words.withColumn("vec_id", place).join(vectors, "vec_id").select("word", F.col("embedding").alias("vector"))
    means = similarity.mean_word_vectors(items, "item_id", "text", known, 64)
    millionths = F.transform("embedding", lambda x: F.round(x * 1e6).cast("int").cast("string"))
    return means.select("item_id", F.array_join(millionths, ",").alias("vector"))


@query
def neighbour_recall(spark, sf):
    target = table(spark, sf, "embeddings").select("vec_id", "embedding")
    shifted = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + 0.3 * y.cast("double"))
    source = target.select("vec_id", shifted.alias("embedding"))
    target = target.withColumnRenamed("vec_id", "match_id")
    exact = similarity.nearest(source, target, "vec_id", "match_id", carry=["match_id"])
    found = similarity.approximate_search(source, target, "vec_id", "match_id", carry=["match_id"])
    recall = similarity.neighbour_recall(exact, found.best, "vec_id", 0.85).select(F.lit("recall").alias("metric"), F.col("recall").alias("value"))
    return recall.unionByName(found.effort.select(F.lit("share compared").alias("metric"), (F.col("compared") / F.col("pairs")).alias("value")))


@query
def nearest_by_regions(spark, sf):
    """The exact search through forty regions."""
    target = table(spark, sf, "embeddings").select(F.col("vec_id").alias("match_id"), F.col("label").alias("match_label"), "embedding")
    found = similarity.pruned_nearest(blended(spark, sf), target, "vec_id", "match_id", carry=["match_id", "match_label"], pivots=40)
    return rounded(found.best, ["similarity_score"])


@query
def search_effort(spark, sf):
    """Share of all pairs that the exact search through regions meets, for neighbours of at least 0.85 and for any."""
    target = table(spark, sf, "embeddings").select(F.col("vec_id").alias("match_id"), "embedding")
    out = []
    for name, at_least in (("threshold", 0.85), ("any", None)):
        found = similarity.pruned_nearest(blended(spark, sf), target, "vec_id", "match_id", carry=["match_id"], at_least=at_least, pivots=200)
        out.append(found.effort.select(F.lit(name).alias("search"), "pairs", (F.col("compared") < F.col("pairs") / 2).alias("below_half")))
    return out[0].unionByName(out[1])


@query
def text_vectors(spark, sf):
    """Whole vectors, in millionths."""
    vectors = similarity.text_vectors(docs(spark, sf).select("doc_id", "text"), "text", dims=64, kind="float64")
    millionths = F.transform("embedding", lambda x: F.round(x * 1e6).cast("int").cast("string"))
    return vectors.select("doc_id", F.array_join(millionths, ",").alias("vector"))


# --- augmentation -----------------------------------------------------------------------------


def worded(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("_words"))


@query
def aug_swap_most(spark, sf):
    """More swaps than there are disjoint pairs of words."""
    return augment.swap_words(worded(spark, sf), "doc_id", SEED, 0.8).select("doc_id", F.col("_swap").alias("swapped"))


@query
def dense_id_text(spark, sf):
    """Numbers in the order of text columns, whose first has few values."""
    frame = docs(spark, sf).select("doc_id", "source", "text")
    return ordering.dense_id(frame, ["source", "text", "doc_id"], start=100, rows_per_range=150).select("doc_id", "sample_id")


@query
def partly_labelled_metrics(spark, sf):
    """Most documents have no label; they are left out of the counts."""
    scored = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select("toxic", (F.col("n_chars") % 100 / 100).alias("score"))
    return evaluate.binary_metrics(scored, "toxic", "score", missing="drop").select("tn", "fp", "fn", "tp")


@query
def aug_swap(spark, sf):
    return augment.swap_words(worded(spark, sf), "doc_id", SEED, 0.1).select("doc_id", F.col("_swap").alias("swapped"))


@query
def aug_delete(spark, sf):
    return augment.delete_words(worded(spark, sf), "doc_id", SEED, 0.1).select("doc_id", F.col("_delete").alias("shortened"))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    return augment.augment(docs(spark, sf), "doc_id", "text", synonyms(spark), SEED, stop_words=STOP_WORDS)


@query
def aug_synonym(spark, sf):
    return variants(spark, sf).filter("method = 'synonym'").select("doc_id", "text")


@query
def aug_insert(spark, sf):
    return variants(spark, sf).filter("method = 'insert'").select("doc_id", "text")


@query
def augment_all(spark, sf):
    return variants(spark, sf)


@query
def synonym_lists(spark, sf):
    words = docs(spark, sf).select(F.explode(text.tokens(F.col("text"))).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    known = lookups.lookup_join(counted, synonyms(spark), ["word"], "inner", spread=["word"])
    return known.select("word", "n", F.array_join("synonyms", "|").alias("synonyms"))


def majority_size(frame: DataFrame, label: str) -> int:
    return profile.class_distribution(frame, label).agg(F.max("n")).first()[0]


@query
def balanced_table(spark, sf):
    """Originals and the texts that fill the smaller class, in one table."""
    frame = labelled_documents(spark, sf)
    return balance.balanced_table(
        frame, "doc_id", "text", "toxic", synonyms(spark), SEED, target_size=majority_size(frame, "toxic"), classes=[1], stop_words=STOP_WORDS
    )


@query
def balance_class(spark, sf):
    frame = labelled_documents(spark, sf)
    return balance.balance(
        frame, "doc_id", "text", "toxic", synonyms(spark), majority_size(frame, "toxic"), [1], SEED, stop_words=STOP_WORDS
    )


@query
def balance_all(spark, sf):
    frame = docs(spark, sf)
    return balance.balance(
        frame, "doc_id", "text", "lang", synonyms(spark), majority_size(frame, "lang"), None, SEED, stop_words=STOP_WORDS
    )


@query
def new_texts(spark, sf):
    frame = docs(spark, sf)
    fresh = balance.new_texts(variants(spark, sf).join(frame.select("doc_id", "lang"), "doc_id"), frame, "text", "lang")
    return fresh.select("doc_id", "variant")


@query
def accept_similar(spark, sf):
    frame = labelled_documents(spark, sf).select("doc_id", "text", "toxic")
    made = materialise(balance_class(spark, sf))
    kept = balance.accept_similar(made, frame, "doc_id", "text", "toxic")
    return kept.select("doc_id", "variant", "method", (F.col("similarity_score") >= 0.85).alias("near"))


def training_part(spark: SparkSession, sf: str, label: str, frame: DataFrame) -> DataFrame:
    """A prepared table as the preparation stage leaves it: cleaned once and stored."""
    soft = frame.withColumn("_soft", text.soft_clean(F.col("text")))
    full = text.full_clean_of_soft(F.col("_soft"), stop_words=STOP_WORDS)
    cleaned = soft.select(
        "doc_id", F.col("text").alias("tweet_text"), F.col("_soft").alias("tweet_soft"), full.alias("tweet_full"),
        F.col(label).alias("label"), "source",
    )
    return materialise(cleaned)


@query
def balance_training_binary(spark, sf):
    frame = labelled_documents(spark, sf)
    part = settled(spark, lambda: prepare.prepare_part(training_part(spark, sf, "toxic", frame), "doc_id", "label"), "part")
    balanced = balancing.balance_training(
        part, "doc_id", synonyms(spark), majority_size(frame, "toxic"), [1],
        augmentation={"stop_words": STOP_WORDS}, stop_words=STOP_WORDS,
    )
    drop_stored(part)
    return balanced.select("sample_id", "label", "is_augmented", "tweet_text", "tweet_soft", "tweet_full")


@query
def balance_training_classes(spark, sf):
    frame = docs(spark, sf)
    part = settled(
        spark, lambda: prepare.prepare_part(training_part(spark, sf, "lang", frame), "doc_id", "label", category_col="source"), "part"
    )
    balanced = balancing.balance_training(
        part, "doc_id", synonyms(spark), majority_size(frame, "lang"), category_col="source",
        augmentation={"stop_words": STOP_WORDS}, stop_words=STOP_WORDS,
    )
    drop_stored(part)
    return balanced.select("sample_id", "label", "source", "is_augmented", "tweet_text", "tweet_soft", "tweet_full")


@query
def balancing_diagnostics(spark, sf):
    frame = docs(spark, sf)
    made = balance.balance(
        frame, "doc_id", "text", "lang", synonyms(spark), majority_size(frame, "lang"), None, SEED, stop_words=STOP_WORDS
    )
    both = balance.with_originals(
        frame.select(F.col("doc_id").alias("sample_id"), "text", F.col("lang").alias("label")),
        made.select((F.col("doc_id") * 4 + F.col("variant") + 1_000_000_000).alias("sample_id"), "text", F.col("lang").alias("label")),
        ["sample_id", "text", "label"],
    )
    soft = both.select(
        "sample_id", "label", "is_augmented", F.col("text").alias("tweet_text"), text.soft_clean(F.col("text")).alias("tweet_soft")
    )
    versions = soft.withColumn("tweet_full", text.full_clean_of_soft(F.col("tweet_soft"), stop_words=STOP_WORDS))
    out = balancing.balancing_diagnostics(materialise(versions), dims=128)
    parts = [out[v].select(F.lit(v).alias("version"), "bin", "n") for v in ("tweet_text", "tweet_soft", "tweet_full")]
    return reduce(DataFrame.unionByName, parts)


# --- language ---------------------------------------------------------------------------------


@query
def language_id(spark, sf):
    frame = docs(spark, sf)
    return language.identify(frame, "doc_id", "text", language.fit_profile(frame, "text", "lang"))


@query
def keep_language(spark, sf):
    frame = docs(spark, sf)
    kept = language.keep_language(turns(spark, sf), "turn_id", "text", language.fit_profile(frame, "text", "lang"))
    return kept.select("turn_id", "role")


@query
def language_accuracy(spark, sf):
    parts = split.split_frames(split.split(docs(spark, sf), "doc_id", "lang"))
    fitted = language.fit_profile(parts["train"], "text", "lang")
    found = language.identify(parts["test"], "doc_id", "text", fitted).join(parts["test"].select("doc_id", "lang"), "doc_id")
    return found.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("language") == F.col("lang")).cast("int")), 6).alias("accuracy"))


# --- encoding and models ----------------------------------------------------------------------


@query
def vocabulary(spark, sf):
    return encode.vocabulary(table(spark, sf, "conversations"), "text", 2000)


@query
def fixed_length_ids(spark, sf):
    frame = table(spark, sf, "conversations")
    words = encode.vocabulary(frame, "text", 2000)
    rows = encode.fixed_length_ids(frame, ["conv_id", "turn"], "text", words, 128)
    return rows.select(
        "conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", "").alias("attention_mask"),
    )


@query
def softmax(spark, sf):
    probs = class_probabilities(spark, sf).select("vec_id", arrays.softmax(F.col("logits")).alias("p"))
    return probs.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(10)])


@query
def decide(spark, sf):
    probs = class_probabilities(spark, sf)
    return probs.select("vec_id", evaluate.decide_class(F.col("logits")).alias("pred_label"))


def scored_classes(spark: SparkSession, sf: str) -> DataFrame:
    probs = F.transform(arrays.softmax(F.col("logits")), lambda p: F.round(p, 9))
    frame = class_probabilities(spark, sf).withColumn("probabilities", probs)
    return frame.withColumn("pred_label", evaluate.decide_class(F.col("probabilities")))


@query
def train_and_score(spark, sf):
    frame = labelled_documents(spark, sf).select("doc_id", "text", "toxic")
    parts = split.split_frames(split.split(frame, "doc_id", "toxic"))
    trained = model.train_best(parts["train"], parts["val"], "text", "toxic", dims=4096, max_iter=10)
    return model.score(parts["test"], trained).select("doc_id", "toxic", "pred_label", F.round("probability", 4).alias("probability"))


@query
def train_and_score_classes(spark, sf):
    frame = labels.add_ordinal_label(docs(spark, sf), "lang").select("doc_id", "text", "label")
    parts = split.split_frames(split.split(frame, "doc_id", "label"))
    trained = model.train_best(parts["train"], parts["val"], "text", "label", 4, [0.01], 4096, 10)
    return evaluate.confusion(model.score(parts["test"], trained), "label", "pred_label", 4)


def english_epochs(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], list[dict]]:
    """The three parts of the documents, and three epochs of a classifier of English."""
    frame = docs(spark, sf).select("doc_id", "text", "lang", (F.col("lang") == "en").cast("int").alias("label"))
    parts = split.split_frames(materialise(split.split(frame, "doc_id", "lang")))
    return parts, epochs.train_epochs(parts["train"], parts["val"], "text", "label", 3, buckets=64)


@query
def epoch_metrics(spark, sf):
    """Validation metrics after every epoch."""
    _, history = english_epochs(spark, sf)
    names = ["accuracy", "f1", "precision", "recall"]
    rows = [(e["epoch"], *[float(e[n]) for n in names]) for e in history]
    return rounded(spark.createDataFrame(rows, "epoch int, " + ", ".join(f"{n} double" for n in names)), names)


@query
def epoch_scores(spark, sf):
    """Test scores by the weights of the best epoch."""
    parts, history = english_epochs(spark, sf)
    best = epochs.best_epoch(history)
    scored = epochs.score_with(parts["test"].select("doc_id", "text", "label"), "text", best["weights"])
    return scored.select("doc_id", "label", F.lit(best["epoch"]).alias("epoch"), F.round("probability", 6).alias("probability"))


@query
def judge_binary(spark, sf):
    frame = labelled_documents(spark, sf).select("doc_id", "text", F.col("toxic").alias("label"))
    parts = split.split_frames(split.split(frame, "doc_id", "label"))
    trained = model.train_best(parts["train"], parts["val"], "text", "label", grid=[0.01], dims=4096, max_iter=10)
    judged = judging.judge_binary(trained, parts["val"], parts["test"])
    return judged["test_youden"].unionByName(judged["test_standard"])


# --- evaluation -------------------------------------------------------------------------------


def binary_groups(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.score_groups(scored_lines(spark, sf), "true_label", "probability")


@query
def confusion(spark, sf):
    decided = scored_lines(spark, sf).withColumn("pred_label", evaluate.decide(F.col("probability"), 0.5))
    return evaluate.confusion(decided, "true_label", "pred_label", 2)


@query
def binary_metrics(spark, sf):
    row = evaluate.binary_metrics(scored_lines(spark, sf), "true_label", "probability", 0.5)
    return rounded(row, [c for c, t in row.dtypes if t == "double"])


@query
def roc_points(spark, sf):
    return rounded(evaluate.roc_points(binary_groups(spark, sf)), ["fpr", "tpr"])


@query
def pr_points(spark, sf):
    return rounded(evaluate.pr_points(binary_groups(spark, sf)), ["precision", "recall"])


@query
def curve_areas(spark, sf):
    return rounded(evaluate.curve_areas(binary_groups(spark, sf)), ["roc_auc", "pr_auc", "pr_trapezoid"])


@query
def youden(spark, sf):
    return rounded(evaluate.youden(binary_groups(spark, sf)), ["youden_j"])


@query
def youden_applied(spark, sf):
    lines = split.split(scored_lines(spark, sf), LINE_ID, "true_label")
    parts = split.split_frames(lines)
    tuned = evaluate.youden_threshold(parts["val"], "true_label", "probability")
    row = evaluate.binary_metrics(parts["test"], "true_label", "probability", tuned)
    return rounded(row.select("threshold", "tn", "fp", "fn", "tp", "accuracy", "roc_auc"), ["accuracy", "roc_auc"])


@query
def multiclass_confusion(spark, sf):
    return evaluate.confusion(scored_classes(spark, sf), "true_label", "pred_label", 10)


@query
def multiclass_metrics(spark, sf):
    row = evaluate.multiclass_metrics(evaluate.confusion(scored_classes(spark, sf), "true_label", "pred_label"))
    return rounded(row, row.columns)


@query
def ovr_areas(spark, sf):
    row = evaluate.ovr_areas(evaluate.ovr_groups(scored_classes(spark, sf), "true_label", "probabilities", 10))
    return rounded(row, row.columns)


@query
def ovr_roc_points(spark, sf):
    groups = evaluate.ovr_groups(scored_classes(spark, sf), "true_label", "probabilities", 10)
    return rounded(evaluate.roc_points(groups, ["class"]), ["fpr", "tpr", "threshold"])


@query
def predictions(spark, sf):
    rows = evaluate.predictions(scored_classes(spark, sf), "true_label", "probabilities", 10)
    return rounded(rows, [f"prob_class_{i}" for i in range(10)])


@query
def metric_headers(spark, sf):
    row = evaluate.binary_metrics(scored_lines(spark, sf), "true_label", "probability", 0.6)
    named = writers.with_metric_headers(row.drop("f1_macro", "precision_macro", "recall_macro"))
    return rounded(named, named.columns)


@query
def judge_multiclass_metrics(spark, sf):
    """The metrics file of a judged test set of ten classes, read back."""
    folder = stage_path(spark, "judged")
    judging.judge_multiclass(scored_classes(spark, sf), "true_label", "probabilities", 10, folder)
    found = spark.read.option("header", True).csv(f"{folder}/test_metrics.csv")
    return rounded(found.select(*[F.col(c).cast("double").alias(c) for c in found.columns]), found.columns)


@query
def judge_multiclass_predictions(spark, sf):
    """The predictions file of the same, read back."""
    folder = stage_path(spark, "judged")
    judging.judge_multiclass(scored_classes(spark, sf), "true_label", "probabilities", 10, folder)
    found = spark.read.option("header", True).csv(f"{folder}/test_predictions.csv")
    columns = [F.col(c).cast("double" if c.startswith("prob") else "int").alias(c) for c in found.columns]
    return rounded(found.select(*columns), [c for c in found.columns if c.startswith("prob")])


# --- files, streams, pipelines ----------------------------------------------------------------


@query
def model_input(spark, sf):
    """A prepared part, stored and read again as a classifier's input."""
    path = stage_path(spark, "part")
    prepared = labelled_documents(spark, sf).select("doc_id", text.soft_clean(F.col("text")).alias("tweet_soft"), F.col("toxic").alias("label"))
    writers.write_table(prepare.model_input(prepared).withColumn("spare", F.lit(1)), path)
    return readers.read_model_input(spark, path)


@query
def csv_round_trip(spark, sf):
    frame = docs(spark, sf).select("doc_id", text.soft_clean(F.col("text")).alias("text"), "lang")
    path = stage_path(spark, "csv")
    writers.write_table(frame, path, "csv")
    return readers.read_csv(spark, path, "doc_id long, text string, lang string")


@query
def split_round_trip(spark, sf):
    path = stage_path(spark, "split")
    frame = docs(spark, sf).select("doc_id", "lang", "source")
    writers.write_split(frame, path, "doc_id", stratify="lang")
    return readers.read_table(spark, path).select("doc_id", "lang", "source", F.col("split").cast("string"))


@query
def stream_clean(spark, sf):
    path = stage_path(spark, "stream")
    schema = docs(spark, sf).schema
    # A pattern fits one file as well as a folder of files.
    stream = stateless.read_stream(spark, f"{sf}/[d]ocuments.parquet", schema).select("doc_id", "text", "lang")
    cleaned = stateless.clean_stream(stream, "text", "lang", "en", stop_words=STOP_WORDS)
    stateless.run_available(cleaned, path, path.rsplit("/", 1)[1])
    return spark.read.parquet(path).select("doc_id", "tweet_soft", "tweet_full", "is_cyberbullying")


@query
def prepare_language(spark, sf):
    """The whole preparation, with the language filter in front."""
    frame = docs(spark, sf)
    parity = F.when(F.col("n_chars") % 2 == 0, "even").otherwise("odd")
    raw = frame.select("doc_id", F.col("text").alias("tweet_text"), parity.alias("cyberbullying_type"))
    ready = prepare.prepare_raw(
        raw, "doc_id", negative="even", profile=language.fit_profile(frame, "text", "lang"), language="en", dropped_class=None,
        stop_words=STOP_WORDS,
    )
    return ready.drop("tweet_text")


@query
def prepare_raw(spark, sf):
    raw = docs(spark, sf).select("doc_id", F.col("text").alias("tweet_text"), F.col("lang").alias("cyberbullying_type"))
    ready = prepare.prepare_raw(raw, "doc_id", negative="en", dropped_class="de", stop_words=STOP_WORDS)
    return ready.drop("tweet_text")


@query
def prepare_part(spark, sf):
    part = training_part(spark, sf, "lang", docs(spark, sf))
    return prepare.prepare_part(part, "doc_id", "label").select("doc_id", "tweet_full", "label")


@query
def labelled_class_distribution(spark, sf):
    frame = labelled_documents(spark, sf).withColumn("soft", text.soft_clean(F.col("text")))
    kept = duplicates.drop_duplicates_and_conflicts(frame, ["text", "soft"], "toxic", "doc_id")
    return profile.class_distribution(kept, "toxic")


@query
def group_noise(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(uniform(SEED, F.col("event_id"), "noise"), 9).alias("noise"))

"""Lookup tables and derived inputs shared by the queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..operators.augment import synonym_table
from ..sources.readers import read_table, spread

SEED = 42
LINE_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# Frequent function words of the four languages in the test texts.
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by are this at from "
    "le la les de des du et un une en que qui pour par est dans "
    "der die das und ist nicht ein eine mit von zu auf "
    "el los las y es con por para se del"
).split()

# Fixed values: (word, synonym) pairs in thesaurus spelling.
SYNONYM_PAIRS = [
    ("rewh", "orre_re"), ("rewh", "Rewhing"), ("orre", "re-orre"), ("orre", "orre"), ("thatin", "that_in"),
    ("thatin", "inthat"), ("ononst", "onst"), ("inoran", "oran_in"), ("inoran", "inor"), ("orantion", "oration"),
    ("hehely", "he-he"), ("nd", "and_also"), ("the", "that"), ("the", "this_one"), ("erin", "eran"),
    ("que", "qui"), ("ment", "mente_a"), ("eau", "eaux"), ("nicht", "nie"), ("ein", "eins"), ("ung", "ungen"),
    ("para", "por_el"), ("con", "junto_a"), ("cie", "ciel"), ("éa", "éau"), ("on", "upon"), ("th", "thy"),
]


# Tables with costly work per row, by the key they are spread on.
ROW_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"], "lineitem": LINE_ID}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = read_table(spark, f"{folder}/{name}.parquet")
    return spread(df, ROW_KEYS[name]) if name in ROW_KEYS else df


def synonyms(spark: SparkSession) -> DataFrame:
    return synonym_table(spark.createDataFrame(SYNONYM_PAIRS, "word string, synonym string"))


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that carry quality labels."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line with a 0/1 label and a score that leans towards it; scores are often tied."""
    lines = table(spark, folder, "lineitem").select(*LINE_ID, "l_returnflag")
    label = (F.col("l_returnflag") == "R").cast("int")
    noise = uniform(SEED, F.col("l_orderkey"), "score", F.col("l_linenumber"))
    return lines.select(
        *LINE_ID, label.alias("true_label"),
        F.round(noise * 0.7 + label * 0.3, 3).alias("probability"),
    )


# Numbers of an embedding that make up the logit of each of the ten classes.
CLASS_PLACES = [range(k, 64, 10) for k in range(10)]


def class_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding with ten logits, each the sum of every tenth number, raised for its own label."""
    logits = [
        reduce(lambda a, b: a + b, [F.col("embedding")[i].cast("double") for i in places]) * 4
        + F.when(F.col("label") == k, 1.0).otherwise(0.0)
        for k, places in enumerate(CLASS_PLACES)
    ]
    return table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("true_label"), F.array(*logits).alias("logits"))

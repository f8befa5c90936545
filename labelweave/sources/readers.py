"""Reading labelled text tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.fixed_values import NA_TOKENS
from ..operators.tables import empty_to_null, require_columns

RAW_SCHEMA = "tweet_text string, cyberbullying_type string"
MODEL_INPUT = ("text", "label")


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str = RAW_SCHEMA, na_tokens: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """CSV with header, quoted line feeds and the usual missing-value words.

    A CSV with quoted line feeds cannot be cut into pieces, so one file is one task: keep large
    data in many files and convert it to Parquet once. A missing path is an AnalysisException.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("enforceSchema", False)
        .csv(path)
    )
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return empty_to_null(df, texts, na_tokens)


def convert_csv(spark: SparkSession, source: str, target: str, schema: StructType | str = RAW_SCHEMA) -> DataFrame:
    """Store CSV files as Parquet once and return the stored table."""
    read_csv(spark, source, schema).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet table, optionally only some columns."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    require_columns(df, columns)
    return df.select(*columns)


def spread(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Give a table that arrives in fewer pieces than there are cores one piece per core.

    Pieces follow the row key, so later work keyed by it needs no further shuffle. Tables of
    many pieces are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *columns)


def read_model_input(spark: SparkSession, path: str) -> DataFrame:
    """Prepared (text, label) rows of one part."""
    return read_table(spark, path, MODEL_INPUT).withColumn("label", F.col("label").cast("int"))

"""The row-wise operators on streams: cleaning, binary labels and scoring keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.build import build_dataset
from ..operators.model import TrainedClassifier, score
from ..session import shared_folder


def read_stream(
    spark: SparkSession, folder: str, schema: StructType | str, pattern: str | None = None, files_per_batch: int = 1000
) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def clean_stream(stream: DataFrame, text_col: str, label_col: str, negative: str, **tables) -> DataFrame:
    """Cleaned text versions and binary label; ordinal codes need a known label table instead."""
    return build_dataset(stream, text_col, label_col, multiclass=False, negative=negative, **tables)


def score_stream(stream: DataFrame, model: TrainedClassifier) -> DataFrame:
    return score(stream, model)


def run_available(stream: DataFrame, out: str, name: str) -> StreamingQuery:
    """Process what is there and stop; progress is kept in the shared folder, so a rerun continues."""
    progress = f"{shared_folder(stream.sparkSession)}/progress/{name}"
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .option("path", out)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

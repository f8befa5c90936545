"""Session set-up and the one place that decides where lineage is cut."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "labelweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC time and the web page off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package along with the session's jobs, once per application, so executors need not have it installed."""
    context, package = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if _SHIPPED.get("to") != context.applicationId:
        folder = tempfile.mkdtemp(prefix="labelweave-code-")  # read by the driver alone, which serves it
        archive = shutil.make_archive(f"{folder}/labelweave", "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _SHIPPED["to"] = context.applicationId
    return spark


_SHIPPED: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    On a cluster a missing setting is an error, because a folder of one machine is lost with that machine.
    A local-mode session without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="labelweave-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage_path(spark: SparkSession, name: str = "stage") -> str:
    """A fresh folder for an intermediate table of this application."""
    return f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"


def _stages(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stages/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute once, store as Parquet in the shared folder and continue from the stored table.

    For results that several jobs read: lost executors cost no recomputation, and later jobs
    read only the columns they need. Stored tables stay until ``drop_stages``, or until ``settled`` deletes them.
    """
    path = stage_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    for stored in _STORED:
        stored.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """What ``make`` returns, stored; tables stored on the way are deleted, so nothing else may read them.

    Inside, tables are stored with zstd, and the shuffle files of a job go when it ends, so that a long plan needs
    the disk of its largest step and not that of all steps together.
    """
    with sparing_disk(spark):
        _STORED.append([])
        try:
            result = materialise(make(), name)
        finally:
            stored = _STORED.pop()
    drop_paths(spark, stored[:-1])
    return result


#: Paths of the tables stored inside each ``settled`` that has not ended.
_STORED: list[list[str]] = []


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside store tables with zstd and delete their shuffle files at their end."""
    wanted = {"spark.sql.parquet.compression.codec": "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def drop_stages(spark: SparkSession) -> None:
    """Delete the intermediate tables this application stored; those of others in the folder stay."""
    drop_paths(spark, [_stages(spark)])


def drop_stored(df: DataFrame) -> None:
    """Delete a table that ``materialise`` or ``settled`` returned; files that are no stages of this application stay."""
    inside = f"/stages/{df.sparkSession.sparkContext.applicationId}/"
    drop_paths(df.sparkSession, sorted({file.rsplit("/", 1)[0] for file in df.inputFiles() if inside in file}))


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions

_SHIPPED: set[str] = set()


def build_session(app_name: str = "varibreak", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in on a local master only; on a
    cluster it would lie on one machine, so that case is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="varibreak-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of ``df`` in ``checkpoint_folder``."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to ``checkpoint_folder`` and read again, for tables that later rounds are made of.

    A checkpoint keeps the size Spark guessed for its plan, and guesses for joins multiply: after some rounds of joins
    and checkpoints the driver is busy with numbers of millions of digits.  Files have their own size.
    """
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, written once and marked for broadcasting if it has at most ``most`` rows; a larger one is joined by a shuffle."""
    held = cut_lineage(df)
    return functions.broadcast(held) if held.limit(most + 1).count() <= most else held


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, joined by a shuffle unless the other side is marked for broadcasting: for exploded rows and glued texts.

    Spark takes an exploded table for no larger than the one it came from, and so would send it to the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """``df`` in parts of about ``most`` rows by ``keys``, for steps that order a part: ``rows`` is its length or a bound of it.

    Left alone Spark makes parts by their bytes in the shuffle, and ordered coordinates of a few bytes each take tens of
    times that in a task's memory.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most))
    return df.repartition(parts, *keys)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once per context, so that jobs run from any folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="varibreak-package-"), "varibreak"), "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

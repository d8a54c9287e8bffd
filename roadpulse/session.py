"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("roadpulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir, which all executors reach.

    Only a local session without that setting gets a folder in its warehouse, which is removed when the process ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lineage-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
        # What a local session has written for itself goes when its process ends.
        atexit.register(shutil.rmtree, unquote(urlsplit(folder).path), ignore_errors=True)
    return folder


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session, so that it need not be installed on the executors."""
    context = spark.sparkContext
    if getattr(context, "_roadpulse_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="roadpulse-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(archive)
    context._roadpulse_shipped = True


def by_merge(df: DataFrame) -> DataFrame:
    """`df`, whose rows follow the input's, marked to be joined by shuffling both sides.

    Spark goes by a table's compressed size, and what it then sends through the driver to all tasks can be many times larger.
    """
    return df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from there.

    The table outlives lost executors, and unlike a checkpoint it is read by column and has a known size, so later
    joins are planned on it.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session settings shared by jobs, tests and the bench."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "shelfgrade", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above.

    ``spark.sql.shuffle.partitions`` is left to the cluster unless given: AQE coalesces a
    generous number, it cannot split a stingy one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession, root: Path = Path(__file__).resolve().parents[1]) -> None:
    """Put this repository's packages on the workers, once per application.

    Not needed where they are installed (``pip install .``) or on ``PYTHONPATH``, which workers inherit.
    """
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="shelfgrade-")) / "shelfgrade_packages.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for package in ("shelfgrade", "catalog_queries"):
            for file in sorted((root / package).rglob("*.py")):
                z.write(file, file.relative_to(root))
    context.addPyFile(str(archive))


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has, where their files are read in fewer.

    For tables with costly work on each row: a file is read by one task per row group, however many cores there are.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on one machine, where that is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfgrade-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: work that several readers need is done once, and outlives executors.

    The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)

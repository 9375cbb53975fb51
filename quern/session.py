"""Session defaults and the folder that all executors share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", name: str = "quern") -> SparkSession:
    """A single-machine session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    It is the one the session names in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local does this make a temporary one; a cluster without the setting is refused, as a
    machine-local folder would be invisible to other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + os.path.join(tempfile.gettempdir(), f"quern-{os.getpid()}")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context; they need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_quern_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="quern-ship-")  # on the driver, which serves the file to executors
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "quern_package"), "zip", os.path.dirname(package), os.path.basename(package)))
        sc._quern_shipped = True


def scratch(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other call gets."""
    ship(spark)
    return f"{shared_dir(spark)}/quern/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it comes in fewer splits than there are cores (one small file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyforge")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is only used when nothing is set and Spark itself
    runs on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back.

    Later passes see the same rows, and lineage is cut without tying the rows to
    the executors that made them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyforge-")


_ARROW = {
    "string": pa.string(),
    "double": pa.float64(),
    "long": pa.int64(),
    "array<string>": pa.list_(pa.string()),
}


def config_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """A few rows of configuration as a local relation, whose size Spark knows when it plans joins."""
    values = list(zip(*rows)) or [[] for _ in columns]
    arrays = [pa.array(list(column), _ARROW[kind]) for column, kind in zip(values, columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan alone yields fewer tasks than there are cores.

    For work that is heavy per row. A table large enough to fill the cluster
    passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

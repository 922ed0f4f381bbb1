"""Where results that several stages read are kept, and how they are cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one of a local session (tests).

    On a cluster there is no folder that all executors see without being told, so it has to be named there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="tapeloom-"))
    return "file://" + _LOCAL[0].name


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tapeloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and any executor can read it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Workspace:
    """Intermediate tables of one operator: all go once its result is written as a table of its own.

    with Workspace(spark) as space:
        part = space.keep(frame, "part")
        return space.result(frame_of_parts, "result")

    On an error, too, the intermediate tables are removed.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []
        self.names: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            discard(self.spark, path)

    def path(self, name: str) -> str:
        self.paths.append(fresh_path(self.spark, name))
        return self.paths[-1]

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """The table in buckets by a key, so that joins by it leave it where it is."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.names.append(f"tapeloom_{uuid.uuid4().hex}")
        df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("path", self.path(name)).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return materialise(df, name)


def mapped_dir(spark: SparkSession, name: str) -> str:
    """A new folder that workers can memory-map: the shared folder has to be a mounted file system for it."""
    path = urlparse(fresh_path(spark, name))
    if path.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {path.scheme}:")
    return path.path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

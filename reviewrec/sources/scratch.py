"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder; on one machine, where none is named, a temporary one. A cluster has to name it, as executors share no other."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="reviewrec-"))
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """The shuffle files of a step go when its result is written, and not when the driver happens to collect garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back: the lineage ends here, and its shuffle files go."""
    path = scratch_path(df.sparkSession, name)
    free_shuffles(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Scratch:
    """Written tables that go as soon as no step needs them: `drop` them, or leave the `with` block, where all but the `keep`ed ones go."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _, path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        free_shuffles(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Of tables that this made; others are left alone."""
        for table, path in self.paths:
            if any(table is t for t in tables):
                remove(self.spark, path)
        self.keep(*tables)

    def keep(self, *tables: DataFrame) -> None:
        """These outlive the block."""
        self.paths = [(t, p) for t, p in self.paths if not any(t is x for x in tables)]

"""Sources and sinks: JSON Lines, CSV, Parquet, vector stores, id maps, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERACTION = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.TimestampNTZType()),
])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """JSON Lines with a given schema; limit: rows at most."""
    df = spark.read.schema(schema).json(path)
    return df if limit is None else df.limit(limit)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def stack(frames: list[DataFrame]) -> DataFrame:
    """All rows of some tables by column name; a column that one lacks is null there."""
    out, *more = frames
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_categories(frames: dict[str, DataFrame], column: str = "main_category") -> DataFrame:
    """Tags each source with its category and stacks them."""
    return stack([df.withColumn(column, F.lit(name)) for name, df in frames.items()])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def read_columns(spark: SparkSession, path: str, required: list[str], any_of: dict[str, list[str]]) -> DataFrame:
    """Only the required columns, and for each name the first of its alternatives that the table has."""
    df = spark.read.parquet(path)
    require_columns(df, required)
    found = []
    for name, options in any_of.items():
        there = [o for o in options if o in df.columns]
        if not there:
            raise ValueError(f"none of {', '.join(options)}")
        found.append(F.col(there[0]).alias(name))
    return df.select(*required, *found)


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    df.select(F.col(key), F.col(vector).cast("array<float>").alias(vector)).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_id_map(df: DataFrame, path: str) -> None:
    df.select("id", "idx").write.parquet(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def confidence_table(interactions: DataFrame, scale: float = 5.0) -> DataFrame:
    """(user_id, item_id, confidence): rating over scale; several ratings of a pair add up."""
    return interactions.groupBy("user_id", "item_id").agg((F.sum("rating") / scale).alias("confidence"))

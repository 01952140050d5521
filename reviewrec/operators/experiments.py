"""Experiment runs as a long table, leaderboards and parameter tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import winner

RUNS = "run_id string, run_name string, status string, start_time long, kind string, key string, value string"


def log_run(spark: SparkSession, path: str, run_id: str, name: str, params: dict, metrics: dict, start_time: int, status: str = "FINISHED") -> None:
    """Appends one run to the table at path."""
    rows = [(run_id, name, status, start_time, kind, k, str(v)) for kind, d in (("param", params), ("metric", metrics)) for k, v in d.items()]
    spark.createDataFrame(rows, RUNS).write.mode("append").parquet(path)


def latest_runs(runs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """All rows of each name's latest finished run; expected: only these names (run_name)."""
    done = runs.where("status = 'FINISHED'")
    if expected is not None:
        done = done.join(expected.select("run_name").distinct(), "run_name", "left_semi")
    last = done.groupBy("run_name").agg(F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"))
    return done.join(last, ["run_name", "run_id"], "left_semi")


def missing_runs(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_name, state): expected names without a finished run, and finished names that were not expected."""
    done = runs.where("status = 'FINISHED'").select("run_name").distinct()
    gone = expected.select("run_name").distinct().join(done, "run_name", "left_anti").withColumn("state", F.lit("missing"))
    return gone.unionByName(done.join(expected, "run_name", "left_anti").withColumn("state", F.lit("extra")))


def leaderboard(runs: DataFrame, metrics: list[str], by: str = "ndcg") -> DataFrame:
    """A row a run with its metrics and its rank by one of them; runs without it come last. Ranks runs, so the table is small."""
    wide = runs.where("kind = 'metric'").groupBy("run_name").pivot("key", metrics).agg(F.first(F.col("value").cast("double")))
    return wide.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), "run_name")))


def winners(board: DataFrame, highest: dict[str, bool]) -> DataFrame:
    out = None
    for metric, high in highest.items():
        row = winner(board, "run_name", metric, high)
        out = row if out is None else out.unionByName(row)
    return out


def param_table(runs: DataFrame, params: list[str]) -> DataFrame:
    """A row a run with its parameters; parameters that no run has are left out."""
    wide = runs.where("kind = 'param'").groupBy("run_name").pivot("key", params).agg(F.first("value"))
    there = wide.agg(*(F.count(p).alias(p) for p in params)).first()
    return wide.select("run_name", *(p for p in params if there[p]))

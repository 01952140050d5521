"""Exact quantiles of many groups by distributed selection: no task holds a group.

Different values are counted (partly before the shuffle, so a value that fills the table is a few rows) and dealt into ranges by group and value. A range adds up its own counts; what
the earlier ranges of a group hold comes from one row a range and group. That places every value among all of its group, and the few values at the wanted
places make the quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewrec.sources.scratch import Scratch


def exact_quantiles(df: DataFrame, by: list[str], column: str | Column, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): with linear interpolation between neighbours, as `percentile` has it; null keys are a group, nulls in the column don't count.

    Groups without a value have no row; without `by` there is one row, of nulls if there is no value. shares: quantiles between 0 and 1 by name.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    group = F.struct(*(F.col(b) for b in by)) if by else F.lit(0)
    counted = df.select(group.alias("g"), value.alias("value")).where("value is not null").groupBy("g", "value").agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with Scratch(df.sparkSession) as scratch:
        ranges = scratch.written(counted.repartitionByRange(parts, "g", "value").withColumn("part", F.spark_partition_id()), "ranges")
        inside = Window.partitionBy("g", "part").orderBy("value")
        earlier = Window.partitionBy("g").orderBy("part")
        sums = ranges.groupBy("g", "part").agg(F.sum("n").alias("size"))
        sums = sums.select("g", "part", (F.sum("size").over(earlier) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy("g")).alias("all"))
        placed = ranges.withColumn("upto", F.sum("n").over(inside)).join(sums, ["g", "part"])
        first, past = F.col("before") + F.col("upto") - F.col("n"), F.col("before") + F.col("upto")
        at = {name: q * (F.col("all") - 1) for name, q in shares.items()}
        here = lambda place: (first <= place) & (place < past)
        ends = {name: (here(F.floor(p)), here(F.ceil(p))) for name, p in at.items()}
        wanted = [side for pair in ends.values() for side in pair]
        some = placed.where(_any(wanted))
        found = some.groupBy("g").agg(F.max("all").alias("all"), *(F.max(F.when(ends[n][k], F.col("value"))).alias(f"{n}_{k}") for n in shares for k in (0, 1)))
        # the places again, over the grouped rows
        between = lambda n: (F.ceil(at[n]) - at[n]) * F.col(f"{n}_0") + (at[n] - F.floor(at[n])) * F.col(f"{n}_1")
        columns = [F.when((F.floor(at[n]) == F.ceil(at[n])) | (F.col(f"{n}_0") == F.col(f"{n}_1")), F.col(f"{n}_0")).otherwise(between(n)).alias(n) for n in shares]
        if by:
            out = found.select(*(F.col(f"g.{b}").alias(b) for b in by), *columns)
        else:
            out = found.select(*columns).agg(*(F.max(n).alias(n) for n in shares))
        out = scratch.written(out, "quantiles")
        scratch.keep(out)
    return out


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out

"""Sums along a total order without a window over all rows: the rows are cut into buckets that follow the order, and each bucket starts with the sums of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def quantile_bucket(df: DataFrame, by: str, buckets: int = 64) -> DataFrame:
    """df with `_bucket`, by approximate quantiles of a number: one row of bounds goes to all tasks."""
    bounds = df.agg(F.array_distinct(F.percentile_approx(by, [k / buckets for k in range(1, buckets)], 10_000)).alias("_bounds"))
    return df.join(F.broadcast(bounds), how="cross").withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < C(by)))).drop("_bounds")


def sums_before(df: DataFrame, by: str, bucket: Column, sums: list[str]) -> DataFrame:
    """df with <name>_before for each of `sums`, its total over all rows with a smaller `by`, which has to be distinct. `bucket` has to follow the order of `by`; one row of each bucket passes the window over buckets."""
    rows = df.withColumn("_bucket", bucket)
    of_all = Window.partitionBy(F.lit(1)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_bucket").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    starts = totals.select("_bucket", *[F.coalesce(F.sum(f"_{s}").over(of_all), F.lit(0)).alias(f"_{s}") for s in sums])
    own = Window.partitionBy("_bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({f"{s}_before": F.coalesce(F.sum(s).over(own), F.lit(0)) for s in sums}).join(starts, "_bucket")
    return out.withColumns({f"{s}_before": C(f"{s}_before") + C(f"_{s}") for s in sums}).drop("_bucket", *[f"_{s}" for s in sums])


def placed_within(df: DataFrame, keys: list[str], by: str, bucket: Column, name: str) -> DataFrame:
    """df with `name`, a row's place from 1 among its keys' rows in the order of `by`. `bucket` has to follow that order; a task holds a bucket's rows, and one row of each bucket passes the window over a key."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(by))
    return rows.withColumn("_own", own).join(starts, [*keys, "_bucket"]).withColumn(name, C("_start") + C("_own")).drop("_bucket", "_own", "_start")

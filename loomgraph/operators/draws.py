"""Draws from discrete distributions: cumulative bounds, and a range join that is an equi-join on buckets of the unit interval."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.storage import hinted


def cumulative(distribution: DataFrame) -> DataFrame:
    """(value, lo, hi) of a distribution (value, weight): the part of the unit interval that each value of positive weight holds, in
    order of values. A row a distinct value is ordered in one task; values that repeat add up."""
    one = distribution.filter("weight > 0").groupBy("value").agg(F.sum("weight").alias("weight"))
    upto = F.sum("weight").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = one.withColumn("upto", upto).withColumn("all", F.max("upto").over(Window.partitionBy(F.lit(0))))
    hi = F.when(F.col("upto") == F.col("all"), 1.0).otherwise(F.col("upto") / F.col("all"))
    rows = rows.select("value", hi.alias("hi"))
    return rows.select("value", F.coalesce(F.lag("hi").over(Window.orderBy("value")), F.lit(0.0)).alias("lo"), "hi").filter("lo < hi")


def uniform(seed: int, *key: str) -> Column:
    """A number of at least 0 and below 1 drawn by a hash of seed and columns, so that draws do not depend on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) / float(1 << 52)


def drawn(rows: DataFrame, distribution: DataFrame, u: str = "u", buckets: int = 1024) -> DataFrame:
    """rows with the column value: that whose interval of the distribution (value, weight) holds u, from 0 to below 1.

    Intervals are listed under each bucket they touch, values + buckets rows at most, and rows join by their bucket. A null u draws
    nothing and is left out, as are all rows of an empty distribution.
    """
    at = cumulative(distribution)
    last = F.least(F.ceil(F.col("hi") * buckets) - 1, F.lit(buckets - 1))
    at = at.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.greatest(last, F.floor(F.col("lo") * buckets)))))
    joined = rows.withColumn("_b", F.floor(F.col(u) * buckets)).join(hinted(at), "_b")
    return joined.filter((F.col(u) >= F.col("lo")) & (F.col(u) < F.col("hi"))).drop("_b", "lo", "hi")


def poisson(spark: SparkSession, mean: float, most: int | None = None) -> DataFrame:
    """(value, weight): the Poisson distribution up to a value beyond which less than about 1e-12 lies."""
    top = most if most is not None else int(mean + 10 * math.sqrt(mean) + 20)
    weight = F.when(F.lit(mean) > 0, F.exp(F.col("id") * math.log(mean or 1.0) - mean - F.col("g"))).otherwise((F.col("id") == 0).cast("double"))
    facts = [(i, math.lgamma(i + 1)) for i in range(top + 1)]
    return spark.createDataFrame(facts, "id long, g double").select(F.col("id").alias("value"), weight.alias("weight"))

"""Tie-aware ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def mid_rank(partition: list[str], value: str) -> Column:
    """Percentile rank in which ties share the middle of their places; 50 for a single row. Null values have none."""
    w = Window.partitionBy(*partition)
    n = F.count(value).over(w)
    below = F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, value))
    return F.when(F.col(value).isNotNull(), F.when(n == 1, 50.0).otherwise((below + ties / F.lit(2.0)) / n * 100))


def _position(value: Column) -> Column:
    """A whole number that never falls where the value rises: its order of magnitude in 1/2^31 of a doubling."""
    x = F.nanvl(value.cast("double"), F.lit(1.7e308))
    size = F.greatest(F.least(F.abs(x), F.lit(1.7e308)), F.lit(1e-300))
    e = F.floor(F.log2(size))
    steps = F.floor((e + (size / F.pow(F.lit(2.0), e) - 1) + 1100.0) * (1 << 31)).cast("long")
    return F.when(x > 0, steps).when(x < 0, -steps).otherwise(F.lit(0).cast("long"))


def places(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, below, ties, n): for each distinct value how many rows of its keys are below it and equal to it.

    No partition holds a whole group, however its values are spread: values are counted first, then counts are added
    up over ranges of their order of magnitude, 1/1024 of a doubling and 1/2^31 of one. A window sees the ranges within one
    larger range (2^21 at most), or the larger ranges of a group (some 2^22).
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties"))
    counts = counts.withColumn("__q", _position(F.col(value)))
    fine = counts.groupBy(*keys, "__q").agg(F.sum("ties").alias("__s")).withColumn("__p", F.shiftright("__q", 21))
    coarse = fine.groupBy(*keys, "__p").agg(F.sum("__s").alias("__s"))

    def before(amount: str, within: list[str], by: str) -> Column:
        return F.coalesce(F.sum(amount).over(Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = coarse.select(*keys, "__p", before("__s", keys, "__p").alias("__b1"), F.sum("__s").over(Window.partitionBy(*keys)).alias("n"))
    fine = fine.select(*keys, "__q", "__p", before("__s", [*keys, "__p"], "__q").alias("__b2")).join(coarse, [*keys, "__p"])
    dealt = counts.withColumn("__in", before("ties", [*keys, "__q"], value)).join(fine, [*keys, "__q"])
    return dealt.select(*keys, value, (F.col("__b1") + F.col("__b2") + F.col("__in")).alias("below"), "ties", "n")


def library_mid_rank(df: DataFrame, keys: list[str], value: str, to: str, of: DataFrame | None = None) -> DataFrame:
    """The rows with their mid-rank among all rows (of ``of``, where given) of the same keys, however many those are."""
    p = places(df if of is None else of, keys, value)
    rank = F.when(F.col("n") == 1, 50.0).otherwise((F.col("below") + F.col("ties") / F.lit(2.0)) / F.col("n") * 100)
    return df.join(p.select(*keys, value, rank.alias(to)), [*keys, value], "left")


def ordered_index(df: DataFrame, value: str, to: str) -> DataFrame:
    """Rows numbered from 0 by a numeric value that no two rows share."""
    return df.join(places(df, [], value).select(value, F.col("below").alias(to)), value)

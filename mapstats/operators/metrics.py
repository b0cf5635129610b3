"""Partisan and population metrics of districts, as grouped aggregates and scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(dem: str = "dem", rep: str = "rep") -> Column:
    """Two-party share of D; null where nobody voted."""
    d, t = F.col(dem).cast("double"), (F.col(dem) + F.col(rep)).cast("double")
    return F.when(t > 0, d / t)


def winner(dem: str = "dem", rep: str = "rep") -> Column:
    return F.when(F.col(dem) > F.col(rep), "D").when(F.col(dem) < F.col(rep), "R").otherwise("Tie")


def seats() -> Column:
    """Districts with more D than R votes; ties are no seats."""
    return F.count_if(F.col("dem") > F.col("rep"))


def efficiency_gap() -> Column:
    """(wasted R - wasted D) / all votes; a tie wastes as an R win does."""
    d, r = F.col("dem").cast("double"), F.col("rep").cast("double")
    half = (d + r) / 2.0
    wasted_d = F.when(d > r, d - half).otherwise(d)
    wasted_r = F.when(d > r, r).otherwise(r - half)
    return F.sum(wasted_r - wasted_d) / F.nullif(F.sum(d + r), F.lit(0.0))


def mean_median() -> Column:
    """Median minus mean D share of districts with votes."""
    return F.median(share()) - F.avg(share())


def district_sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "district").agg(F.count("*").alias("units"), *[F.sum(c).alias(c) for c in ("totpop", "dem", "rep")])


def with_deviation(sums: DataFrame, *keys: str) -> DataFrame:
    """Relative deviation of each district from its plan's ideal population."""
    plan = Window.partitionBy(*keys)  # a row a district
    ideal = F.sum("totpop").over(plan).cast("double") / F.count("*").over(plan)
    return sums.withColumn("ideal", ideal).withColumn("deviation", F.col("totpop") / F.col("ideal") - 1.0)


def scorecard(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a plan: seats, efficiency gap, median minus mean, largest deviation."""
    d = with_deviation(district_sums(rows, *keys), *keys)
    return d.groupBy(*keys).agg(
        F.count("*").alias("districts"),
        seats().alias("dem_seats"),
        F.round(efficiency_gap(), 9).alias("efficiency_gap"),
        F.round(mean_median(), 9).alias("mean_median"),
        F.min("totpop").alias("min_pop"),
        F.max("totpop").alias("max_pop"),
        F.round(F.max(F.abs("deviation")), 9).alias("max_abs_pop_dev"),
    )

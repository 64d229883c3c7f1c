"""Counting, ranking and run operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Style values that say nothing.
EMPTY_VALUES = ("", "none", "normal", "auto", "0px", "rgba(0, 0, 0, 0)")


def tally(df: DataFrame, value: str, by: Sequence[str] = (), top: int | None = 12, skip: Sequence[str] = EMPTY_VALUES) -> DataFrame:
    """(by..., value, n, rank): how often each value occurs, most frequent first, ties by value."""
    counted = df.where(F.col(value).isNotNull() & ~F.col(value).cast("string").isin(list(skip))).groupBy(*by, value).agg(F.count("*").alias("n"))
    return ranked(counted, by, [F.desc("n"), F.asc(value)], top)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], top: int | None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if top is None else out.where(F.col("rank") <= top)


def zero_safe_tally(df: DataFrame, value: str) -> DataFrame:
    """(value, n) without null and empty values; zero counts like any other."""
    return df.where(F.col(value).isNotNull() & (F.col(value).cast("string") != "")).groupBy(value).agg(F.count("*").alias("n"))


def reason_histogram(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n")).orderBy(F.desc("n"), reason)


def share_tiers(df: DataFrame, value: str, structural: float = 0.05) -> DataFrame:
    """(value, n, total, tier): structural from a share of the total on, else decoration."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    return counted.crossJoin(F.broadcast(total)).withColumn("tier", F.when(F.col("n") / F.col("total") >= structural, "structural").otherwise("decoration"))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    least = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row")
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(least).select("row.*")


def largest_of(df: DataFrame, by: Sequence[str], size: str, count: str) -> DataFrame:
    """Of each group the largest size, of equal ones the most frequent."""
    return df.groupBy(*by).agg(F.max_by(F.struct(size, count), F.struct(size, count)).alias("best")).select(*by, f"best.{size}", f"best.{count}")


def most_common(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """Of each group the most frequent value, ties to the one seen first."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("best")).select(*by, f"best.{value}", "best.n")


def gaps(delays: Column) -> Column:
    """Differences of neighbours in a sorted array."""
    return F.when(F.size(delays) > 1, F.transform(F.sequence(F.lit(2), F.size(delays)), lambda i: F.element_at(delays, i) - F.element_at(delays, i - 1)))


def ladders(df: DataFrame, by: Sequence[str], delay: str, sample: str | None = None, order: str | None = None) -> DataFrame:
    """Staggered groups: (by..., n, delays, stagger, sample) of groups with more than one row, delays distinct and sorted, stagger their distinct gaps in order or null."""
    extra = [F.slice(F.transform(F.array_sort(F.collect_list(F.struct(order or delay, sample))), lambda x: x[sample]), 1, 3).alias("sample")] if sample else []
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(delay)).alias("delays"), *extra)
    return out.where("n > 1").withColumn("stagger", F.array_distinct(gaps(F.col("delays"))))


def equal_runs(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(by..., longest): the longest run of equal neighbours, by gaps and islands. Null equals null."""
    along = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(along))) | (F.row_number().over(along) == 1)
    marked = df.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(along))
    return marked.groupBy(*by, "__run").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("longest"))


def true_runs(df: DataFrame, by: Sequence[str], flag: str, order: Sequence[str]) -> DataFrame:
    """(by..., longest): the longest run of true neighbours, 0 without one."""
    along = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__f", F.coalesce(F.col(flag), F.lit(False))).withColumn("__run", F.sum((~F.col("__f")).cast("int")).over(along))
    return marked.groupBy(*by, "__run").agg(F.count_if("__f").alias("n")).groupBy(*by).agg(F.max("n").alias("longest"))


def sign_changes(df: DataFrame, by: Sequence[str], side: Column, order: Sequence[str]) -> DataFrame:
    """(by..., changes): how often a condition changes between neighbours."""
    along = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__side", side).withColumn("__change", (F.col("__side") != F.lag("__side").over(along)).cast("int"))
    return marked.groupBy(*by).agg(F.coalesce(F.sum("__change"), F.lit(0)).alias("changes"))


def carried(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> Column:
    """The last value given up to a row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def skip_reasons(df: DataFrame, key: str, reason: str, priority: str, order: str) -> DataFrame:
    """(key, reason): of several reasons a measured one (lower priority number) overrides a policy; among equals the first stands."""
    return df.groupBy(key).agg(F.min_by(reason, F.struct(priority, order)).alias(reason))

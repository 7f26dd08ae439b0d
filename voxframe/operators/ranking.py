"""Per-group features of candidates: ranks, scores against their group, and choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group(*by: str):
    return W.partitionBy(*(by or ("uid",)))


def rank_min(value: str, desc: bool = True, by=("uid",)) -> Column:
    """Smallest rank of ties; null has none."""
    order = F.col(value).desc_nulls_last() if desc else F.col(value).asc_nulls_last()
    return F.when(F.col(value).isNotNull(), F.rank().over(group(*by).orderBy(order)))


def rank_na_bottom(value: str, by=("uid",)) -> Column:
    """Smallest rank of ties, nulls sharing the last one."""
    return F.rank().over(group(*by).orderBy(F.col(value).desc_nulls_last()))


def rank_pct(value: str, by=("uid",)) -> Column:
    """Mean rank of ties by the number of non-null values."""
    ties = F.count(value).over(W.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), (F.rank().over(group(*by).orderBy(F.col(value).asc_nulls_last())) + (ties - 1) / 2) / F.count(value).over(group(*by)))


def rank_average(value: str, by=("uid",)) -> Column:
    ties = F.count("*").over(W.partitionBy(*by, value))
    return F.rank().over(group(*by).orderBy(value)) + (ties - 1) / 2


def zscore(value: str, floor: float = 1e-8, by=("uid",)) -> Column:
    """Distance from the group's mean in sample deviations; null in a group of one."""
    w = group(*by)
    return F.when(F.count(value).over(w) > 1, (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_samp(value).over(w), F.lit(floor)))


def zscore_nullzero(value: str, by=("uid",)) -> Column:
    w = group(*by)
    return (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))


def minmax(value: str, by=("uid",)) -> Column:
    w = group(*by)
    low = F.min(value).over(w)
    return (F.col(value) - low) / F.greatest(F.max(value).over(w) - low, F.lit(1e-8))


def second_best(value: str, by=("uid",)) -> Column:
    """Second largest value, ties counting twice; the largest in a group of one."""
    top = F.sort_array(F.collect_list(value).over(group(*by)), asc=False)
    return F.coalesce(F.get(top, F.lit(1)), F.get(top, F.lit(0)))


def relevance(value: str, levels: int = 4, by=("uid",)) -> Column:
    """Relevance from an error by mean rank: the best gets the top level, halves round to even."""
    n = F.count("*").over(group(*by))
    top = F.greatest(F.lit(2), F.least(n.cast("int"), F.lit(levels))) - 1
    return F.when(n == 1, F.lit(levels - 1)).otherwise(F.bround((1 - (rank_average(value, by) - 1) / (n - 1)) * top).cast("int"))


def relevance_gap(value: str, levels: int = 4, by=("uid",)) -> Column:
    w = group(*by)
    n, low, high = F.count("*").over(w), F.min(value).over(w), F.max(value).over(w)
    top = F.greatest(F.lit(2), F.least(n.cast("int"), F.lit(levels))) - 1
    return F.when(n == 1, F.lit(levels - 1)).when(high <= low + 1e-8, top).otherwise(F.bround((1 - (F.col(value) - low) / (high - low)) * top).cast("int"))


def relevance_best(value: str, by=("uid",)) -> Column:
    low = F.min(value).over(group(*by))
    return (F.abs(F.col(value) - low) <= 1e-8 + 1e-5 * F.abs(low)).cast("int")


def first_in_group(df, order: list, by=("uid",)):
    """One row per group: the first by ``order``."""
    return df.withColumn("_k", F.row_number().over(group(*by).orderBy(*order))).where("_k = 1").drop("_k")

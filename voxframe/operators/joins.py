"""Joins of manifests, and the checks that belong to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first by ``order``."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def left_dedup(left: DataFrame, right: DataFrame, key: list[str], order: list) -> DataFrame:
    """Left join with the first right row per key, so that no left row is doubled."""
    return left.join(keep_first(right, key, order), key, "left")


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, order: list, default: str = "") -> DataFrame:
    """Adds ``value`` by key, the last of duplicates; absent keys get the default."""
    last = keep_first(right.select(key, value, *[c for c in right.columns if c not in (key, value)]), [key], order).select(key, value)
    return left.join(last, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def inner_asserted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which each left row must find one right row; the plan fails at run time where it finds none or several."""
    rest = [c for c in right.columns if c != key]
    once = right.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_r"))
    told = lambda what: F.raise_error(F.concat(F.lit(f"{what} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    out = left.join(once, key, "left").where(F.when(F.col("_n").isNull(), told("no match")).when(F.col("_n") > 1, told("several matches")).otherwise(True))
    return out.select(*left.columns, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def inner_nway(tables: list[DataFrame], key: str, value: str, truth: str | None = None) -> DataFrame:
    """Wide table of one value per model over the keys that all have.

    With ``truth`` it is added once: the value that all tables agree on, those where it is null left aside; the plan
    fails at run time where two differ.
    """
    named = [t.select(key, F.col(value).alias(f"{value}_{i}"), *([F.col(truth).alias(f"_t{i}")] if truth else [])) for i, t in enumerate(tables)]
    out = reduce(lambda a, b: a.join(b, key), named)
    if not truth:
        return out
    said = [f"_t{i}" for i in range(len(tables))]
    least, most = (F.least(*said), F.greatest(*said)) if len(said) > 1 else (F.col(said[0]),) * 2
    agreed = F.when(least != most, F.raise_error(F.concat(F.lit(f"{truth} differs for {key} "), F.col(key).cast("string"))).cast(tables[0].schema[truth].dataType)).otherwise(least)
    return out.withColumn(truth, agreed).drop(*said)


def drop_leaking(df: DataFrame, fold: int, online: bool = False) -> DataFrame:
    """Drops external rows of fold -1 whose child is in the evaluated fold of the competition's rows.

    Rows of unknown source or fold, and such without a child, stay.
    """
    if online:
        return df
    children = df.where((F.col("source") == "dd") & (F.col("fold") == fold)).select("child_id").distinct()
    may = F.coalesce((F.col("source") == "ext") & (F.col("fold") == -1), F.lit(False))
    return df.where(~may).unionByName(df.where(may).join(children, "child_id", "left_anti"))


def presence(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of either side and whether each side has them."""
    return a.select(key, F.lit(True).alias("_a")).join(b.select(key, F.lit(True).alias("_b")), key, "full_outer").select(key, F.col("_a").isNotNull().alias("in_a"), F.col("_b").isNotNull().alias("in_b"))


def first_existing(candidates: list[Column], listing: DataFrame, df: DataFrame) -> DataFrame:
    """Adds ``path``: the first of the candidate paths that the listing holds; one join with the listing for each."""
    paths = listing.select("path").distinct()
    out = df.withColumns({f"_c{i}": c for i, c in enumerate(candidates)})
    for i in range(len(candidates)):
        out = out.join(paths.select(F.col("path").alias(f"_p{i}")), F.col(f"_c{i}") == F.col(f"_p{i}"), "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(*[f"_p{i}" for i in range(len(candidates))]).alias("path"))

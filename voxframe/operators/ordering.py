"""Global numbers, running sums and exact draws without a task or driver that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.sources.workdir import materialise


def _starts(ranged: DataFrame, value: Column, kind: str) -> Column:
    """By a row's ``_part``: the sum of a value over the ranges before. The driver sees one number per range."""
    begin, before = {}, 0
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy("_part").agg(F.sum(value)).collect()):
        begin[p], before = before, before + (n or 0)
    if not begin:
        return F.lit(0).cast(kind)
    return F.create_map(*[F.lit(x) for kv in begin.items() for x in kv])[F.col("_part")].cast(kind)


def numbered(df: DataFrame, order: list, name: str = "place", first: int = 1) -> DataFrame:
    """Adds a row's number in the global order: rows are sorted by range and stored, and numbered range by range."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialise(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranges")
    k = F.row_number().over(W.partitionBy("_part").orderBy(*cols))
    return ranged.withColumn(name, _starts(ranged, F.lit(1), "long") + k + (first - 1)).drop("_part")


def running(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the sum of a value over all rows up to and with this one in the global order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialise(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()), "ranges")
    kind = "double" if df.schema[value].dataType.typeName() in ("double", "float") else "long"
    so_far = F.sum(value).over(W.partitionBy("_part").orderBy(*cols).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, _starts(ranged, F.col(value), kind) + so_far).drop("_part")


def smallest(df: DataFrame, digest: Column, key: str, n: int) -> DataFrame:
    """The n rows of smallest digest (a hash in hexadecimal), then key; all rows if there are fewer.

    The rows are counted by the digest's first four digits, so only those of one such bin are sorted under a limit.
    """
    head = F.substring(digest, 1, 4)
    room, edge = n, None
    for v, c in sorted((r[0], r[1]) for r in df.groupBy(head.alias("v")).count().collect()):
        if c > room:
            edge = v
            break
        room -= c
    if edge is None:
        return df
    return df.where(head < edge).unionAll(df.where(head == edge).orderBy(digest, key).limit(room))


def quantiles(df: DataFrame, value: str, probs: list[float], group: tuple[str, ...] = ()) -> DataFrame:
    """(*group, q): exact quantiles of the non-null values, between neighbours in proportion, one array per group.

    Values are numbered by ranges of (group, value) and only those at the places asked for are looked up, so neither a
    group's values nor its distinct ones are gathered anywhere. Null groups are left out; no values give no row.
    """
    keys = list(group)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    for c in keys:
        rows = rows.where(F.col(c).isNotNull())
    placed = materialise(numbered(rows, [*keys, "_v"], "_place", first=0), "placed")
    sizes = placed.groupBy(*keys).agg(F.min("_place").alias("_from"), F.count("*").alias("_n")).where("_n > 0")
    at = [F.struct(F.lit(k).alias("k"), ((F.col("_n") - 1) * F.lit(float(p))).alias("at")) for k, p in enumerate(probs)]
    asked = sizes.select(*keys, "_from", F.explode(F.array(*at)).alias("x")).select(*keys, "_from", "x.*")
    low, part = F.floor("at"), F.col("at") - F.floor("at")
    ends = F.explode(F.array(F.struct(low.alias("o"), (1.0 - part).alias("w")), F.struct(F.ceil("at").alias("o"), part.alias("w"))))
    asked = asked.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(keys)], "k", "_from", ends.alias("x")).where("x.w > 0").select(*[f"_g{i}" for i in range(len(keys))], "k", (F.col("_from") + F.col("x.o")).alias("_at"), "x.w")
    found = asked.join(placed.select("_place", "_v"), F.col("_at") == F.col("_place"))
    each = found.groupBy(*[f"_g{i}" for i in range(len(keys))], "k").agg(F.sum(F.col("_v") * F.col("w")).alias("q"))
    out = each.groupBy(*[f"_g{i}" for i in range(len(keys))]).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "q"))), lambda x: x["q"]).alias("q"))
    return out.select(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(keys)], "q")


def quantiles_of(df: DataFrame, value: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of all values; None where there are none."""
    got = quantiles(df, value, probs).collect()
    return list(got[0]["q"]) if got and got[0]["q"] else [None] * len(probs)

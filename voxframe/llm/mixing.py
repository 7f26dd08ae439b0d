"""Mixing sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxframe.llm.common import WORD, cut, small


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 by code point, null last, to one row per source.

    Sorted by range, so no task holds all sources; the driver sees one count per partition.
    """
    put = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("_p")))
    starts, total = {}, 0
    for p, n in sorted((r[0], r[1]) for r in put.groupBy("_p").count().collect()):
        starts[p], total = total, total + n
    if not starts:
        return put.select("source", "source_size", F.lit(0).alias("rank"))
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return put.select("source", "source_size", (start[F.col("_p")] + F.row_number().over(W.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with ``target``: ``budget`` times all sizes shared by weight, no target above ``most`` times its source.

    What a full source can't take is reshared by weight among the others until none is above: each round is one sum
    over the sources and raises the words a unit of weight gets, so it ends. Targets are rounded to 6 decimals.
    """
    table = cut(ranked_sources(sizes).select("source", F.col("source_size").cast("long"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank").cast("int") % len(weights) + 1).alias("_w")).withColumn("_most", F.col("source_size") * F.lit(float(most))))
    level = -1.0
    while True:
        full = F.col("_w") * F.lit(level) > F.col("_most") if level >= 0 else F.lit(False)
        r = table.agg(F.sum("source_size"), F.sum(F.when(full, F.col("_most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if not r[0] or not r[2]:
            break
        new = (budget * r[0] - r[1]) / r[2]
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.round(F.least(F.col("_most"), F.col("_w") * F.lit(max(level, 0.0))), 6).alias("target"))


def copies(id_col: Column, rate: Column, seed: str) -> Column:
    """floor(rate) copies and one more with the probability of the fraction, decided by a hash of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    unit = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    return (F.floor(rate) + F.when(unit < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """A struct ``row`` of all columns, with ``size``, ``source_size``, ``target`` and ``n_copies``.

    Null text has size 0; a null source is a source of its own, ranked last; a source without words has target 0. Ids
    decide the extra copy, so rows that repeat an id share its luck and a null id is the text 'null'. Reruns agree.
    An empty table gives no rows; other columns may have any name. Texts are not shuffled: per-source sums are
    combined before the shuffle, and the table of sources is broadcast if it is counted as short.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), size.alias("size"))
    sizes = docs.select(F.col(source_col).alias("source"), size.alias("_n")).groupBy("source").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sizes, weights, budget, most).withColumnRenamed("source", "_t")
    out = rows.join(small(targets), F.col("_s").eqNullSafe(F.col("_t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("row", "size", "source_size", "target", copies(F.col("_id"), rate, seed).alias("n_copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with ``copy`` from 1 in place of any column of that name."""
    out = with_copies(docs, **options).where(F.col("n_copies") > 0)
    out = out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))).alias("copy"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() != "copy"], "copy")


def mix_report(docs: DataFrame) -> DataFrame:
    """The digest of op1: doc_id, size, source_size, target, taken, and the source."""
    out = with_copies(docs.select("doc_id", "source", "text"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "row.source")

"""Leak-free splits and reproducible samples. Draws are decided by hashes of keys, so they don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators.ordering import numbered, running
from voxframe.sources.workdir import materialise


def hashed(key: Column | str, seed: str) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))


def rounds(loads: list[int], size: int, n: int) -> tuple[list[tuple[int, list[int]]], list[int]]:
    """How n groups of one size go, each to the smallest fold (the lower number of ties), without walking them.

    A fold takes its j-th group when its load has grown by j sizes, so the turns are the sorted values load + j * size:
    in round t those folds take part whose load is below (t + 1) sizes, by what their load leaves over. Gives (first
    rank, folds in turn) of each stretch with the same folds, and the new loads.
    """
    full = [x // size for x in loads]
    turn = sorted(range(len(loads)), key=lambda f: (loads[f] % size, f))
    starts = sorted(set(full))
    out, at, loads = [], 0, list(loads)
    for i, t in enumerate(starts):
        if at >= n:
            break
        folds = [f for f in turn if full[f] <= t]
        room = (starts[i + 1] - t) * len(folds) if i + 1 < len(starts) else n - at
        take = min(room, n - at)
        out.append((at, folds))
        for k, f in enumerate(folds):
            loads[f] += size * (take // len(folds) + (k < take % len(folds)))
        at += take
    return out, loads


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds ``fold``: groups whole, largest first, each to the smallest fold so far (ties: the group's order, the lower fold).

    Groups of one size go in rounds, so the driver sees one row per size, never one per group; groups are numbered by
    ranges of (size, group), and a group's fold follows from its place among those of its size. Null groups have no fold.
    """
    spark = df.sparkSession
    sizes = materialise(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")), "sizes")
    loads, before, rows = [0] * k, 0, []
    for n, many in sorted(((r[0], r[1]) for r in sizes.groupBy("n").count().collect()), reverse=True):
        stretches, loads = rounds(loads, n, many)
        rows += [(n, before, a, b, folds) for (a, folds), b in zip(stretches, [*[x for x, _ in stretches[1:]], many], strict=True)]
        before += many
    turns = spark.createDataFrame(rows, "n long, _before long, _a long, _b long, _folds array<int>")
    place = F.col("_place") - F.col("_before")
    at = numbered(sizes, [F.desc("n"), group], "_place", first=0).join(turns, "n").where((place >= F.col("_a")) & (place < F.col("_b")))
    folds = at.select(group, F.get("_folds", F.pmod(place - F.col("_a"), F.size("_folds")).cast("int")).alias("fold"))
    return df.join(folds, group, "left")


def strata_walk(rows, total: list[int], k: int):
    """Where groups of equal counts go, one (counts, how many) after another: (stretches, ...) as ``rounds`` gives them.

    A group goes where it leaves the mean deviation of the folds' shares least (then to the smallest fold, then the lower
    number). Once each fold has taken one of equal groups in turn, the folds differ as they did before, so the same turn
    goes on: only what comes before that is walked.
    """
    import numpy as np

    size = np.maximum(np.array(total, float), 1.0)
    folds = np.zeros((k, len(total)), np.int64)
    for counts, many in rows:
        counts = np.array(counts, np.int64)
        turn: list[int] = []
        while len(turn) < many and (len(turn) < k or len(set(turn[-k:])) < k):
            after = [folds + counts * (np.arange(k) == f)[:, None] for f in range(k)]
            f = min(range(k), key=lambda f: (round(float((after[f] / size).std(0).mean()), 12), int(after[f][f].sum()), f))
            folds = after[f]
            turn.append(f)
        more = many - len(turn)
        out = [(0, turn)]
        if more > 0:
            out = [(0, turn[:-k]), (len(turn) - k, turn[-k:])] if len(turn) > k else [(0, turn)]
            for i, f in enumerate(turn[-k:]):
                folds[f] += counts * (more // k + (i < more % k))
        yield [x for x in out if x[1]]


def stratified_group_kfold(df: DataFrame, group: str, stratum: str, k: int) -> DataFrame:
    """Adds ``fold``: groups whole, strata spread evenly: each group goes where it leaves the counts most even.

    Groups are taken by falling deviation of their counts by stratum, then by the counts, then by the group's order. All
    groups of equal counts are one step: a task and the driver see a row for each different vector of counts, in order,
    never one for each group; a group's fold follows from its place among those of equal counts, which are numbered by
    ranges. Null groups have no fold; a null stratum is one of its own.
    """
    strata = sorted((r[0] for r in df.select(stratum).distinct().collect()), key=lambda x: (x is not None, str(x)))
    cells = [F.count_if(F.col(stratum).eqNullSafe(F.lit(x))) for x in strata]
    counts = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.array(*cells).alias("_v") if cells else F.array().cast("array<long>").alias("_v"))
    n = max(1, len(strata))
    mean = F.aggregate("_v", F.lit(0).cast("long"), lambda a, x: a + x) / n
    spread = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    counts = materialise(counts.withColumn("_far", F.round(spread, 6)), "strata")
    kinds = counts.groupBy("_far", "_v").agg(F.count("*").alias("_many")).orderBy(F.desc("_far"), "_v")
    total = [sum(x) for x in zip(*(r[0] for r in counts.agg(F.array(*[F.sum(F.get("_v", F.lit(i))) for i in range(len(strata))]).alias("t")).collect() if r[0] and r[0][0] is not None), strict=True)]
    vectors, turns, before = ((r["_v"], r["_many"], r["_far"]) for r in kinds.toLocalIterator()), [], 0
    mine = list(vectors)
    for (v, many, _), stretches in zip(mine, strata_walk(((v, m) for v, m, _ in mine), total, k), strict=True):
        ends = [*[a for a, _ in stretches[1:]], many]
        turns += [(v, before, a, b, folds) for (a, folds), b in zip(stretches, ends, strict=True)]
        before += many
    turns = df.sparkSession.createDataFrame(turns, "_v array<long>, _before long, _a long, _b long, _folds array<int>")
    place = F.col("_place") - F.col("_before")
    at = numbered(counts, [F.desc("_far"), "_v", group], "_place", first=0).join(turns, "_v").where((place >= F.col("_a")) & (place < F.col("_b")))
    folds = at.select(group, F.get("_folds", F.pmod(place - F.col("_a"), F.size("_folds")).cast("int")).alias("fold"))
    return df.join(folds, group, "left")


def group_shuffle_folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """Adds ``fold`` by a hash of the group: disjoint by construction and without a global order."""
    return df.withColumn("fold", F.pmod(F.conv(F.substring(hashed(group, seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def align_folds(df: DataFrame, child_folds: DataFrame) -> DataFrame:
    """A child's fold in the map wins over the row's own."""
    return df.join(child_folds.withColumnRenamed("fold", "_map"), "child_id", "left").withColumn("fold", F.coalesce("_map", "fold")).drop("_map")


def stratified_sample(df: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """About ``total`` rows, the same number from each stratum: those of smallest hash.

    The share of a stratum is known before the rows are ranked, so each task sends on no more of a stratum than that.
    """
    each = max(1, total // max(1, df.select(stratum).distinct().count()))
    k = F.row_number().over(W.partitionBy(stratum).orderBy(hashed(key, seed), key))
    return df.withColumn("_k", k).where(F.col("_k") <= each).drop("_k")


#: Parts of the unit interval by which draws meet the groups whose shares lie there.
PARTS = 4096


def temperature_draw(df: DataFrame, group: str, key: str, n: int, alpha: float, seed: str) -> DataFrame:
    """``n`` draws with replacement, a group's share being size to the power alpha, rows of a group alike.

    Draw i has a point in [0, 1) from a hash; the group whose cumulative share holds it is found by the part of the
    interval that the point lies in, and the row in it by the point's place within the group. Rows are numbered by
    ranges of (group, key), so a group of very many rows is no one task's.
    """
    spark = df.sparkSession
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("size"))
    g = running(g.withColumn("p", F.pow("size", F.lit(alpha))), [group], "p", "hi")
    g = running(g, [group], "size", "_rows")
    whole = g.agg(F.max("hi")).first()[0] or 1.0
    # a group begins exactly where the one before it ends, so no draw falls between two or to both
    g = materialise(numbered(g, [group], "_n"), "shares")
    before = g.select((F.col("_n") + 1).alias("_n"), F.col("hi").alias("_lo"))
    g = g.join(before, "_n", "left").withColumn("lo", F.coalesce("_lo", F.lit(0.0)))
    g = g.select(group, "size", (F.col("_rows") - F.col("size")).alias("_first"), (F.col("lo") / whole).alias("lo"), (F.col("hi") / whole).alias("hi"))
    last = F.lit(PARTS - 1)
    g = g.withColumn("_part", F.explode(F.sequence(F.least(F.floor(F.col("lo") * PARTS).cast("int"), last), F.least(F.floor(F.col("hi") * PARTS).cast("int"), last))))
    unit = F.conv(F.substring(hashed("draw", seed), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("u", unit).withColumn("_part", F.floor(F.col("u") * PARTS).cast("int"))
    at = draws.join(g, "_part").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    inside = F.least(F.floor((F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("size")), F.col("size") - 1)
    at = at.select("draw", (F.col("_first") + inside + 1).cast("long").alias("_place"))
    rows = numbered(df.select(group, key).where(F.col(group).isNotNull()), [group, key], "_place")
    return at.join(rows, "_place").select("draw", group, key)


def cycle_window(df: DataFrame, key: str, epoch: int, size: int, seed: str) -> DataFrame:
    """The rows of one epoch's window over a permutation of the rows: windows follow each other and wrap around it.

    A cycle has its own permutation, and all its rows come once before the next begins. Rows are numbered by ranges.
    """
    n = df.count()
    start = epoch * size
    cycle, lo = (start // n, start % n) if n else (0, 0)
    rows = numbered(df.select(key, hashed(key, f"{seed}{cycle}").alias("_h")), ["_h", key], "place", first=0).drop("_h")
    inside = (F.col("place") >= lo) & (F.col("place") < lo + size) | (F.col("place") < lo + size - n)
    return rows.where(inside)

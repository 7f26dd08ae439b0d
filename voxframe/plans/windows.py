"""Window features over the candidates of an utterance."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators import ranking
from voxframe.plans.registered import query
from voxframe.plans.tables import C, U, candidates, table, utterances

NULLED = f"{C}, n AS (SELECT uid, idx, CASE WHEN idx % 3 <> 1 THEN s0 END AS v FROM c)"


def nulled(spark, d):
    return candidates(spark, d).select("uid", "idx", F.when(F.col("idx") % 3 != 1, F.col("s0")).alias("v"))


@query(f"WITH {NULLED} SELECT uid, idx, CASE WHEN v IS NOT NULL THEN CAST(rank() OVER (PARTITION BY uid ORDER BY v DESC NULLS LAST) AS INTEGER) END AS r FROM n")
def win_rank_min_desc(spark, d):
    return nulled(spark, d).select("uid", "idx", ranking.rank_min("v").alias("r"))


@query(f"WITH {NULLED} SELECT uid, idx, CASE WHEN v IS NOT NULL THEN CAST(rank() OVER (PARTITION BY uid ORDER BY v NULLS LAST) AS INTEGER) END AS r FROM n")
def win_rank_min_asc(spark, d):
    return nulled(spark, d).select("uid", "idx", ranking.rank_min("v", desc=False).alias("r"))


@query(f"WITH {NULLED} SELECT uid, idx, CAST(rank() OVER (PARTITION BY uid ORDER BY v DESC NULLS LAST) AS INTEGER) AS r FROM n")
def win_rank_na_bottom(spark, d):
    return nulled(spark, d).select("uid", "idx", ranking.rank_na_bottom("v").alias("r"))


@query(f"WITH {NULLED} SELECT uid, idx, CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY uid ORDER BY v NULLS LAST) + (count(v) OVER (PARTITION BY uid, v) - 1) / 2.0::DOUBLE) / count(v) OVER (PARTITION BY uid) END AS r FROM n")
def win_rank_pct(spark, d):
    return nulled(spark, d).select("uid", "idx", ranking.rank_pct("v").alias("r"))


@query(f"WITH {C} SELECT uid, idx, CASE WHEN count(*) OVER w > 1 THEN round((s0 - avg(s0) OVER w) / greatest(stddev_samp(s0) OVER w, 1e-8), 6) END AS z FROM c WINDOW w AS (PARTITION BY uid)")
def win_zscore(spark, d):
    return candidates(spark, d).select("uid", "idx", F.round(ranking.zscore("s0"), 6).alias("z"))


@query(f"WITH {C} SELECT uid, idx, round((s1 - avg(s1) OVER w) / nullif(stddev_samp(s1) OVER w, 0), 6) AS z FROM c WINDOW w AS (PARTITION BY uid)")
def win_zscore_nullzero(spark, d):
    return candidates(spark, d).select("uid", "idx", F.round(ranking.zscore_nullzero("s1"), 6).alias("z"))


@query(f"WITH {C} SELECT uid, idx, round(s0 - max(s0) OVER w, 7) AS d_best, round(s0 - min(s0) OVER w, 7) AS d_min, round(s0 - avg(s0) OVER w, 7) AS d_mean, round(s0 - median(s0) OVER w, 7) AS d_median FROM c WINDOW w AS (PARTITION BY uid)")
def win_diff_best(spark, d):
    w = ranking.group()
    return candidates(spark, d).select("uid", "idx", *[F.round(F.col("s0") - f("s0").over(w), 7).alias(f"d_{n}") for n, f in (("best", F.max), ("min", F.min), ("mean", F.avg), ("median", F.median))])


@query(f"WITH {C} SELECT uid, idx, round((s0 - min(s0) OVER w) / greatest(max(s0) OVER w - min(s0) OVER w, 1e-8), 6) AS v FROM c WINDOW w AS (PARTITION BY uid)")
def win_minmax_norm(spark, d):
    return candidates(spark, d).select("uid", "idx", F.round(ranking.minmax("s0"), 6).alias("v"))


SECOND = f"{C}, k AS (SELECT uid, idx, s1, row_number() OVER (PARTITION BY uid ORDER BY s1 DESC) AS k FROM c), g AS (SELECT uid, max(s1) AS best, coalesce(max(CASE WHEN k = 2 THEN s1 END), max(s1)) AS second FROM k GROUP BY 1)"


@query(f"WITH {SECOND} SELECT c.uid, c.idx, g.second FROM c JOIN g USING (uid)")
def win_second_best(spark, d):
    return candidates(spark, d).select("uid", "idx", ranking.second_best("s1").alias("second"))


@query(f"WITH {SECOND} SELECT uid, best - second AS margin FROM g")
def win_margin(spark, d):
    # two largest values per group, kept by a bounded aggregate
    c = candidates(spark, d).select("uid", "s1", F.row_number().over(ranking.group().orderBy(F.desc("s1"))).alias("k")).where("k <= 2")
    return c.groupBy("uid").agg((F.max("s1") - F.min("s1")).alias("margin"))


@query(f"WITH {C} SELECT uid, idx, count(*) OVER (PARTITION BY uid) AS n FROM c")
def win_count(spark, d):
    return candidates(spark, d).select("uid", "idx", F.count("*").over(ranking.group()).alias("n"))


RANKS = "r AS (SELECT uid, idx, CAST(rank() OVER (PARTITION BY uid ORDER BY s0 DESC) AS INTEGER) - 1 AS r0, CAST(rank() OVER (PARTITION BY uid ORDER BY s1 DESC) AS INTEGER) - 1 AS r1, CAST(rank() OVER (PARTITION BY uid ORDER BY s2 DESC) AS INTEGER) - 1 AS r2 FROM c)"


def model_ranks(spark, d):
    return candidates(spark, d).select("uid", "idx", "s0", "s1", "s2", *[(ranking.rank_min(f"s{m}") - 1).alias(f"r{m}") for m in range(3)])


@query(f"WITH {C}, {RANKS} SELECT uid, idx, CAST(r0 = 0 AS INTEGER) AS best_0, CAST(r1 = 0 AS INTEGER) AS best_1, CAST(r2 = 0 AS INTEGER) AS best_2, CAST(r0 = 0 AS INTEGER) + CAST(r1 = 0 AS INTEGER) + CAST(r2 = 0 AS INTEGER) AS n_best FROM r")
def win_is_best(spark, d):
    flags = [(F.col(f"r{m}") == 0).cast("int") for m in range(3)]
    return model_ranks(spark, d).select("uid", "idx", *[f.alias(f"best_{m}") for m, f in enumerate(flags)], (flags[0] + flags[1] + flags[2]).alias("n_best"))


@query(f"WITH {C}, {RANKS} SELECT uid, idx, (r0 + r1 + r2) / 3.0::DOUBLE AS mean_rank, least(r0, r1, r2) AS min_rank, greatest(r0, r1, r2) AS max_rank FROM r")
def win_row_stats(spark, d):
    r = ["r0", "r1", "r2"]
    return model_ranks(spark, d).select("uid", "idx", ((F.col("r0") + F.col("r1") + F.col("r2")) / 3.0).alias("mean_rank"), F.least(*r).alias("min_rank"), F.greatest(*r).alias("max_rank"))


@query(f"WITH {C} SELECT uid, count(*) AS size FROM c GROUP BY 1")
def win_group_sizes(spark, d):
    return candidates(spark, d).groupBy("uid").agg(F.count("*").alias("size"))


#: Models by family: the one looked at, and all others.
FAMILIES = {"family": (0, 1), "rest": (2,)}


def _family_sql() -> str:
    w = "OVER (PARTITION BY uid)"
    first, then = [], []
    for name, models in FAMILIES.items():
        mean = f"(({' + '.join(f's{m}' for m in models)}) / {len(models)}.0::DOUBLE)"
        top = f"greatest({', '.join(f's{m}' for m in models)})"
        std = f"sqrt(({' + '.join(f'(s{m} - {mean}) * (s{m} - {mean})' for m in models)}) / {len(models)}.0::DOUBLE)"
        votes = " + ".join(f"CAST(r{m} = 0 AS INTEGER)" for m in models)
        first.append(f"{mean} AS {name}_mean, {std} AS {name}_std, {top} AS {name}_max, {votes} AS {name}_votes")
        for v in ("mean", "max"):
            c = f"{name}_{v}"
            then.append(f"round({c}, 8) AS {c}, CAST(rank() OVER (PARTITION BY uid ORDER BY {c} DESC) AS INTEGER) AS {c}_rank, round({c} - max({c}) {w}, 8) AS {c}_diff, round(CASE WHEN stddev_samp({c}) {w} > 0 THEN ({c} - avg({c}) {w}) / stddev_samp({c}) {w} ELSE 0.0 END, 6) + 0.0 AS {c}_z")
        c = f"{name}_votes"
        is_top = f"{c} > 0 AND {c} = max({c}) {w}"
        second = f"coalesce(list_sort(list({c}) {w}, 'DESC')[2], max({c}) {w})"
        then.append(f"round({name}_std, 8) AS {name}_std, {c}, CAST({is_top} AS INTEGER) AS {c}_top, CASE WHEN {is_top} THEN {c} - {second} ELSE 0 END AS {c}_margin")
    gaps = ", ".join(f"round(family_{v} - rest_{v}, 8) AS {v}_gap" for v in ("mean", "max", "votes"))
    return f"WITH {C}, {RANKS}, f AS (SELECT r.uid, r.idx, {', '.join(first)} FROM r JOIN c ON c.uid = r.uid AND c.idx = r.idx) SELECT uid, idx, {', '.join(then)}, {gaps} FROM f"


@query(_family_sql())
def win_family_subset(spark, d):
    """A family of models and all others, side by side: mean, deviation and best of their scores, ranks, distances and
    z-scores within the group (0 where there is none), votes for a model's best, their lead over the second where they
    are the most; and the family less the others."""
    f, w, out = model_ranks(spark, d), ranking.group(), []
    for name, models in FAMILIES.items():
        n = float(len(models))
        mean = sum((F.col(f"s{m}") for m in models), F.lit(0.0)) / n
        top = F.greatest(*[F.col(f"s{m}") for m in models]) if len(models) > 1 else F.col(f"s{models[0]}")
        f = f.withColumns({f"{name}_mean": mean, f"{name}_max": top, f"{name}_votes": sum(((F.col(f"r{m}") == 0).cast("int") for m in models), F.lit(0))})
        f = f.withColumn(f"{name}_std", F.sqrt(sum(((F.col(f"s{m}") - F.col(f"{name}_mean")) ** 2 for m in models), F.lit(0.0)) / n))
        for v in ("mean", "max"):
            c = f"{name}_{v}"
            std = F.stddev_samp(c).over(w)
            z = F.when(std > 0, (F.col(c) - F.avg(c).over(w)) / std).otherwise(0.0)
            out += [F.round(c, 8).alias(c), F.rank().over(w.orderBy(F.desc(c))).alias(f"{c}_rank"), F.round(F.col(c) - F.max(c).over(w), 8).alias(f"{c}_diff"), (F.round(z, 6) + 0.0).alias(f"{c}_z")]
        c = f"{name}_votes"
        is_top = (F.col(c) > 0) & (F.col(c) == F.max(c).over(w))
        out += [F.round(f"{name}_std", 8).alias(f"{name}_std"), F.col(c), is_top.cast("int").alias(f"{c}_top"), F.when(is_top, F.col(c) - ranking.second_best(c)).otherwise(0).alias(f"{c}_margin")]
    gaps = [F.round(F.col(f"family_{v}") - F.col(f"rest_{v}"), 8).alias(f"{v}_gap") for v in ("mean", "max", "votes")]
    return f.select("uid", "idx", *out, *gaps)


@query("SELECT l_shipdate, l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def win_first_per_group(spark, d):
    line = table(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_partkey", "l_suppkey")
    return ranking.first_in_group(line, ["l_orderkey", "l_partkey", "l_suppkey"], ("l_shipdate",)).drop("l_suppkey")


@query(f"WITH {U} SELECT utterance_id, coalesce(sum(length(text)) OVER (PARTITION BY session_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM u")
def win_cumsum_offsets(spark, d):
    w = W.partitionBy("session_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return utterances(spark, d).select("utterance_id", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("at"))


SPANS = f"{U}, s AS (SELECT session_id, CAST(ord * 4 AS DOUBLE) AS lo, ord * 4 + duration AS hi FROM u)"


@query(f"WITH {SPANS}, e AS (SELECT session_id, lo AS t, 1 AS d FROM s UNION ALL SELECT session_id, hi, -1 FROM s), r AS (SELECT *, sum(d) OVER w AS active, lead(t) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY session_id ORDER BY t, d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT session_id, round(sum(CASE WHEN active >= 2 THEN nxt - t ELSE 0 END), 6) AS overlap FROM r GROUP BY 1")
def win_sweep_overlap(spark, d):
    u = utterances(spark, d).select("session_id", (F.col("ord") * 4).cast("double").alias("lo"), (F.col("ord") * 4 + F.col("duration")).alias("hi"))
    events = u.select("session_id", F.explode(F.array(F.struct(F.col("lo").alias("t"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("t"), F.lit(-1).alias("d")))).alias("e")).select("session_id", "e.*")
    w = W.partitionBy("session_id").orderBy("t", F.desc("d"))
    active = F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))
    return events.select("session_id", F.when(active >= 2, F.lead("t").over(w) - F.col("t")).otherwise(0.0).alias("x")).groupBy("session_id").agg(F.round(F.sum("x"), 6).alias("overlap"))


@query(f"WITH {U}, r AS (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY duration DESC, utterance_id) AS k FROM u) SELECT utterance_id, CAST((k - 1) // 4 AS BIGINT) AS bucket, CAST(row_number() OVER (PARTITION BY child_id, (k - 1) // 4 ORDER BY md5(utterance_id)) AS INTEGER) AS place FROM r")
def win_shuffle_bucket(spark, d):
    u = utterances(spark, d).withColumn("bucket", F.floor((F.row_number().over(W.partitionBy("child_id").orderBy(F.desc("duration"), "utterance_id")) - 1) / 4))
    return u.select("utterance_id", "bucket", F.row_number().over(W.partitionBy("child_id", "bucket").orderBy(F.md5(F.col("utterance_id").cast("binary")))).alias("place"))


@query(f"WITH {C}, {RANKS}, x AS (SELECT c.*, r.r0, r.r1, r.r2 FROM c JOIN r USING (uid, idx)), g AS (SELECT *, count(*) OVER w AS n, avg(s0) OVER w AS mean0, stddev_samp(s0) OVER w AS sd0, max(s0) OVER w AS max0, min(s0) OVER w AS min0, median(s0) OVER w AS med0, avg(s1) OVER w AS mean1, max(s1) OVER w AS max1 FROM x WINDOW w AS (PARTITION BY uid)) SELECT uid, idx, n, r0, r1, r2, round((r0 + r1 + r2) / 3.0::DOUBLE, 6) AS mean_rank, round(CASE WHEN n > 1 THEN (s0 - mean0) / greatest(sd0, 1e-8) END, 6) AS z0, round(s0 - max0, 4) AS to_best0, round(s0 - med0, 4) AS to_median0, round((s0 - min0) / greatest(max0 - min0, 1e-8), 6) AS norm0, round(s1 - mean1, 6) AS to_mean1, round(s1 - max1, 6) AS to_best1 FROM g")
def rerank_features(spark, d):
    """The headline: the block of group-relative features of a candidate in one pass over one partitioning."""
    w = ranking.group()
    return model_ranks(spark, d).select(
        "uid", "idx", F.count("*").over(w).alias("n"), "r0", "r1", "r2", F.round((F.col("r0") + F.col("r1") + F.col("r2")) / 3.0, 6).alias("mean_rank"), F.round(ranking.zscore("s0"), 6).alias("z0"),
        F.round(F.col("s0") - F.max("s0").over(w), 4).alias("to_best0"), F.round(F.col("s0") - F.median("s0").over(w), 4).alias("to_median0"), F.round(ranking.minmax("s0"), 6).alias("norm0"),
        F.round(F.col("s1") - F.avg("s1").over(w), 6).alias("to_mean1"), F.round(F.col("s1") - F.max("s1").over(w), 6).alias("to_best1"),
    )

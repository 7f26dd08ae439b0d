"""Splits, samples, packs and batches."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators import packing, splits
from voxframe.operators.ordering import numbered, smallest
from voxframe.plans.registered import query
from voxframe.plans.tables import U, table, utterances


def walk(group, order, cost, budget, rule="sum + {c} > {b} AND size > 0", keep="sum + {c}"):
    """SQL of a fold with reset over u: (group, utterance_id, pack)."""
    c = cost
    over = rule.format(c=f"n.{c}", b=budget)
    kept = keep.format(c=f"n.{c}")
    return f"""{U.replace('u AS', 'u0 AS', 1)}, u AS (SELECT *, {group} AS g, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn FROM u0),
w(g, rn, utterance_id, sum, size, pack) AS (
  SELECT g, rn, utterance_id, {cost}, 1, CASE WHEN {rule.format(c=cost, b=budget).replace('sum', '0.0::DOUBLE').replace('size', '0')} THEN 1 ELSE 0 END FROM u WHERE rn = 1
  UNION ALL
  SELECT n.g, n.rn, n.utterance_id, CASE WHEN {over} THEN n.{c} ELSE {kept} END, CASE WHEN {over} THEN 1 ELSE w.size + 1 END, w.pack + CASE WHEN {over} THEN 1 ELSE 0 END FROM w JOIN u n ON n.g = w.g AND n.rn = w.rn + 1
)"""


@query(f"WITH RECURSIVE {walk('session_id', 'utterance_id', 'duration', 30)} SELECT substr(md5(child_id || '_' || u.session_id || '_' || pack), 1, 10) AS id, child_id, u.session_id, pack, count(*) AS n, round(sum(duration), 6) AS duration, string_agg(text, ' ' ORDER BY u.utterance_id) AS text, string_agg(u.utterance_id, ',' ORDER BY u.utterance_id) AS source_ids FROM w JOIN u ON u.utterance_id = w.utterance_id GROUP BY child_id, u.session_id, pack")
def win_session_pack(spark, d):
    return packing.pack_sessions(utterances(spark, d)).withColumn("duration", F.round("duration", 6))


BATCHES = "SELECT g AS child_id, utterance_id, pack FROM w"


def batches(spark, d, order, **options):
    u = utterances(spark, d).select("child_id", "utterance_id", "duration", (-F.col("duration")).alias("neg"))
    return packing.fold_groups(u, ["child_id"], order, "duration", **options).select("child_id", "utterance_id", "pack")


@query(f"WITH RECURSIVE {walk('child_id', 'duration, utterance_id', 'duration', 60)} {BATCHES}")
def batch_duration_asc(spark, d):
    return batches(spark, d, ["duration", "utterance_id"], budget=60.0)


BUCKETS = U.replace("u AS", "u1 AS", 1) + ", u0 AS (SELECT utterance_id, duration, md5('b:' || utterance_id) AS h, CAST((row_number() OVER (ORDER BY duration DESC, utterance_id) - 1) // 100 AS BIGINT) AS bucket FROM u1)"


@query(f"WITH RECURSIVE {walk('bucket', 'h, utterance_id', 'duration', 400).replace(U.replace('u AS', 'u0 AS', 1), BUCKETS)} SELECT g AS bucket, utterance_id, pack FROM w")
def batch_duration_bucket(spark, d):
    """Longest first over the whole set, cut into buckets of a hundred; each is shuffled and packed under a budget of seconds."""
    n = numbered(utterances(spark, d).select("utterance_id", "duration"), [F.desc("duration"), "utterance_id"], "k", first=0)
    n = n.select("utterance_id", "duration", splits.hashed("utterance_id", "b").alias("h"), F.floor(F.col("k") / 100).alias("bucket"))
    return packing.fold_groups(n, ["bucket"], ["h", "utterance_id"], "duration", budget=400.0).select("bucket", "utterance_id", "pack")


@query(f"WITH RECURSIVE {walk('child_id', 'utterance_id', 'duration', 100, 'greatest(sum, {c}) * (size + 1) > {b} AND size > 0', 'greatest(sum, {c})')} {BATCHES}")
def batch_dynamic(spark, d):
    return batches(spark, d, ["utterance_id"], budget=100.0, running_max=True)


@query(f"WITH RECURSIVE {walk('child_id', 'utterance_id', 'duration', 20, 'sum + {c} > {b}')} {BATCHES}")
def batch_secs(spark, d):
    return batches(spark, d, ["utterance_id"], budget=20.0, guard=False)


@query(f"WITH {U} SELECT utterance_id, CAST((row_number() OVER (ORDER BY duration DESC, utterance_id) - 1) // 40 AS BIGINT) AS bucket FROM u")
def batch_fixed_bucket(spark, d):
    """Buckets of ten batches of four, longest first over the whole set."""
    n = numbered(utterances(spark, d).select("utterance_id", "duration"), [F.desc("duration"), "utterance_id"], "k", first=0)
    return n.select("utterance_id", F.floor(F.col("k") / 40).alias("bucket"))


# ---- splits


GREEDY = f"""{U}, g AS (SELECT child_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, child_id) AS k FROM u GROUP BY 1),
  w(k, child_id, fold, loads) AS (
    SELECT k, child_id, 0, [n, 0, 0, 0, 0] FROM g WHERE k = 1
    UNION ALL SELECT g.k, g.child_id, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + g.n ELSE x END) FROM w JOIN g ON g.k = w.k + 1)"""


@query(f"WITH RECURSIVE {GREEDY} SELECT utterance_id, child_id, CAST(fold AS INTEGER) AS fold FROM u JOIN w USING (child_id)")
def split_group_kfold(spark, d):
    return splits.group_kfold(utterances(spark, d).select("utterance_id", "child_id"), "child_id", 5).select("utterance_id", "child_id", "fold")


STRATA = f"""{U}, n AS (SELECT child_id, list_transform((SELECT list_sort(list(DISTINCT age_bucket)) FROM u), lambda s: len(list_filter(list(age_bucket), lambda x: x = s))) AS v FROM u GROUP BY 1),
o AS (SELECT child_id, v, row_number() OVER (ORDER BY round(list_sum(list_transform(v, lambda x: (x - list_sum(v) / len(v)::DOUBLE) * (x - list_sum(v) / len(v)::DOUBLE))), 6) DESC, v, child_id) AS k FROM n),
z AS (SELECT list_transform(range(1, len(any_value(v)) + 1), lambda i: greatest(list_sum(list_transform(list(v), lambda x: x[i])), 1)::DOUBLE) AS total FROM n),
w(k, child_id, fold, held) AS (
  SELECT 0::BIGINT, '', 0::BIGINT, (SELECT list_transform(range(5), lambda f: list_transform(total, lambda x: 0::DOUBLE)) FROM z)
  UNION ALL
  SELECT k, child_id, best.f, list_transform(held, lambda h, i: CASE WHEN i = best.f + 1 THEN list_transform(h, lambda x, j: x + v[j]) ELSE h END) FROM (
    SELECT o.k, o.child_id, o.v, w.held, list_min(list_transform(range(5), lambda f: {{'s': round(list_avg(list_transform(range(1, len(total) + 1), lambda j: list_aggregate(list_transform(range(1, 6), lambda g: (w.held[g][j] + CASE WHEN g = f + 1 THEN o.v[j] ELSE 0 END) / total[j]), 'stddev_pop'))), 12), 'n': list_sum(w.held[f + 1]) + list_sum(o.v), 'f': f}})) AS best
    FROM w JOIN o ON o.k = w.k + 1, z)
)"""


@query(f"WITH RECURSIVE {STRATA} SELECT utterance_id, child_id, CAST(fold AS INTEGER) AS fold FROM u JOIN w USING (child_id)")
def split_strat_group(spark, d):
    return splits.stratified_group_kfold(utterances(spark, d).select("utterance_id", "child_id", "age_bucket"), "child_id", "age_bucket", 5).select("utterance_id", "child_id", "fold")


HASH8 = "CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


@query(f"WITH {U} SELECT utterance_id, CAST({HASH8.format(seed='s1', key='child_id')} % 5 AS INTEGER) AS fold FROM u")
def split_group_shuffle(spark, d):
    return splits.group_shuffle_folds(utterances(spark, d), "child_id", 5, "s1").select("utterance_id", "fold")


@query(f"WITH {U} SELECT utterance_id, CAST({HASH8.format(seed='s2', key='utterance_id')} % 5 AS INTEGER) AS fold FROM u")
def split_kfold_rows(spark, d):
    return splits.group_shuffle_folds(utterances(spark, d), "utterance_id", 5, "s2").select("utterance_id", "fold")


@query(f"WITH {U} SELECT utterance_id, CASE WHEN {HASH8.format(seed='s3', key='child_id')} % 10 = 0 THEN 'valid' ELSE 'train' END AS split FROM u")
def split_random_grouped(spark, d):
    folds = splits.group_shuffle_folds(utterances(spark, d), "child_id", 10, "s3")
    return folds.select("utterance_id", F.when(F.col("fold") == 0, "valid").otherwise("train").alias("split"))


@query(f"WITH {U}, k AS (SELECT child_id, row_number() OVER (ORDER BY child_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT child_id FROM u)) SELECT utterance_id, CASE WHEN k <= n // 10 * 9 THEN 'train' ELSE 'valid' END AS split FROM u JOIN k USING (child_id)")
def split_prefix_children(spark, d):
    """The first nine tenths of the sorted children; children are numbered by ranges."""
    u = utterances(spark, d).select("utterance_id", "child_id")
    k = numbered(u.select("child_id").distinct(), ["child_id"], "k")
    first = k.count() // 10 * 9
    return u.join(k, "child_id").select("utterance_id", F.when(F.col("k") <= first, "train").otherwise("valid").alias("split"))


@query(f"WITH {U} SELECT utterance_id, CASE WHEN {HASH8.format(seed='42', key='utterance_id')} / 4294967296.0::DOUBLE < 0.03 THEN 'eval' ELSE 'train' END AS split FROM u")
def split_ratio_shuffle(spark, d):
    unit = F.conv(F.substring(splits.hashed("utterance_id", "42"), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    return utterances(spark, d).select("utterance_id", F.when(unit < 0.03, "eval").otherwise("train").alias("split"))


@query(f"WITH {U} SELECT utterance_id FROM u WHERE {HASH8.format(seed='s5', key='utterance_id')} % 10 = 0")
def split_sample_tenth(spark, d):
    return splits.group_shuffle_folds(utterances(spark, d), "utterance_id", 10, "s5").where("fold = 0").select("utterance_id")


FOLDS = f"{U}, f AS (SELECT *, CASE WHEN ord = 7 THEN -1 ELSE session_id % 5 END AS fold FROM u)"


def folded(spark, d):
    return utterances(spark, d).withColumn("fold", F.when(F.col("ord") == 7, F.lit(-1).cast("long")).otherwise(F.col("session_id") % 5))


@query(f"WITH {FOLDS}, m AS (SELECT child_id, min(fold) AS own FROM f WHERE source = 'dd' AND fold >= 0 GROUP BY 1) SELECT utterance_id, CASE WHEN fold = -1 THEN -1 WHEN source = 'dd' THEN fold ELSE coalesce(own, fold) END AS fold FROM f LEFT JOIN m USING (child_id)")
def fold_semantics(spark, d):
    """Rows without a label stay -1; external rows take the fold of their child's competition rows, if any."""
    f = folded(spark, d)
    own = f.where("source = 'dd' AND fold >= 0").groupBy("child_id").agg(F.min("fold").alias("own"))
    return f.join(own, "child_id", "left").select("utterance_id", F.when(F.col("fold") == -1, F.lit(-1).cast("long")).when(F.col("source") == "dd", F.col("fold")).otherwise(F.coalesce("own", "fold")).alias("fold"))


@query(f"WITH {FOLDS} SELECT utterance_id, CASE child_id WHEN 'c1' THEN 4 WHEN 'c2' THEN 0 ELSE fold END AS fold FROM f")
def fold_align_override(spark, d):
    given = spark.createDataFrame([("c1", 4), ("c2", 0)], "child_id string, fold long")
    return splits.align_folds(folded(spark, d), given).select("utterance_id", "fold")


@query(f"WITH {FOLDS}, o AS (SELECT child_id FROM f GROUP BY 1 HAVING count(DISTINCT source) = 2) SELECT utterance_id, CASE WHEN fold = 2 AND child_id IN (SELECT child_id FROM o) AND ord % 5 <> 2 THEN -1 ELSE fold END AS fold FROM f")
def fold_cross_guard(spark, d):
    """Rows of the evaluated fold whose child is in both sources go to -1 unless the model was trained on the same fold."""
    f = folded(spark, d)
    both = f.groupBy("child_id").agg(F.count_distinct("source").alias("n")).where("n = 2").select("child_id", F.lit(True).alias("both"))
    return f.join(both, "child_id", "left").select("utterance_id", F.when((F.col("fold") == 2) & F.coalesce("both", F.lit(False)) & (F.col("ord") % 5 != 2), F.lit(-1).cast("long")).otherwise(F.col("fold")).alias("fold"))


@query(f"WITH {FOLDS}, v AS (SELECT DISTINCT child_id FROM f WHERE fold = 1 AND source = 'dd') SELECT utterance_id, CASE WHEN child_id IN (SELECT child_id FROM v) THEN 'valid' ELSE 'train' END AS split FROM f")
def word_split_by_children(spark, d):
    f = folded(spark, d)
    v = f.where("fold = 1 AND source = 'dd'").select("child_id", F.lit(True).alias("v")).distinct()
    return f.join(v, "child_id", "left").select("utterance_id", F.when(F.col("v"), "valid").otherwise("train").alias("split"))


EVAL = f"{FOLDS}, dd AS (SELECT utterance_id FROM f WHERE source = 'dd' AND fold = 1), x AS (SELECT utterance_id, row_number() OVER (ORDER BY md5('7:' || utterance_id), utterance_id) AS k FROM f WHERE source = 'ext' AND fold >= 0), e AS (SELECT utterance_id FROM dd UNION ALL SELECT utterance_id FROM x WHERE k <= (SELECT count(*) FROM dd))"


@query(f"WITH {EVAL} SELECT utterance_id, CASE WHEN utterance_id IN (SELECT utterance_id FROM e) THEN 'eval' ELSE 'train' END AS split FROM f")
def eval_set_compose(spark, d):
    """The competition's rows of one fold and a draw of as many external rows; the rest trains."""
    f = folded(spark, d)
    dd = f.where("source = 'dd' AND fold = 1").select("utterance_id")
    x = smallest(f.where("source = 'ext' AND fold >= 0").select("utterance_id"), splits.hashed("utterance_id", "7"), "utterance_id", dd.count())
    e = dd.unionAll(x).withColumn("split", F.lit("eval"))
    return f.join(e, "utterance_id", "left").select("utterance_id", F.coalesce("split", F.lit("train")).alias("split"))


@query(f"WITH {FOLDS} SELECT count(*) AS n_overlap FROM (SELECT child_id FROM f WHERE fold = 1 INTERSECT SELECT child_id FROM f WHERE fold <> 1)")
def overlap_check(spark, d):
    f = folded(spark, d)
    return f.where("fold = 1").select("child_id").intersect(f.where("fold <> 1").select("child_id")).agg(F.count("*").alias("n_overlap"))


PARTNER = f"{U}, s AS (SELECT a.utterance_id, b.utterance_id AS other, row_number() OVER (PARTITION BY a.utterance_id ORDER BY md5('9:' || b.utterance_id), b.utterance_id) AS k FROM u a JOIN u b ON a.session_id = b.session_id AND a.role = b.role AND a.utterance_id <> b.utterance_id), c AS (SELECT a.utterance_id, b.utterance_id AS other, row_number() OVER (PARTITION BY a.utterance_id ORDER BY md5('9:' || b.utterance_id), b.utterance_id) AS k FROM u a JOIN u b ON a.child_id = b.child_id AND a.role = b.role AND a.utterance_id <> b.utterance_id)"


@query(f"WITH {PARTNER} SELECT u.utterance_id, coalesce(s.other, c.other) AS partner FROM u LEFT JOIN s ON s.utterance_id = u.utterance_id AND s.k = 1 LEFT JOIN c ON c.utterance_id = u.utterance_id AND c.k = 1")
def partner_fallback(spark, d):
    """A partner of the same label type from the session, else from the child: the one of smallest hash but itself.

    The two smallest hashes of each group hold every row's partner, so no pairs are made.
    """
    u = utterances(spark, d).withColumn("h", splits.hashed("utterance_id", "9"))

    def nearest(key):
        k = F.row_number().over(W.partitionBy(key, "role").orderBy("h", "utterance_id"))
        two = u.select(key, "role", "h", "utterance_id", k.alias("k")).where("k <= 2").groupBy(key, "role")
        return two.agg(F.max(F.when(F.col("k") == 1, F.col("utterance_id"))).alias(f"{key}_1"), F.max(F.when(F.col("k") == 2, F.col("utterance_id"))).alias(f"{key}_2"))

    pick = lambda key: F.when(F.col(f"{key}_1") != F.col("utterance_id"), F.col(f"{key}_1")).otherwise(F.col(f"{key}_2"))
    out = u.join(nearest("session_id"), ["session_id", "role"]).join(nearest("child_id"), ["child_id", "role"])
    return out.select("utterance_id", F.coalesce(pick("session_id"), pick("child_id")).alias("partner"))


def _smallest_two(u, keys, name):
    """By group and label type the ids of the two smallest hashes, and by group how many rows it has."""
    k = F.row_number().over(W.partitionBy(*keys, "role").orderBy("h", "utterance_id"))
    two = u.select(*keys, "role", "h", "utterance_id", k.alias("k")).where("k <= 2").groupBy(*keys, "role")
    two = two.agg(F.max(F.when(F.col("k") == 1, F.col("utterance_id"))).alias(f"{name}_1"), F.max(F.when(F.col("k") == 2, F.col("utterance_id"))).alias(f"{name}_2"))
    if not keys:
        return two
    return two.join(u.groupBy(*keys).agg(F.count("*").alias(f"{name}_n")), keys)


def _partner_sql(where, name):
    return f"{name} AS (SELECT a.utterance_id, b.utterance_id AS other, row_number() OVER (PARTITION BY a.utterance_id ORDER BY md5('9:' || b.utterance_id), b.utterance_id) AS k FROM u a JOIN u b ON {where} AND a.role = b.role AND a.utterance_id <> b.utterance_id)"


STRATEGIES = {"session": "a.session_id = b.session_id", "child": "a.child_id = b.child_id", "age": "a.age_bucket = b.age_bucket", "source": "a.source = b.source", "other_source": "a.source <> b.source", "any_row": "TRUE"}
ALONE = "(SELECT count(*) FROM u x WHERE x.{c} = u.{c}) = 1"


@query(f"WITH {U}, {', '.join(_partner_sql(w, n) for n, w in STRATEGIES.items())} SELECT u.utterance_id, CASE WHEN {ALONE.format(c='session_id')} THEN child.other ELSE session.other END AS same_session, child.other AS same_child, CASE WHEN {ALONE.format(c='age_bucket')} THEN source.other ELSE age.other END AS same_age, source.other AS same_source, other_source.other AS cross_source, any_row.other AS any_row FROM u {' '.join(f'LEFT JOIN {n} ON {n}.utterance_id = u.utterance_id AND {n}.k = 1' for n in STRATEGIES)}")
def partner_strategies(spark, d):
    """A row's partner of its own label type under each strategy: the one of smallest hash but itself, if there is any.

    A session without other rows gives way to the child, an age without others to the source. The two smallest hashes of
    a group hold every row's partner, and those of the sources that of another source, so no pairs are made.
    """
    u = utterances(spark, d).withColumn("h", splits.hashed("utterance_id", "9"))
    out = u
    for name, keys in (("session", ["session_id"]), ("child", ["child_id"]), ("age", ["age_bucket"]), ("source", ["source"]), ("any_row", [])):
        out = out.join(_smallest_two(u, keys, name), [*keys, "role"], "left")
    # the smallest of each source, then by label type the two smallest sources
    firsts = u.groupBy("role", "source").agg(F.min(F.struct("h", "utterance_id")).alias("x")).groupBy("role").agg(F.slice(F.array_sort(F.collect_list(F.struct("x", "source"))), 1, 2).alias("_f"))
    out = out.join(firsts, "role", "left")
    pick = lambda n: F.when(F.col(f"{n}_1") != F.col("utterance_id"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_2"))
    far = F.filter("_f", lambda x: x["source"] != F.col("source"))
    return out.select(
        "utterance_id", F.when(F.col("session_n") == 1, pick("child")).otherwise(pick("session")).alias("same_session"), pick("child").alias("same_child"), F.when(F.col("age_n") == 1, pick("source")).otherwise(pick("age")).alias("same_age"), pick("source").alias("same_source"), F.get(far, F.lit(0))["x"]["utterance_id"].alias("cross_source"), pick("any_row").alias("any_row"),
    )


# ---- samples


@query(f"WITH {U}, x AS (SELECT utterance_id, row_number() OVER (ORDER BY md5('11:' || utterance_id), utterance_id) AS k FROM u WHERE source = 'ext') SELECT utterance_id FROM x WHERE k <= (SELECT count(*) FROM u WHERE source = 'dd')")
def sample_n_seed(spark, d):
    u = utterances(spark, d)
    n = u.where("source = 'dd'").count()
    return smallest(u.where("source = 'ext'").select("utterance_id"), splits.hashed("utterance_id", "11"), "utterance_id", n)


@query(f"WITH {U}, x AS (SELECT utterance_id, age_bucket, row_number() OVER (PARTITION BY age_bucket ORDER BY md5('13:' || utterance_id), utterance_id) AS k FROM u WHERE duration >= 5) SELECT utterance_id, age_bucket FROM x WHERE k <= greatest(1, 100 // (SELECT count(DISTINCT age_bucket) FROM u WHERE duration >= 5))")
def sample_stratified(spark, d):
    """As many utterances of five seconds or more from each age."""
    u = utterances(spark, d).where("duration >= 5").select("utterance_id", "age_bucket")
    return splits.stratified_sample(u, "age_bucket", "utterance_id", 100, "13")


@query("WITH g AS (SELECT lang, count(*) AS size FROM documents WHERE lang IS NOT NULL GROUP BY 1), h AS (SELECT lang, size, sum(sqrt(size)) OVER (ORDER BY lang) / (SELECT sum(sqrt(size)) FROM g) AS hi, (sum(sqrt(size)) OVER (ORDER BY lang) - sqrt(size)) / (SELECT sum(sqrt(size)) FROM g) AS lo FROM g), d AS (SELECT draw, CAST('0x' || substr(md5('17:' || draw), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM range(1000) r(draw)), a AS (SELECT draw, lang, least(CAST(floor((u - lo) / (hi - lo) * size) AS BIGINT), size - 1) + 1 AS place FROM d JOIN h ON u >= lo AND u < hi), n AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) SELECT draw, lang, doc_id FROM a JOIN n USING (lang, place)")
def sample_temperature(spark, d):
    return splits.temperature_draw(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 1000, 0.5, "17")


@query(f"WITH {U}, n AS (SELECT count(*) AS n FROM u), r AS (SELECT utterance_id, n, 300 % n AS lo, CAST(row_number() OVER (ORDER BY md5('19' || (300 // n) || ':' || utterance_id), utterance_id) - 1 AS BIGINT) AS place FROM u, n) SELECT utterance_id, place FROM r WHERE place >= lo AND place < lo + 100 OR place < lo + 100 - n")
def sample_cycle(spark, d):
    return splits.cycle_window(utterances(spark, d).select("utterance_id"), "utterance_id", 3, 100, "19")


@query(f"WITH {U}, r AS (SELECT utterance_id, row_number() OVER (PARTITION BY child_id ORDER BY utterance_id) - 1 AS i, count(*) OVER (PARTITION BY child_id) AS n FROM u) SELECT utterance_id, CAST(i // CAST(ceil(n / 4.0) AS BIGINT) AS INTEGER) AS shard, CAST(i % 4 AS INTEGER) AS lane FROM r")
def sample_rank_shard(spark, d):
    w = W.partitionBy("child_id")
    u = utterances(spark, d).select("utterance_id", (F.row_number().over(w.orderBy("utterance_id")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return u.select("utterance_id", F.floor(F.col("i") / F.ceil(F.col("n") / 4.0)).cast("int").alias("shard"), (F.col("i") % 4).cast("int").alias("lane"))



"""Fusion of hypotheses and choices of rerankers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.functions import lattices, metrics, text
from voxframe.operators import fusion, ranking
from voxframe.plans.registered import query
from voxframe.plans.relational import NORM_SIMPLE
from voxframe.plans.tables import C, P, candidates, predictions, spread, word_table
from voxframe.sources.workdir import materialise

N = NORM_SIMPLE.format("pred")
#: Predictions with a score and the normalised text.
S = f"{P}, s AS (SELECT *, {N} AS key, CAST((session_id * 7 + ord * 3 + model * 5) % 11 AS DOUBLE) / 10 AS score FROM p)"


def scored(spark, d, dealt=False):
    return predictions(spark, d, dealt).withColumn("score", ((F.col("session_id") * 7 + F.col("ord") * 3 + F.col("model") * 5) % 11).cast("double") / 10)


MAJOR = f"{S}, v AS (SELECT utterance_id, key, count(*) AS votes, min(model) AS first, arg_min(pred, model) AS pred FROM s GROUP BY 1, 2), m AS (SELECT utterance_id, CASE WHEN key = '' THEN trim(pred) ELSE pred END AS pred FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY key = '', votes DESC, first) AS k FROM v) WHERE k = 1)"
AGREED = "a AS (SELECT utterance_id, CASE WHEN min(key) = max(key) AND min(key) <> '' THEN arg_min(pred, model) END AS pred FROM s GROUP BY 1)"
UNIQUE = "n AS (SELECT utterance_id, greatest(1, count(DISTINCT CASE WHEN key <> '' THEN key END)) AS n_unique FROM s GROUP BY 1)"


@query(f"WITH {MAJOR} SELECT utterance_id, pred FROM m")
def fuse_majority(spark, d):
    return fusion.majority(predictions(spark, d))


@query(f"WITH {S}, {AGREED} SELECT utterance_id, pred FROM a")
def fuse_consensus(spark, d):
    return fusion.consensus(predictions(spark, d))


@query(f"WITH {S}, {UNIQUE} SELECT utterance_id, n_unique FROM n")
def fuse_count_unique(spark, d):
    return fusion.count_unique(predictions(spark, d))


@query(f"WITH {MAJOR}, {AGREED}, {UNIQUE}, q AS (SELECT utterance_id, CASE WHEN session_id % 3 = 0 THEN NULL WHEN session_id % 3 = 1 THEN 9 ELSE 2 END AS choice FROM u), j AS (SELECT m.utterance_id, m.pred AS major, a.pred AS agreed, n_unique, q.choice, s.pred AS chosen FROM m JOIN a USING (utterance_id) JOIN n USING (utterance_id) JOIN q USING (utterance_id) LEFT JOIN s ON s.utterance_id = m.utterance_id AND s.model = q.choice), l AS (SELECT *, CASE WHEN agreed IS NOT NULL THEN 'consensus' WHEN n_unique < 3 THEN 'majority' WHEN choice IS NULL THEN 'llm_empty_fallback' WHEN chosen IS NULL THEN 'llm_invalid_choice_fallback' ELSE 'llm' END AS source FROM j) SELECT utterance_id, source, CASE source WHEN 'consensus' THEN agreed WHEN 'llm' THEN chosen ELSE major END AS pred FROM l")
def fuse_gated_llm(spark, d):
    p = predictions(spark, d)
    chooser = p.where("model = 0").select("utterance_id", F.when(F.col("session_id") % 3 == 1, 9).when(F.col("session_id") % 3 == 2, 2).alias("choice"))
    return fusion.gated(p, chooser)


@query(f"WITH {S}, v AS (SELECT utterance_id, pred, count(*) AS votes, max(score) AS score, min(model) AS first FROM s GROUP BY 1, 2) SELECT utterance_id, pred FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY votes DESC, score DESC, first) AS k FROM v) WHERE k = 1")
def fuse_vote_maxscore(spark, d):
    return fusion.vote_max_score(scored(spark, d))


@query(f"WITH {S} SELECT utterance_id, pred, score FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY score DESC, model) AS k FROM s) WHERE k = 1")
def fuse_best_score(spark, d):
    return fusion.best_score(scored(spark, d))


MODEL_CER = f"{S}, r AS (SELECT *, {NORM_SIMPLE.format('text')} AS ref FROM s), g AS (SELECT model, sum(CASE WHEN ref = key THEN 0 ELSE levenshtein(ref, key) END) / sum(length(ref))::DOUBLE AS per FROM r GROUP BY 1)"


def model_cer(p):
    e = spread(p, "utterance_id").withColumns({"ref": text.norm_simple(F.col("text")), "hyp": text.norm_simple(F.col("pred"))})
    return e.groupBy("model").agg((F.sum(metrics.char_distance(F.col("ref"), F.col("hyp"))) / F.sum(F.length("ref"))).alias("per"))


WEIGHTED = "SELECT utterance_id, {how} AS weights, pred FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY votes DESC, first) AS k FROM (SELECT utterance_id, key, round(sum({weight}), 6) AS votes, min(model) AS first, arg_min(pred, model) AS pred FROM s JOIN w USING (model) GROUP BY 1, 2)) WHERE k = 1"


@query(f"WITH {MODEL_CER}, w AS (SELECT model, per, (SELECT max(per) FROM g) - per AS below, 1 / greatest(per, 1e-6) AS inverse FROM g) {WEIGHTED.format(how=repr('below_worst'), weight='below')} UNION ALL {WEIGHTED.format(how=repr('inverse'), weight='inverse')}")
def fuse_weighted(spark, d):
    """Votes weighted by how much better than the worst a model is, and by one over its error rate."""
    p = predictions(spark, d)
    g = materialise(model_cer(p), "rates")
    worst = g.agg(F.max("per").alias("worst"))
    below = g.crossJoin(F.broadcast(worst)).select("model", (F.col("worst") - F.col("per")).alias("weight"))
    inverse = g.select("model", (1 / F.greatest("per", F.lit(1e-6))).alias("weight"))
    return fusion.weighted(p, below).select("utterance_id", F.lit("below_worst").alias("weights"), "pred").unionAll(fusion.weighted(p, inverse).select("utterance_id", F.lit("inverse").alias("weights"), "pred"))


@query(f"WITH {MAJOR}, {UNIQUE} SELECT m.utterance_id, CASE WHEN n_unique < 3 THEN m.pred ELSE s.pred END AS pred FROM m JOIN n USING (utterance_id) JOIN s ON s.utterance_id = m.utterance_id AND s.model = 2")
def fuse_rule_switch(spark, d):
    return fusion.rule_switch(predictions(spark, d), 2)


PAIR = "x AS (SELECT a.utterance_id, a.model AS i, b.model AS j, CASE WHEN a.key = b.key THEN 0 ELSE levenshtein(a.key, b.key) END AS ed, length(b.key) AS n FROM s a JOIN s b ON a.utterance_id = b.utterance_id AND a.model <> b.model)"


def normalised(p):
    return p.withColumn("key", text.norm_simple(F.col("pred")))


@query(f"WITH {S}, {PAIR}, k AS (SELECT utterance_id, i AS model, round(avg(CASE WHEN n > 0 THEN ed / n::DOUBLE WHEN ed > 0 THEN 1.0 ELSE 0.0 END), 9) AS risk FROM x GROUP BY 1, 2) SELECT utterance_id, model, risk FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY risk, model) AS p FROM k) WHERE p = 1")
def fuse_mbr(spark, d):
    return fusion.mbr(normalised(spread(predictions(spark, d), "utterance_id")), "key")


@query(f"WITH {S}, {PAIR}, e AS (SELECT utterance_id, model, exp(score - max(score) OVER (PARTITION BY utterance_id)) AS e FROM s), b AS (SELECT utterance_id, model AS j, e / sum(e) OVER (PARTITION BY utterance_id) AS prob FROM e), k AS (SELECT x.utterance_id, i AS model, round(sum(prob * ed), 9) AS risk FROM x JOIN b USING (utterance_id, j) GROUP BY 1, 2) SELECT utterance_id, model, risk FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY risk, model) AS p FROM k) WHERE p = 1")
def fuse_mbr_weighted(spark, d):
    return fusion.mbr_weighted(normalised(scored(spark, d)), "key")


@query(f"WITH {P}, h AS (SELECT utterance_id, list_sort(list(length(pred)))[CAST(len(list(pred)) // 2 AS INTEGER) + 1] AS mid FROM p GROUP BY 1) SELECT p.utterance_id, p.model, CASE WHEN p.model >= 2 AND h.mid <= 200 THEN 1.5 ELSE 1.0 END::DOUBLE AS weight FROM p JOIN h USING (utterance_id)")
def fuse_length_boost(spark, d):
    p = predictions(spark, d)
    lengths = F.sort_array(F.collect_list(F.length("pred")))
    mid = p.groupBy("utterance_id").agg(F.get(lengths, F.floor(F.size(lengths) / 2).cast("int")).alias("mid"))
    return p.join(mid, "utterance_id").select("utterance_id", "model", F.when((F.col("model") >= 2) & (F.col("mid") <= 200), 1.5).otherwise(1.0).alias("weight"))


@query(f"WITH {P} SELECT a.utterance_id, CASE WHEN len(list_filter(string_split(b.pred, ' '), lambda w: w <> '')) < len(list_filter(string_split(a.pred, ' '), lambda w: w <> '')) THEN a.pred ELSE b.pred END AS pred FROM p a JOIN p b ON a.utterance_id = b.utterance_id AND a.model = 0 AND b.model = 1")
def fuse_longer_tokens(spark, d):
    p = predictions(spark, d)
    pair = p.groupBy("utterance_id").agg(F.max(F.when(F.col("model") == 0, F.col("pred"))).alias("a"), F.max(F.when(F.col("model") == 1, F.col("pred"))).alias("b"))
    return pair.select("utterance_id", F.when(F.size(text.words(F.col("b"))) < F.size(text.words(F.col("a"))), F.col("a")).otherwise(F.col("b")).alias("pred"))


@query(f"WITH {S}, t AS (SELECT utterance_id, key, avg(score) AS score, min(model) AS first FROM s GROUP BY 1, 2) SELECT utterance_id, key AS pred, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY round(score, 9) DESC, first) AS k FROM t) WHERE k = 1")
def fuse_nbest_rescore(spark, d):
    """Pool distinct texts, average their scores over models, take the best."""
    t = normalised(scored(spark, d)).groupBy("utterance_id", "key").agg(F.round(F.avg("score"), 9).alias("score"), F.min("model").alias("first"))
    return t.groupBy("utterance_id").agg(F.min_by(F.struct(F.col("key").alias("pred"), "score"), F.struct(-F.col("score"), "first")).alias("b")).select("utterance_id", "b.*")


@query(f"WITH {C}, a AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN idx = 0 THEN 0 ELSE 1 END, s0 DESC, idx) AS k FROM c), b AS (SELECT *, s0 / 1000 + s1 AS total FROM a WHERE k <= 3) SELECT uid, idx, round(total, 6) AS total FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(total, 6) DESC, idx) AS j FROM b) WHERE j = 1")
def fuse_rescore2(spark, d):
    """Stage one keeps the forced candidate and the best by a cheap score; stage two adds the dear score to what is left."""
    c = candidates(spark, d)
    forced = F.when(F.col("idx") == 0, 0).otherwise(1)
    kept = c.withColumn("k", F.row_number().over(ranking.group().orderBy(forced, F.desc("s0"), "idx"))).where("k <= 3")
    return kept.select("uid", "idx", F.round(F.col("s0") / 1000 + F.col("s1"), 6).alias("total")).groupBy("uid").agg(F.min_by(F.struct("idx", "total"), F.struct(-F.col("total"), "idx")).alias("b")).select("uid", "b.*")


LEVELS = f"{C}, t AS (SELECT uid, idx, s1, count(*) OVER (PARTITION BY uid) AS n, rank() OVER (PARTITION BY uid ORDER BY s1) + (count(*) OVER (PARTITION BY uid, s1) - 1) / 2.0::DOUBLE AS r, min(s1) OVER (PARTITION BY uid) AS lo, max(s1) OVER (PARTITION BY uid) AS hi FROM c), q AS (SELECT *, greatest(2, least(n, 4)) - 1 AS top FROM t)"


@query(f"WITH {LEVELS} SELECT uid, idx, CAST(CASE WHEN n = 1 THEN 3 ELSE round_even((1 - (r - 1) / (n - 1)) * top, 0) END AS INTEGER) AS by_rank, CAST(CASE WHEN n = 1 THEN 3 WHEN hi <= lo + 1e-8 THEN top ELSE round_even((1 - (s1 - lo) / (hi - lo)) * top, 0) END AS INTEGER) AS by_gap, CAST(s1 = lo AS INTEGER) AS by_best FROM q")
def rerank_labels(spark, d):
    return candidates(spark, d).select("uid", "idx", ranking.relevance("s1").alias("by_rank"), ranking.relevance_gap("s1").alias("by_gap"), ranking.relevance_best("s1").alias("by_best"))


@query(f"WITH {C} SELECT uid, idx FROM (SELECT uid, idx, row_number() OVER (PARTITION BY uid ORDER BY round((s0 + s1 + s2) / 3, 6) DESC, idx) AS k FROM c) WHERE k = 1")
def rerank_fullavg(spark, d):
    c = candidates(spark, d).withColumn("m", F.round((F.col("s0") + F.col("s1") + F.col("s2")) / 3, 6))
    return c.groupBy("uid").agg(F.min_by("idx", F.struct(-F.col("m"), "idx")).alias("idx"))


CHOICES = f"{C}, r AS (SELECT *, count(*) OVER (PARTITION BY uid) AS n, row_number() OVER (PARTITION BY uid ORDER BY s0 DESC, idx) AS p0, row_number() OVER (PARTITION BY uid ORDER BY s1 DESC, idx) AS p1, row_number() OVER (PARTITION BY uid ORDER BY s2 DESC, idx) AS p2 FROM c), f AS (SELECT *, CAST(p0 = 1 AS INTEGER) + CAST(p1 = 1 AS INTEGER) + CAST(p2 = 1 AS INTEGER) AS votes, 3 * n - p0 - p1 - p2 AS points, round((s0 + s1 + s2) / 3, 6) AS mean FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY votes DESC, points DESC, mean DESC, idx) AS by_vote, row_number() OVER (PARTITION BY uid ORDER BY points DESC, votes DESC, mean DESC, idx) AS by_points, row_number() OVER (PARTITION BY uid ORDER BY s1, idx) AS by_oracle FROM f)"


def choices(spark, d):
    """Votes of three models, their rank points and mean score per candidate. Most votes win, then points, then the mean."""
    c = candidates(spark, d)
    w = ranking.group()
    place = [F.row_number().over(w.orderBy(F.desc(f"s{m}"), "idx")).alias(f"p{m}") for m in range(3)]
    r = c.select("*", F.count("*").over(w).alias("n"), *place)
    return r.select("uid", "idx", "s1", sum((F.col(f"p{m}") == 1).cast("int") for m in range(3)).alias("votes"), (3 * F.col("n") - F.col("p0") - F.col("p1") - F.col("p2")).alias("points"), F.round((F.col("s0") + F.col("s1") + F.col("s2")) / 3, 6).alias("mean"))


def by_vote():
    return [(-F.col("votes")).alias("a"), (-F.col("points")).alias("b"), (-F.col("mean")).alias("c")]


def by_points():
    return [(-F.col("points")).alias("a"), (-F.col("votes")).alias("b"), (-F.col("mean")).alias("c")]


@query(f"WITH {CHOICES} SELECT uid, idx, votes FROM o WHERE by_vote = 1")
def rerank_vote(spark, d):
    return choices(spark, d).groupBy("uid").agg(F.min_by(F.struct("idx", "votes"), F.struct(*by_vote(), "idx")).alias("b")).select("uid", "b.*")


@query(f"WITH {CHOICES} SELECT uid, idx, points FROM o WHERE by_points = 1")
def rerank_borda(spark, d):
    return choices(spark, d).groupBy("uid").agg(F.min_by(F.struct("idx", "points"), F.struct(*by_points(), "idx")).alias("b")).select("uid", "b.*")


@query(f"WITH {CHOICES} SELECT uid, idx FROM o WHERE by_oracle = 1")
def rerank_oracle(spark, d):
    return choices(spark, d).groupBy("uid").agg(F.min_by("idx", F.struct("s1", "idx")).alias("idx"))


@query(f"WITH {CHOICES} SELECT uid, max(CASE WHEN by_vote = 1 THEN idx END) AS vote, max(CASE WHEN by_points = 1 THEN idx END) AS borda, max(CASE WHEN by_oracle = 1 THEN idx END) AS oracle FROM o GROUP BY 1")
def rerank_strategy_table(spark, d):
    return choices(spark, d).groupBy("uid").agg(F.min_by("idx", F.struct(*by_vote(), "idx")).alias("vote"), F.min_by("idx", F.struct(*by_points(), "idx")).alias("borda"), F.min_by("idx", F.struct("s1", "idx")).alias("oracle"))


@query(f"WITH {S} SELECT utterance_id, text AS label, 'gold' AS origin FROM s WHERE model = 0 AND source = 'dd' UNION ALL SELECT utterance_id, pred, 'pseudo' FROM s WHERE model = 1 AND source = 'ext' AND score >= 0.7")
def pseudo_label_merge(spark, d):
    s = scored(spark, d)
    gold = s.where("model = 0 AND source = 'dd'").select("utterance_id", F.col("text").alias("label"), F.lit("gold").alias("origin"))
    return gold.unionByName(s.where("model = 1 AND source = 'ext' AND score >= 0.7").select("utterance_id", F.col("pred").alias("label"), F.lit("pseudo").alias("origin")))


RATE = "CASE WHEN {n} > 0 THEN {e} / {n}::DOUBLE WHEN {e} > 0 THEN 1.0 ELSE 0.0 END"
WORDS_OF = "list_filter(string_split({}, ' '), lambda w: w <> '')"
BOTH = f"{S}, {PAIR}, d0 AS (SELECT DISTINCT a.utterance_id, a.key AS x, b.key AS y, {WORDS_OF.format('a.key')} AS a, {WORDS_OF.format('b.key')} AS b FROM s a JOIN s b ON a.utterance_id = b.utterance_id AND a.key < b.key)"
PAIR_WORDS = f"pw AS (SELECT a.utterance_id, a.model AS i, b.model AS j, len({WORDS_OF.format('b.key')}) AS n, coalesce(dp.ed, 0) AS ed FROM s a JOIN s b ON a.utterance_id = b.utterance_id AND a.model <> b.model LEFT JOIN dp ON dp.utterance_id = a.utterance_id AND dp.x = least(a.key, b.key) AND dp.y = greatest(a.key, b.key))"


@query(f"WITH RECURSIVE {BOTH}, {word_table('d0', 'utterance_id, x, y')}, {PAIR_WORDS}, z AS (SELECT x.utterance_id, x.i, {RATE.format(n='x.n', e='x.ed')} AS c, {RATE.format(n='pw.n', e='pw.ed')} AS w FROM x JOIN pw ON pw.utterance_id = x.utterance_id AND pw.i = x.i AND pw.j = x.j), k AS (SELECT utterance_id, i AS model, m.metric, round(avg(CASE m.metric WHEN 'char' THEN c WHEN 'word' THEN w ELSE (c + w) / 2 END), 9) AS risk FROM z, (VALUES ('char'), ('word'), ('mean')) m(metric) GROUP BY 1, 2, 3) SELECT utterance_id, metric, model, risk FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id, metric ORDER BY risk, model) AS p FROM k) WHERE p = 1")
def fuse_mbr_metric(spark, d):
    """The same choice under three risks: rates of characters, of words, and the mean of both."""
    return fusion.mbr_by(normalised(spread(predictions(spark, d), "utterance_id")), "key", ("char", "word", "mean"))


SHAPE = f"{S}, {PAIR}, k AS (SELECT utterance_id, i AS model, round(avg(ed), 6) AS mean_pair, min(ed) AS least_pair, sum(ed) AS all_pair, count(*) AS pairs FROM x GROUP BY 1, 2), b AS (SELECT utterance_id, arg_min(key, row(-score, model)) AS best FROM s GROUP BY 1), r AS (SELECT *, {NORM_SIMPLE.format('text')} AS ref, CAST(rank() OVER (PARTITION BY utterance_id ORDER BY score DESC) - 1 AS INTEGER) AS beam_rank, count(*) OVER (PARTITION BY utterance_id, key) AS n_models_has, avg(score) OVER (PARTITION BY utterance_id, key) AS score_mean, max(score) OVER (PARTITION BY utterance_id, key) - min(score) OVER (PARTITION BY utterance_id, key) AS score_range FROM s)"


@query(f"WITH {SHAPE} SELECT r.utterance_id, r.model, r.beam_rank, r.n_models_has, round(r.score_mean, 6) AS score_mean, round(r.score_range, 6) AS score_range, length(r.key) AS text_len, len(string_split(r.key, ' ')) AS n_words, CASE WHEN r.key = b.best THEN 0 ELSE levenshtein(r.key, b.best) END AS edit_dist_to_best, k.mean_pair AS mean_pairwise_edit_dist, round(1 - least(k.all_pair / (k.pairs * greatest(length(r.key), 1))::DOUBLE, 1), 6) AS consensus_score, round(length(r.key) / greatest(r.duration, 0.001), 6) AS chars_per_sec, round(CASE WHEN length(r.ref) > 0 THEN CASE WHEN r.ref = r.key THEN 0 ELSE levenshtein(r.ref, r.key) END / length(r.ref)::DOUBLE WHEN r.key <> '' THEN 1.0 ELSE 0.0 END, 8) AS target_cer FROM r JOIN k USING (utterance_id, model) JOIN b USING (utterance_id)")
def rerank_feature_catalogue(spark, d):
    """Scores, ranks, votes, distances, consensus, shape, timing and target of each candidate text, in long form."""
    s = normalised(scored(spark, d, dealt=True)).withColumn("ref", text.norm_simple(F.col("text")))
    g = s.groupBy("utterance_id").agg(F.array_sort(F.collect_list(F.struct("model", "key", "score", "duration", "ref"))).alias("_h"))
    # the references are among the texts that are compared, so every distance is looked up
    g = g.withColumn("_t", F.array_distinct(F.concat(F.transform("_h", lambda h: h["key"]), F.transform("_h", lambda h: h["ref"]))))
    place = lambda c: F.array_position("_t", c).cast("int")
    g = g.withColumn("_h", F.transform("_h", lambda h: h.withField("at", place(h["key"]))))
    g = fusion.with_distances(g, {"_t": "_d"})
    best = F.element_at(F.array_sort(F.transform("_h", lambda h: F.struct((-h["score"]).alias("a"), h["model"].alias("m"), h["key"].alias("key"), h["at"].alias("at")))), 1)
    g = g.withColumn("best", best).select("*", F.explode("_h").alias("a")).select("utterance_id", "_h", "_t", "_d", "best", "a.*")
    same = F.transform(F.filter("_h", lambda h: h["key"].eqNullSafe(F.col("key"))), lambda h: h["score"])
    # a model's pairs are those of all its rows with all rows of the others
    mine, others = F.filter("_h", lambda h: h["model"] == F.col("model")), F.filter("_h", lambda h: h["model"] != F.col("model"))
    edits = F.flatten(F.transform(mine, lambda x: F.transform(others, lambda y: fusion.apart("_d", x["at"], y["at"]))))
    size = F.length("key")
    out = g.select(
        "utterance_id", "model", "key", "duration", "ref", edits.alias("edits"), same.alias("same"),
        F.size(F.filter("_h", lambda h: h["score"] > F.col("score"))).alias("beam_rank"), F.size(same).cast("long").alias("n_models_has"),
        fusion.apart("_d", F.col("at"), F.col("best.at")).alias("edit_dist_to_best"), fusion.apart("_d", place(F.col("ref")), F.col("at")).alias("to_ref"),
    ).where(F.size("edits") > 0)
    known = F.filter("edits", lambda e: e.isNotNull())
    every = F.when(F.size(known) > 0, lattices.total(known))
    return out.select(
        "utterance_id", "model", "beam_rank", "n_models_has", F.round(lattices.total("same") / F.size("same"), 6).alias("score_mean"), F.round(F.array_max("same") - F.array_min("same"), 6).alias("score_range"), size.alias("text_len"), F.size(F.split("key", " ")).alias("n_words"),
        "edit_dist_to_best", F.round(every / F.size(known), 6).alias("mean_pairwise_edit_dist"), F.round(1 - F.least(every / (F.size("edits") * F.greatest(size, F.lit(1))), F.lit(1.0)), 6).alias("consensus_score"),
        F.round(size / F.greatest("duration", F.lit(0.001)), 6).alias("chars_per_sec"), F.round(metrics.rate(F.col("to_ref"), F.length("ref")), 8).alias("target_cer"),
    )

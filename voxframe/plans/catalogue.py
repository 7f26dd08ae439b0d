"""Families of rerank features, one query each: rows are the different texts of an utterance's models."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import metrics, text
from voxframe.operators import features, fusion
from voxframe.plans.fusion import PAIR, S, normalised, scored
from voxframe.plans.registered import query
from voxframe.plans.relational import NORM_SIMPLE

CAND = f"{S}, k AS (SELECT DISTINCT utterance_id, key AS cand FROM s), m0 AS (SELECT * FROM s WHERE model = 0), m1 AS (SELECT * FROM s WHERE model = 1), m2 AS (SELECT * FROM s WHERE model = 2), m3 AS (SELECT * FROM s WHERE model = 3)"
#: Each candidate beside the texts of the four models.
WIDE = f"{CAND}, w AS (SELECT k.utterance_id, k.cand, m0.text, m0.source, m0.duration, m0.session_id, m0.ord, m0.key AS k0, m1.key AS k1, m2.key AS k2, m3.key AS k3, m0.score AS s0, m1.score AS s1, m2.score AS s2, m3.score AS s3 FROM k JOIN m0 USING (utterance_id) JOIN m1 USING (utterance_id) JOIN m2 USING (utterance_id) JOIN m3 USING (utterance_id))"


def ed(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein({a}, {b}) END"


def sp(a: str) -> str:
    return f"(length({a}) - length(replace({a}, ' ', '')))"


def ned(a: str, b: str) -> str:
    return f"({ed(a, b)}) / greatest(length({a}), length({b}), 1)::DOUBLE"


def candidates(spark, d, *carry):
    return features.pool(normalised(scored(spark, d)), carry=carry)


def told(df, columns, places=8):
    kinds = ("double", "float")
    out = df.select("utterance_id", "cand", *[c.alias(k) for k, c in columns.items()])
    return out.select(*[F.round(c, places).alias(c) if t in kinds else c for c, t in out.dtypes])


@query(f"WITH {WIDE}, g AS (SELECT utterance_id, key AS cand, avg(score) AS score_mean, stddev_pop(score) AS score_std, min(score) AS score_min, max(score) AS score_max, max(score) - min(score) AS score_range, count(*) AS n_score_models FROM s GROUP BY 1, 2) SELECT w.utterance_id, w.cand, CASE WHEN k0 = w.cand THEN s0 ELSE -1 END AS ctc_score_0, CASE WHEN k1 = w.cand THEN s1 ELSE -1 END AS ctc_score_1, CASE WHEN k2 = w.cand THEN s2 ELSE -1 END AS ctc_score_2, CASE WHEN k3 = w.cand THEN s3 ELSE -1 END AS ctc_score_3, round(score_mean, 8) AS score_mean, round(score_std, 8) AS score_std, score_min, score_max, round(score_range, 8) AS score_range, n_score_models FROM w JOIN g USING (utterance_id, cand)")
def feat_scores(spark, d):
    return told(candidates(spark, d), features.scores(4))


BEAMS = "b AS (SELECT utterance_id, model, 0 AS rank, key FROM s UNION ALL SELECT utterance_id, (model + 3) % 4, 1, key FROM s), r AS (SELECT k.utterance_id, cand, min(CASE WHEN model = 0 THEN rank END) AS r0, min(CASE WHEN model = 1 THEN rank END) AS r1, min(CASE WHEN model = 2 THEN rank END) AS r2, min(CASE WHEN model = 3 THEN rank END) AS r3 FROM k JOIN b ON b.utterance_id = k.utterance_id AND b.key = k.cand GROUP BY 1, 2)"


def over_ranks(f: str) -> str:
    return " + ".join(f.format(f"r{m}") for m in range(4))


@query(f"WITH {CAND}, {BEAMS} SELECT utterance_id, cand, {', '.join(f'coalesce(r{m}, -1) AS beam_rank_{m}' for m in range(4))}, ({over_ranks('coalesce({}, 2)')}) / 4.0::DOUBLE AS rank_mean, least({', '.join(f'coalesce(r{m}, 2)' for m in range(4))}) AS rank_min, greatest({', '.join(f'coalesce(r{m}, 2)' for m in range(4))}) AS rank_max, {over_ranks('CASE WHEN {} IS NULL THEN 0 ELSE 1 END')} AS n_models_has, {over_ranks('CASE WHEN {} < 3 THEN 1 ELSE 0 END')} AS n_models_in_top3, {over_ranks('CASE WHEN {} = 0 THEN 1 ELSE 0 END')} AS n_exact_best FROM r")
def feat_beam_ranks(spark, d):
    """A model's list holds its own text first and the next model's second."""
    own = F.transform("models", lambda m: F.struct(m["model"].alias("model"), F.lit(0).alias("rank"), m["key"].alias("key")))
    borrowed = F.transform("models", lambda m: F.struct(((m["model"] + 3) % 4).alias("model"), F.lit(1).alias("rank"), m["key"].alias("key")))
    return told(candidates(spark, d).withColumn("beams", F.concat(own, borrowed)), features.beam_ranks(4, 2))


@query(f"WITH {WIDE} SELECT utterance_id, cand, CAST(k1 = cand AS INTEGER) AS is_dual_ctc, CAST(k2 = cand AS INTEGER) AS is_dual_tdt, CAST(k0 = cand AS INTEGER) AS is_dual_primary, CAST(k1 = k2 AS INTEGER) AS dual_heads_agree, abs(length(k1) - length(k2)) AS dual_len_gap, CAST(k1 = cand AS INTEGER) + CAST(k2 = cand AS INTEGER) AS n_dual_hits FROM w")
def feat_dual_heads(spark, d):
    return told(candidates(spark, d), features.dual_heads(1, 2, 0))


HEADS = ", ".join(f"length(k{m}) - length(cand) AS len_diff_{m}, {sp(f'k{m}')} - {sp('cand')} AS space_diff_{m}, {ed(f'k{m}', 'cand')} AS edit_{m}, round({ned(f'k{m}', 'cand')}, 8) AS norm_edit_{m}" for m in (1, 2))


@query(f"WITH {WIDE} SELECT utterance_id, cand, {HEADS}, round(({ned('k1', 'cand')} + {ned('k2', 'cand')}) / 2, 8) AS norm_edit_mean, round(least({ned('k1', 'cand')}, {ned('k2', 'cand')}), 8) AS norm_edit_min FROM w")
def feat_heads_against(spark, d):
    return told(candidates(spark, d), features.heads_against([1, 2]))


@query(f"WITH {WIDE} SELECT utterance_id, cand, s3 AS word_score, round(s3 - s0, 8) AS word_gap, length(k3) AS word_len, {sp('k3')} AS word_spaces, {ed('k3', 'cand')} AS word_edit, round({ned('k3', 'cand')}, 8) AS word_norm_edit FROM w")
def feat_word_head(spark, d):
    return told(candidates(spark, d), features.word_head(3, 0))


LABELLED = f"{WIDE}, l AS (SELECT *, CASE WHEN source = 'dd' THEN {NORM_SIMPLE.format('text')} END AS label FROM w)"


@query(f"WITH {LABELLED} SELECT utterance_id, cand, CAST(label IS NOT NULL AS INTEGER) AS has_label, coalesce(length(label), -1) AS label_len, coalesce({ed('label', 'cand')}, -1) AS label_edit, coalesce(round({ned('label', 'cand')}, 8), -1) AS label_norm_edit, coalesce(CAST(length(label) = length(cand) AS INTEGER), -1) AS label_same_len, coalesce(CAST({sp('label')} = {sp('cand')} AS INTEGER), -1) AS label_same_spaces, coalesce(CAST(label = cand AS INTEGER), -1) AS label_exact FROM l")
def feat_word_label(spark, d):
    """Labels are known for the competition's utterances alone."""
    label = F.when(F.col("source") == "dd", text.norm_simple(F.col("text")))
    c = candidates(spark, d, "text", "source").withColumn("label", label)
    c = c.withColumn("edits", F.coalesce(features.edits_to(F.col("label")), metrics.char_distance(F.col("label"), F.col("cand"))))
    return told(c, features.word_label(F.col("label"), F.col("edits")))


SECOND = f"{WIDE}, x AS (SELECT *, CASE WHEN k2 = cand AND k3 = cand THEN greatest(s2, s3) WHEN k2 = cand THEN s2 WHEN k3 = cand THEN s3 END AS s FROM w), y AS (SELECT *, avg(s) OVER g AS mean, stddev_samp(s) OVER g AS sd, rank() OVER (PARTITION BY utterance_id ORDER BY s DESC NULLS LAST) AS rank, count(*) OVER g AS n, list_reverse_sort(list(s) FILTER (WHERE s IS NOT NULL) OVER g) AS top FROM x WINDOW g AS (PARTITION BY utterance_id))"


@query(f"WITH {SECOND} SELECT utterance_id, cand, CAST(k2 = cand AS INTEGER) AS second_hit, length(k2) - length(cand) AS second_len_diff, {sp('k2')} - {sp('cand')} AS second_space_diff, coalesce(s, -1) AS second_score, rank AS second_rank, round(rank / n::DOUBLE, 8) AS second_pct, round(coalesce((s - mean) / greatest(sd, 1e-8), 0), 6) AS second_z, round(coalesce(s - mean, 0), 8) AS second_centered, round(coalesce(s - CASE WHEN s = top[1] THEN coalesce(top[2], top[1]) ELSE top[1] END, 0), 8) AS second_margin FROM y")
def feat_second_scorer(spark, d):
    return features.second_scorer(candidates(spark, d), 2)


CHOSEN = f"{CAND}, {PAIR}, q AS (SELECT utterance_id, i AS model, round(avg(CASE WHEN n > 0 THEN ed / n::DOUBLE WHEN ed > 0 THEN 1.0 ELSE 0.0 END), 9) AS risk FROM x GROUP BY 1, 2), c AS (SELECT q.utterance_id, s.key AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY utterance_id ORDER BY risk, model) AS p FROM q) q JOIN s USING (utterance_id, model) WHERE p = 1)"


@query(f"WITH {CHOSEN} SELECT utterance_id, cand, CAST(cand = chosen AS INTEGER) AS is_mbr_selected, {ed('cand', 'chosen')} AS edit_dist_to_mbr FROM k JOIN c USING (utterance_id)")
def feat_mbr(spark, d):
    risk = features.mean_risk()
    c = candidates(spark, d)
    # a text's risk is that of the first model that says it; the least of all texts is chosen, the first of ties
    first = F.array_min(F.transform(F.filter("models", lambda m: m["key"] == F.col("cand")), lambda m: m["model"]))
    c = c.withColumn("_by", F.struct(F.round(risk, 9), first))
    c = c.withColumn("chosen", F.min_by("cand", "_by").over(W.partitionBy("utterance_id")))
    return c.select("utterance_id", "cand", (F.col("cand") == F.col("chosen")).cast("int").alias("is_mbr_selected"), features.edits_to(F.col("chosen")).alias("edit_dist_to_mbr"))


@query(f"WITH {WIDE}, a AS (SELECT *, [s0 * 2, s1 * 2, s2 * 2, s3 * 2] AS e FROM w), z AS (SELECT *, list_transform(e, lambda x: exp(x - list_max(e)) / list_sum(list_transform(e, lambda y: exp(y - list_max(e))))) AS p FROM a) SELECT utterance_id, cand, list_position(e, list_max(e)) - 1 AS age_top, round(list_max(p), 8) AS age_prob, round(p[2] + 2 * p[3] + 3 * p[4], 8) AS age_expected, round(1 / (1 + exp(-(s0 - s1) * 3)), 8) AS domain_prob, round(length(cand) - duration * 14, 8) AS chars_diff, round({sp('cand')} - duration * 2.5, 8) AS spaces_diff FROM z")
def feat_auxiliary(spark, d):
    """Raw outputs of the auxiliary heads stand in for by the models' scores, their expectations by the duration."""
    at = lambda m: F.get(F.transform("models", lambda x: x["score"]), F.lit(m))
    ages = F.array(*[at(m) * 2 for m in range(4)])
    return told(candidates(spark, d, "duration"), features.auxiliary(ages, (at(0) - at(1)) * 3, F.col("duration") * 14, F.col("duration") * 2.5))


LM = f"{CAND}, t AS (SELECT list_concat(['<s>'], list_concat(string_split({NORM_SIMPLE.format('text')}, ' '), ['</s>'])) AS w FROM m0 WHERE source = 'dd'), g AS (SELECT w[i] AS prev, w[i + 1] AS cur FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t)), c2 AS (SELECT prev, cur, count(*) / sum(count(*)) OVER (PARTITION BY prev)::DOUBLE AS p FROM g GROUP BY 1, 2), kc AS (SELECT utterance_id, cand, list_concat(['<s>'], list_concat(string_split(cand, ' '), ['</s>'])) AS w FROM k), kg AS (SELECT utterance_id, cand, w[i] AS prev, w[i + 1] AS cur FROM (SELECT *, unnest(range(1, len(w))) AS i FROM kc))"


@query(f"WITH {LM} SELECT utterance_id, cand, round(sum(coalesce(ln(p), -10)), 6) AS lm_score, round(sum(coalesce(ln(p), -10)) / greatest(length(cand), 1), 6) AS lm_per_char, round(sum(coalesce(ln(p), -10)) / len(string_split(cand, ' ')), 6) AS lm_per_word FROM kg LEFT JOIN c2 USING (prev, cur) GROUP BY 1, 2")
def feat_language_model(spark, d):
    """Word bigrams learnt from the competition's texts; an unseen pair counts as -10.

    A pair of words goes to the model once for each utterance, with the places of the candidates that have it, and comes
    back if the model knows it; the texts stay where they are.
    """
    s = normalised(scored(spark, d, dealt=True))

    def pairs(c):
        w = F.concat(F.array(F.lit("<s>")), F.split(c, " ", -1), F.array(F.lit("</s>")))
        return F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda prev, cur: F.concat(prev, F.lit(" "), cur))

    learnt = s.where("model = 0 AND source = 'dd'").select(F.explode(pairs(text.norm_simple(F.col("text")))).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    learnt = learnt.withColumn("prev", F.substring_index("pair", " ", 1))
    whole = learnt.groupBy("prev").agg(F.sum("n").alias("all"))
    p = learnt.join(whole, "prev").select("pair", F.log(F.col("n") / F.col("all")).alias("logp"))
    c = s.groupBy("utterance_id").agg(F.array_sort(F.collect_set("key")).alias("cands"))
    # equal pairs of an utterance's candidates lie side by side; where one begins, the places of all follow
    said = F.array_sort(F.flatten(F.transform("cands", lambda x, at: F.transform(pairs(x), lambda w: F.struct(w.alias("pair"), at.alias("at"))))))
    g = c.where(F.size("cands") > 0).select("utterance_id", said.alias("said"))
    g = g.withColumn("first", F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: (i == 1) | (F.get("said", i - 2)["pair"] != F.get("said", i - 1)["pair"])))
    end = lambda k: F.coalesce(F.get("first", k + 1), F.size("said") + 1)
    each = F.transform("first", lambda i, k: F.struct(F.get("said", i - 1)["pair"].alias("pair"), F.transform(F.slice("said", i, end(k) - i), lambda x: x["at"]).alias("at")))
    known = fusion.dealt(g.select("utterance_id", F.explode(each).alias("x")).select("utterance_id", "x.*").join(p.hint("shuffle_hash"), "pair").select("utterance_id", "at", "logp"))
    known = known.select("utterance_id", F.explode("at").alias("at"), "logp").groupBy("utterance_id", "at").agg(F.sum("logp").alias("logp"), F.count("*").alias("n"))
    known = known.groupBy("utterance_id").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("logp", "n")))).alias("known"))
    out = c.join(known, "utterance_id", "left").select("utterance_id", F.posexplode("cands").alias("at", "cand"), "known")
    out = out.withColumns({"found": F.try_element_at("known", F.col("at")), "words": F.size(F.split("cand", " ", -1))})
    lm = F.coalesce("found.logp", F.lit(0.0)) - 10.0 * (F.col("words") + 1 - F.coalesce("found.n", F.lit(0)))
    out = out.select("utterance_id", "cand", "words", lm.alias("lm"))
    return out.select("utterance_id", "cand", F.round("lm", 6).alias("lm_score"), F.round(F.col("lm") / F.greatest(F.length("cand"), F.lit(1)), 6).alias("lm_per_char"), F.round(F.col("lm") / F.col("words"), 6).alias("lm_per_word"))


@query(f"WITH {WIDE} SELECT utterance_id, cand, length(cand) AS text_len, CAST(ceil(duration / 0.04) AS BIGINT) AS n_frames, round(length(cand) / greatest(ceil(duration / 0.04), 1), 8) AS char_per_frame, round(ceil(duration / 0.04) * 0.04 - duration, 8) AS frame_excess, round(len(string_split(cand, ' ')) / greatest(duration, 0.001), 6) AS words_per_sec, len(string_split(cand, ' ')) AS n_words, {sp('cand')} AS n_spaces FROM w")
def feat_size_timing(spark, d):
    """Lengths by frames of 40 ms and by seconds."""
    frames, n = F.ceil(F.col("duration") / 0.04), F.size(F.split("cand", " ", -1))
    columns = {"text_len": F.length("cand"), "n_frames": frames, "char_per_frame": F.length("cand") / F.greatest(frames, F.lit(1)), "frame_excess": frames * 0.04 - F.col("duration"), "words_per_sec": F.round(n / F.greatest("duration", F.lit(0.001)), 6), "n_words": n, "n_spaces": features.spaces(F.col("cand"))}
    return told(candidates(spark, d, "duration"), columns)


@query(f"WITH {CAND}, t AS (SELECT utterance_id, cand, list_filter(string_split(cand, ' '), lambda w: w <> '') AS w, list_filter(string_split(cand, ''), lambda x: x <> '') AS ch FROM k), e AS (SELECT utterance_id, cand, sum(-n / total::DOUBLE * ln(n / total::DOUBLE + 1e-12)) AS h FROM (SELECT utterance_id, cand, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY utterance_id, cand) AS total FROM (SELECT utterance_id, cand, unnest(ch) AS c FROM t) GROUP BY 1, 2, 3) GROUP BY 1, 2), f AS (SELECT t.utterance_id, t.cand, length(t.cand) AS text_len, len(w) AS n_words, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE ELSE 0 END AS mean_word_len, coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS max_word_len, coalesce(list_min(list_transform(w, lambda x: length(x))), 0) AS min_word_len, len(list_distinct(ch)) AS n_unique_chars, coalesce(h, 0) AS char_entropy FROM t LEFT JOIN e ON e.utterance_id = t.utterance_id AND e.cand = t.cand) SELECT utterance_id, cand, text_len, n_words, round(mean_word_len, 8) AS mean_word_len, max_word_len, min_word_len, n_unique_chars, round(char_entropy, 6) AS char_entropy, round(text_len - avg(text_len) OVER g, 6) + 0.0 AS len_from_mean, max(text_len) OVER g - text_len AS len_below_longest FROM f WINDOW g AS (PARTITION BY utterance_id)")
def feat_text_shape(spark, d):
    """Length, words, letters and their entropy of each candidate, and its length against the other candidates'."""
    g = W.partitionBy("utterance_id")
    shape = {k: F.round(c, 8 if k == "mean_word_len" else 6) if k in ("mean_word_len", "char_entropy") else c for k, c in text.text_features(F.col("cand")).items()}
    size = F.length("cand")
    more = {"len_from_mean": F.round(size - F.avg(size).over(g), 6) + 0.0, "len_below_longest": F.max(size).over(g) - size}
    texts = normalised(scored(spark, d)).select("utterance_id", F.col("key").alias("cand")).distinct()
    return texts.select("utterance_id", "cand", *[c.alias(k) for k, c in {**shape, **more}.items()])

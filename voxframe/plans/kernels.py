"""Alignments, voting networks, lattices and chunks: kernels in Arrow batches, checked by tests on small fixtures."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import kernels, lattices, metrics, signals, text
from voxframe.functions.batched import count_rows, flat_map_rows, map_rows, on_distinct
from voxframe.operators import classifiers, ngrams, splits
from voxframe.plans.registered import query
from voxframe.plans.relational import NORM_SIMPLE
from voxframe.plans.tables import P, U, predictions, spread, table, utterances, word_table
from voxframe.sources import packed, readers, writers
from voxframe.sources.workdir import materialise, new_path
from voxframe.streaming import machines

# ---- texts


@query(f"WITH {U} SELECT utterance_id, nfc_normalize(replace(text, 'e', 'e' || chr(769))) AS out FROM u")
def norm_nfc(spark, d):
    u = utterances(spark, d).select("utterance_id", F.replace("text", F.lit("e"), F.lit("é")).alias("raw"))
    return on_distinct(u, "raw", kernels.nfc, "string", "out").select("utterance_id", "out")


@query(f"WITH {U} SELECT utterance_id, role || ' uh ' || text AS out FROM u")
def fix_repetitions(spark, d):
    u = utterances(spark, d).select("utterance_id", F.concat(F.repeat("role", 25), F.repeat(F.lit(" "), 30), F.lit("uh "), "text").alias("raw"))
    return map_rows(u, lambda i, s: (i, kernels.fix_repetitions(s)), "utterance_id string, out string")


# ---- word alignment


def word_rows():
    return F.split(text.norm_simple(F.col("text")), " ").alias("r"), F.split(text.norm_simple(F.col("pred")), " ").alias("h")


def aligned(spark, d):
    """One row per step of the word alignment; equal texts need no table."""
    p = spread(predictions(spark, d), "utterance_id").select("utterance_id", "model", "age_bucket", *word_rows())

    def steps(i, m, age, r, h):
        return [(i, m, age, *op) for op in kernels.edit_ops(r, h)] if r != h else [(i, m, age, "match", w, w) for w in r]

    return flat_map_rows(p, steps, "utterance_id string, model int, age_bucket string, op string, ref string, hyp string")


@query()
def edit_ops(spark, d):
    return aligned(spark, d).groupBy("utterance_id", "model", "op").agg(F.count("*").alias("n"))


@query()
def edit_ops_jiwer(spark, d):
    p = spread(predictions(spark, d), "utterance_id").where("pred <> text").select("utterance_id", "model", *word_rows())
    pairs = flat_map_rows(p, lambda i, m, r, h: [(i, m, *x) for x in kernels.edit_pairs(r, h)], "utterance_id string, model int, ref string, hyp string")
    return pairs.groupBy("model", "ref", "hyp").agg(F.count("*").alias("n"))


@query()
def agg_error_mix(spark, d):
    """Substitutions, deletions and insertions by age and model, their shares and rate."""
    g = aligned(spark, d).groupBy("age_bucket", "model").agg(*[F.count_if(F.col("op") == k).alias(k) for k in ("sub", "del", "ins")], F.count_if(F.col("op") != "ins").alias("n_ref"))
    total = F.greatest(F.col("sub") + F.col("del") + F.col("ins"), F.lit(1))
    return g.select("*", *[F.round(F.col(k) / total, 8).alias(f"{k}_share") for k in ("sub", "del", "ins")], F.round((F.col("sub") + F.col("del") + F.col("ins")) / F.greatest("n_ref", F.lit(1)), 8).alias("rate"))


#: Symbols of normalised texts, and the mark of what a hypothesis lacks: the columns of the confusion matrix.
SYMBOLS = [*"abcdefghijklmnopqrstuvwxyz0123456789'", "[DEL]"]


def confused(spark, d):
    """(model, ref, hyp, n) of all letters that differ, from alignments of whole texts without spaces."""
    p = predictions(spark, d, dealt=True)
    p = p.select("model", *[F.replace(text.norm_simple(F.col(c)), F.lit(" "), F.lit("")).alias(k) for c, k in (("text", "r"), ("pred", "h"))]).where("r <> h AND r <> '' AND h <> ''")
    pairs = count_rows(p, lambda m, r, h: [(m, *x) for x in kernels.edit_pairs(r, h)], "model int, ref string, hyp string, n long")
    return pairs.groupBy("model", "ref", "hyp").agg(F.sum("n").alias("n"))


@query()
def agg_confusion(spark, d):
    """The matrix of all models: a row for each symbol of the reference and for what is put in, a column for each answer."""
    return confused(spark, d).groupBy("model", "ref").pivot("hyp", SYMBOLS).agg(F.sum("n")).na.fill(0)


@query()
def confusion_pairs(spark, d):
    return confused(spark, d)


def word_arrays(c):
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


WORDS_OF = "list_filter(string_split({}, ' '), lambda w: w <> '')"
WORD_PAIRS = f"{P}, d0 AS (SELECT utterance_id, model, {WORDS_OF.format(NORM_SIMPLE.format('text'))} AS a, {WORDS_OF.format(NORM_SIMPLE.format('pred'))} AS b FROM p)"


@query(f"WITH RECURSIVE {WORD_PAIRS}, {word_table('d0', 'utterance_id, model')} SELECT utterance_id, model, ed FROM dp")
def edit_distance_word(spark, d):
    """Word Levenshtein in the JVM, on all predictions."""
    a, b = word_arrays(text.norm_simple(F.col("text"))), word_arrays(text.norm_simple(F.col("pred")))
    p = spread(predictions(spark, d), "utterance_id").select("utterance_id", "model", a.alias("a"), b.alias("b"))
    return metrics.with_word_distance(p, "a", "b", "ed").select("utterance_id", "model", "ed")


@query(f"WITH RECURSIVE {WORD_PAIRS}, {word_table('d0', 'utterance_id, model')} SELECT utterance_id, model, round(CASE WHEN n > 0 THEN ed / n::DOUBLE WHEN ed > 0 THEN 1.0 ELSE 0.0 END, 8) AS wer FROM dp")
def single_wer(spark, d):
    a, b = word_arrays(text.norm_simple(F.col("text"))), word_arrays(text.norm_simple(F.col("pred")))
    p = spread(predictions(spark, d), "utterance_id").select("utterance_id", "model", a.alias("a"), b.alias("b"))
    return metrics.with_word_distance(p, "a", "b", "ed").select("utterance_id", "model", F.round(metrics.rate(F.col("ed"), F.size("a")), 8).alias("wer"))


#: Articulatory classes of some IPA symbols (voicing, manner, place; height, backness, rounding of vowels).
FEATURES = (
    ("p", "voiceless stop bilabial"), ("b", "voiced stop bilabial"), ("t", "voiceless stop alveolar"), ("d", "voiced stop alveolar"), ("k", "voiceless stop velar"), ("g", "voiced stop velar"),
    ("f", "voiceless fricative labiodental"), ("v", "voiced fricative labiodental"), ("s", "voiceless fricative alveolar"), ("z", "voiced fricative alveolar"), ("ʃ", "voiceless fricative postalveolar"), ("ʒ", "voiced fricative postalveolar"),
    ("θ", "voiceless fricative dental"), ("ð", "voiced fricative dental"), ("h", "voiceless fricative glottal"), ("ʧ", "voiceless affricate postalveolar"), ("ʤ", "voiced affricate postalveolar"), ("m", "voiced nasal bilabial"),
    ("n", "voiced nasal alveolar"), ("ŋ", "voiced nasal velar"), ("l", "voiced lateral alveolar"), ("ɹ", "voiced approximant postalveolar"), ("w", "voiced glide bilabial"), ("j", "voiced glide palatal"),
    ("i", "voiced vowel x high front unrounded"), ("ɪ", "voiced vowel x near-high front unrounded"), ("e", "voiced vowel x mid front unrounded"), ("ɛ", "voiced vowel x open-mid front unrounded"), ("æ", "voiced vowel x near-open front unrounded"),
    ("ɑ", "voiced vowel x open back unrounded"), ("ɔ", "voiced vowel x open-mid back rounded"), ("o", "voiced vowel x mid back rounded"), ("ʊ", "voiced vowel x near-high back rounded"), ("u", "voiced vowel x high back rounded"), ("ə", "voiced vowel x mid central unrounded"), ("ʌ", "voiced vowel x open-mid back unrounded"),
)


FEATURE_ROWS = ", ".join(f"('{a}', {[*f.split(), 'x', 'x', 'x'][:6]})" for a, f in FEATURES)


@query(f"WITH t(symbol, f) AS (VALUES {FEATURE_ROWS}), p AS (SELECT a.symbol AS a, b.symbol AS b, a.f AS fa, b.f AS fb FROM t a, t b) SELECT a, b, CASE WHEN a = b THEN 1.0 ELSE round(len(list_filter(range(1, 7), lambda i: fa[i] = fb[i] AND fa[i] <> 'x')) / greatest(len(list_filter(range(1, 7), lambda i: fa[i] <> 'x' OR fb[i] <> 'x')), 1)::DOUBLE, 8) END AS similarity FROM p")
def phonetic_similarity(spark, d):
    """Share of equal features among those that not both symbols lack; a fixed table of symbols joined with itself."""
    rows = [(s, [*f.split(), "x", "x", "x"][:6]) for s, f in FEATURES]
    t = spark.createDataFrame(rows, "symbol string, f array<string>")
    a, b = t.toDF("a", "fa"), t.toDF("b", "fb")
    pair = F.zip_with("fa", "fb", lambda x, y: F.struct(((x == y) & (x != "x")).cast("int").alias("same"), (~((x == "x") & (y == "x"))).cast("int").alias("counts")))
    total = lambda k: F.aggregate(pair, F.lit(0), lambda s, x: s + x[k])
    return a.crossJoin(F.broadcast(b)).select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.round(total("same") / F.greatest(total("counts"), F.lit(1)), 8)).alias("similarity"))


# ---- voting networks


def gathered(spark, d):
    """The whole hypotheses of an utterance in model order."""
    p = predictions(spark, d, dealt=True).select("utterance_id", F.struct("model", text.norm_simple(F.col("pred")).alias("x")).alias("h"))
    return p.groupBy("utterance_id").agg(F.array_sort(F.collect_list("h")).alias("h")).select("utterance_id", F.transform("h", lambda h: h["x"]).alias("hyps"))


@query()
def fuse_rover_progressive(spark, d):
    return map_rows(gathered(spark, d), lambda i, h: (i, kernels.rover_progressive(h)), "utterance_id string, pred string")


@query()
def fuse_rover_medoid(spark, d):
    """The last two models count one and a half times."""
    return map_rows(gathered(spark, d), lambda i, h: (i, kernels.rover_medoid(h, [1.0] * (len(h) - 2) + [1.5] * 2)), "utterance_id string, pred string")


# ---- lattices: a vector is eight frames of eight symbols


def lattice(v, shift=0):
    return kernels.log_softmax(np.roll(np.array(v, float) * 8, shift).reshape(-1, 8))


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


@query()
def ctc_beam(spark, d):
    return map_rows(vectors(spark, d), lambda i, v: (i, *((lambda b: (b[0], round(b[1], 6)))(kernels.beam(lattice(v), 8)[0]))), "vec_id long, labels array<int>, logp double")


@query()
def ctc_beam_nbest(spark, d):
    return flat_map_rows(vectors(spark, d), lambda i, v: [(i, k, *b) for k, b in enumerate(kernels.beam(lattice(v), 8, nbest=3))], "vec_id long, rank int, labels array<int>, logp double")


@query()
def ctc_force_align(spark, d):
    def f(i, v):
        x = lattice(v)
        a = kernels.force_align(x, kernels.greedy(x))
        return i, a["confidence"], a["frames"], a["blank_ratio"]

    return map_rows(vectors(spark, d), f, "vec_id long, confidence array<double>, frames array<int>, blank_ratio double")


def label_model(spark, d, order=3):
    """A language model of label sequences, those read off all lattices, as an automaton."""
    said = F.transform(lattices.greedy(F.col("l0")), lambda x: x.cast("string"))
    s = lattices_of(spark, d, 0).select(F.concat(F.array(F.lit(ngrams.BEGIN)), said, F.array(F.lit(ngrams.END))).alias("w"))
    return ngrams.automaton(*ngrams.estimate(s, "w", order), order)


@query()
def ctc_beam_lm(spark, d):
    """Beams that a language model of labels takes part in, at two weights; its state goes with each beam."""
    model = label_model(spark, d)  # goes with the function, by value
    symbols = [str(s) for s in range(8)]

    def f(i, v):
        x = lattice(v)
        return [(i, w, labels, round(score, 6)) for w in (0.3, 0.8) for labels, score in kernels.beam(x, 8, lm=model, weight=w, symbols=symbols)]

    return flat_map_rows(vectors(spark, d), f, "vec_id long, weight double, labels array<int>, score double")


@query()
def feat_alignment(spark, d):
    """Each candidate of three models' lattices: run lengths and sureness along its best path, and how far models disagree."""
    names = list(kernels.duration_features([], []))

    def f(i, v):
        models = [lattice(v, k) for k in range(3)]
        cands = list(dict.fromkeys(tuple(kernels.greedy(x)) for x in models))
        scores = np.array([[kernels.force_score(x, list(c)) for x in models] for c in cands])
        ranks = np.argsort(np.argsort(-scores, axis=0, kind="stable"), axis=0)
        out = []
        for k, c in enumerate(cands):
            a = kernels.force_align(models[0], list(c))
            own = kernels.duration_features(a["frames"], a["confidence"])
            out.append((i, k, list(c), float(scores[k].std()), float(ranks[k].std()), int(scores[k].argmax()), a["blank_ratio"], *[float(own[n]) for n in names]))
        return out

    return flat_map_rows(vectors(spark, d), f, "vec_id long, cand int, labels array<int>, model_ctc_std double, model_rank_std double, best_model int, blank_ratio double, " + ", ".join(f"{n} double" for n in names))


#: One row per vector, frame and symbol: log-probabilities of vectors turned by ``shift``, as SQL.
LATTICE = """{name} AS (SELECT vec_id, t, s, x - top - ln(sum(exp(x - top)) OVER (PARTITION BY vec_id, t)) AS lp FROM (
  SELECT *, max(x) OVER (PARTITION BY vec_id, t) AS top FROM (
    SELECT vec_id, ((i + {shift}) % 64) // 8 AS t, ((i + {shift}) % 64) % 8 AS s, embedding[i + 1]::DOUBLE * 8 AS x FROM embeddings, range(64) r(i))))"""
GREEDY = "(SELECT vec_id, list(CAST(b AS INTEGER) ORDER BY t) FILTER (WHERE b <> 0 AND b IS DISTINCT FROM before) AS labels FROM (SELECT *, lag(b) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM (SELECT vec_id, t, arg_max(s, {score}) AS b FROM {of} GROUP BY 1, 2)) GROUP BY 1)"


FORCED = f"""WITH RECURSIVE {LATTICE.format(name='l', shift=0)}, g AS {GREEDY.format(score='lp', of='l')},
f AS (SELECT vec_id, t, list(exp(lp) ORDER BY s) AS p FROM l GROUP BY 1, 2), z AS (SELECT vec_id, list(p ORDER BY t) AS p FROM f GROUP BY 1),
s AS (SELECT vec_id, p, coalesce(labels, []) AS labels, list_concat([0], flatten(list_transform(coalesce(labels, []), lambda x: [x, 0]))) AS st FROM z JOIN g USING (vec_id)),
r AS (SELECT vec_id, p, labels, st, 1 AS t, list_transform(range(1, len(st) + 1), lambda j: CASE WHEN j <= 2 THEN p[1][st[j] + 1] ELSE 0.0::DOUBLE END) AS a, p[1][1] AS e FROM s
  UNION ALL SELECT vec_id, p, labels, st, t + 1, list_transform(range(1, len(st) + 1), lambda j: (a[j] + CASE WHEN j > 1 THEN a[j - 1] ELSE 0 END + CASE WHEN j > 2 AND st[j] <> 0 AND st[j] <> st[j - 2] THEN a[j - 2] ELSE 0 END) * p[t + 1][st[j] + 1]), e * p[t + 1][1] FROM r WHERE t < len(p))
SELECT vec_id, CAST(len(labels) AS INTEGER) AS n, round(ln(a[len(a)] + CASE WHEN len(a) > 1 THEN a[len(a) - 1] ELSE 0 END), 6) AS logp, round(ln(e), 6) AS empty_logp FROM r WHERE t = len(p)"""


@query(FORCED)
def ctc_force_score(spark, d):
    """Log-probability of the labels read off greedily, over all their paths, and of no labels at all."""
    def f(i, v):
        x = lattice(v)
        labels = kernels.greedy(x)
        return i, len(labels), round(kernels.force_score(x, labels), 6), round(kernels.force_score(x, []), 6)

    return map_rows(vectors(spark, d), f, "vec_id long, n int, logp double, empty_logp double")


def lattices_of(spark, d, *shifts):
    e = vectors(spark, d)
    return e.select("vec_id", *[lattices.frames(F.col("embedding"), 8, 8.0, k).alias(f"l{i}") for i, k in enumerate(shifts)])


@query(f"WITH {LATTICE.format(name='l', shift=0)} SELECT vec_id, round(avg(exp(lp) * 0.5 / (1 - exp(lp) * 0.5)), 6) AS blank FROM l WHERE s = 0 GROUP BY 1")
def blank_scale(spark, d):
    """The mean probability of the blank after it is halved."""
    out = F.transform("l0", lambda f: lattices.scaled_blank(f, 0.5))
    return lattices_of(spark, d, 0).select("vec_id", F.round(lattices.total(out) / F.size("l0"), 6).alias("blank"))


@query(f"WITH {LATTICE.format(name='l', shift=0)}, f AS (SELECT vec_id, t, -sum(exp(lp) * ln(exp(lp) + 1e-12)) AS h, max(exp(lp)) AS top, max(CASE WHEN s = 0 THEN exp(lp) END) AS blank FROM l GROUP BY 1, 2) SELECT vec_id, round(avg(h), 6) AS entropy_mean, round(stddev_pop(h), 6) AS entropy_std, round(max(h), 6) AS entropy_max, round(avg(blank), 6) AS blank, round(avg(top), 6) AS top FROM f GROUP BY 1")
def entropy_features(spark, d):
    h, n = F.transform("l0", lattices.entropy), F.size("l0")
    l = lattices_of(spark, d, 0).withColumn("h", h).withColumn("m", lattices.total(F.col("h")) / n)
    spread_of = F.sqrt(lattices.total(F.transform("h", lambda x: (x - F.col("m")) * (x - F.col("m")))) / n)
    blank, top = F.transform("l0", lambda f: F.exp(F.get(f, F.lit(0)))), F.transform("l0", lambda f: F.exp(F.array_max(f)))
    return l.select("vec_id", F.round("m", 6).alias("entropy_mean"), F.round(spread_of, 6).alias("entropy_std"), F.round(F.array_max("h"), 6).alias("entropy_max"), F.round(lattices.total(blank) / n, 6).alias("blank"), F.round(lattices.total(top) / n, 6).alias("top"))


@query(f"WITH {LATTICE.format(name='x', shift=0)}, {LATTICE.format(name='y', shift=1)}, f AS (SELECT vec_id, t, arg_max(x.s, x.lp) = arg_max(x.s, y.lp) AS same, sum(exp(x.lp) * exp(y.lp)) / (sqrt(sum(exp(x.lp) * exp(x.lp))) * sqrt(sum(exp(y.lp) * exp(y.lp)))) AS cosine FROM x JOIN y USING (vec_id, t, s) WHERE t < 7 GROUP BY 1, 2) SELECT vec_id, count(*)::INTEGER AS n_frames, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(cosine), 6) AS cosine FROM f GROUP BY 1")
def agg_frame_agreement(spark, d):
    """Two models' frames, cut to the shorter: how often their best symbols agree, and the mean cosine of their probabilities."""
    l = lattices_of(spark, d, 0, 1).select("vec_id", F.col("l0").alias("a"), F.slice("l1", F.lit(1), F.size("l1") - 1).alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    pairs = F.arrays_zip(F.slice("a", F.lit(1), n).alias("x"), F.slice("b", F.lit(1), n).alias("y"))
    dot = lambda x, y: lattices.total(F.zip_with(x, y, lambda p, q: F.exp(p) * F.exp(q)))
    top = lambda x: F.array_position(x, F.array_max(x))
    same = F.size(F.filter(pairs, lambda z: top(z["x"]) == top(z["y"])))
    cosine = lattices.total(F.transform(pairs, lambda z: dot(z["x"], z["y"]) / F.greatest(F.sqrt(dot(z["x"], z["x"])) * F.sqrt(dot(z["y"], z["y"])), F.lit(1e-12))))
    return l.select("vec_id", n.alias("n_frames"), F.round(same / n, 6).alias("agreement"), F.round(cosine / n, 6).alias("cosine"))


ALL_THREE = "a AS (SELECT x.vec_id, x.t, x.s, x.lp + y.lp + z.lp AS mean, greatest(x.lp, y.lp, z.lp) AS most, exp(x.lp) + exp(y.lp) + exp(z.lp) AS lme FROM x JOIN y USING (vec_id, t, s) JOIN z USING (vec_id, t, s) WHERE t < 7)"


@query(f"WITH {LATTICE.format(name='x', shift=0)}, {LATTICE.format(name='y', shift=1)}, {LATTICE.format(name='z', shift=2)}, {ALL_THREE}, m AS {GREEDY.format(score='mean', of='a')}, k AS {GREEDY.format(score='most', of='a')}, e AS {GREEDY.format(score='lme', of='a')} SELECT m.vec_id, coalesce(m.labels, []) AS mean, coalesce(k.labels, []) AS most, coalesce(e.labels, []) AS logmeanexp FROM m JOIN k USING (vec_id) JOIN e USING (vec_id)")
def fuse_logprob(spark, d):
    """Three models, the second a frame shorter, fused in three ways and read off greedily."""
    l = lattices_of(spark, d, 0, 1, 2)
    models = [F.col("l0"), F.slice("l1", F.lit(1), F.size("l1") - 1), F.col("l2")]
    return l.select("vec_id", *[lattices.greedy(lattices.fused(models, how)).alias(name) for how, name in (("mean", "mean"), ("max", "most"), ("logmeanexp", "logmeanexp"))])


@query(f"WITH {LATTICE.format(name='x', shift=0)}, {LATTICE.format(name='y', shift=3)}, a AS (SELECT vec_id, t, s, 0.6 * exp(x.lp) + 0.4 * exp(y.lp) AS p, 0.6 * x.lp + 0.4 * y.lp AS q FROM x JOIN y USING (vec_id, t, s) WHERE t < 7), m AS {GREEDY.format(score='p', of='a')}, k AS {GREEDY.format(score='q', of='a')} SELECT m.vec_id, coalesce(m.labels, []) AS arithmetic, coalesce(k.labels, []) AS geometric FROM m JOIN k USING (vec_id)")
def fuse_posterior_pair(spark, d):
    """Two models of at most one frame between them; more than that fails."""
    l = lattices_of(spark, d, 0, 3)
    a, b = F.col("l0"), F.slice("l1", F.lit(1), F.size("l1") - 1)
    near = F.when(F.abs(F.size(a) - F.size(b)) > 1, F.raise_error(F.lit("lattices differ by more than one frame")).cast("boolean")).otherwise(True)
    return l.where(near).select("vec_id", *[lattices.greedy(lattices.fused([a, b], how, [0.6, 0.4])).alias(name) for how, name in (("logmeanexp", "arithmetic"), ("mean", "geometric"))])


@query("SELECT vec_id, len(embedding) // 8 AS frames, embedding FROM embeddings WHERE vec_id IS NOT NULL")
def scan_npz_packed(spark, d):
    """Lattices of eight symbols packed into files, end to end with offsets and lengths, and read again by ranges."""
    path = new_path(spark, "packed")
    packed.write_packed(vectors(spark, d), path, "vec_id", "embedding", 8)
    back = packed.read_packed(packed.index_of(spark, path))
    return back.select(F.col("key").cast("long").alias("vec_id"), F.col("frames").cast("long").alias("frames"), F.col("values").alias("embedding"))


# ---- language models


def bigram_rows(spark, d):
    w = F.concat(F.array(F.lit("<s>")), text.words(F.col("text")), F.array(F.lit("</s>")))
    u = utterances(spark, d).select("utterance_id", w.alias("w"))
    pairs = F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("prev"), F.slice("w", F.lit(2), F.size("w") - 1).alias("cur"))).alias("x")
    return u.select("utterance_id", pairs).select("utterance_id", "x.*")


PAIRS = "g AS (SELECT utterance_id, CASE WHEN i = 0 THEN '<s>' ELSE w[i] END AS prev, CASE WHEN i = len(w) THEN '</s>' ELSE w[i + 1] END AS cur FROM (SELECT utterance_id, w, unnest(range(0, len(w) + 1)) AS i FROM (SELECT utterance_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM u)))"


@query(f"WITH {U}, {PAIRS}, c AS (SELECT prev, cur, ln(greatest(count(*) / sum(count(*)) OVER (PARTITION BY prev)::DOUBLE, 1e-10)) AS logp FROM g GROUP BY 1, 2) SELECT utterance_id, round(sum(logp), 5) AS score FROM g JOIN c USING (prev, cur) GROUP BY 1")
def bigram_score(spark, d):
    g = bigram_rows(spark, d)
    c = g.groupBy("prev", "cur").agg(F.count("*").alias("n")).withColumn("logp", F.log(F.greatest(F.col("n") / F.sum("n").over(W.partitionBy("prev")), F.lit(1e-10))))
    # an utterance's pairs are summed before they are looked up
    each = g.groupBy("utterance_id", "prev", "cur").agg(F.count("*").alias("times"))
    return each.join(c.select("prev", "cur", "logp"), ["prev", "cur"]).groupBy("utterance_id").agg(F.round(F.sum(F.col("logp") * F.col("times")), 5).alias("score"))


@query(f"WITH {U}, {PAIRS}, s AS (SELECT * FROM u WHERE source = 'dd'), t AS (SELECT g.* FROM g JOIN s USING (utterance_id)), c2 AS (SELECT prev, cur, count(*) / sum(count(*)) OVER (PARTITION BY prev)::DOUBLE AS p FROM t GROUP BY 1, 2), c1 AS (SELECT cur, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM t GROUP BY 1) SELECT utterance_id, round(sum(CASE WHEN c2.p IS NOT NULL THEN ln(c2.p) WHEN c1.p IS NOT NULL THEN ln(0.4) + ln(c1.p) ELSE -20.0 END), 5) AS score FROM g LEFT JOIN c2 ON g.prev = c2.prev AND g.cur = c2.cur LEFT JOIN c1 ON g.cur = c1.cur GROUP BY 1")
def lm_score_word(spark, d):
    """Stupid backoff learnt from the competition's texts: a factor of 0.4 for each level given up, -20 for the unknown."""
    g = bigram_rows(spark, d)
    t = g.join(utterances(spark, d).where("source = 'dd'").select("utterance_id"), "utterance_id", "left_semi")
    c2 = t.groupBy("prev", "cur").agg(F.count("*").alias("n")).select("prev", "cur", (F.col("n") / F.sum("n").over(W.partitionBy("prev"))).alias("p2"))
    total = t.agg(F.count("*").alias("total"))
    c1 = t.groupBy("cur").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("cur", (F.col("n") / F.col("total")).alias("p1"))
    each = g.groupBy("utterance_id", "prev", "cur").agg(F.count("*").alias("times"))
    out = each.join(c2, ["prev", "cur"], "left").join(c1, "cur", "left")
    logp = F.when(F.col("p2").isNotNull(), F.log("p2")).when(F.col("p1").isNotNull(), F.log(F.lit(0.4)) + F.log("p1")).otherwise(-20.0)
    return out.groupBy("utterance_id").agg(F.round(F.sum(logp * F.col("times")), 5).alias("score"))


def _kneser_ney(order: int) -> str:
    """The same estimates in SQL, from r (n, ctx, tok, c): p and b."""
    out = [f"k{order} AS (SELECT ctx, tok, c FROM r WHERE n = {order})"]
    cut = "CASE WHEN strpos(ctx, ' ') = 0 THEN '' ELSE substr(ctx, strpos(ctx, ' ') + 1) END"
    for n in range(order - 1, 0, -1):
        out.append(f"k{n} AS (SELECT ctx, tok, c FROM r WHERE n = {n} UNION ALL SELECT {cut} AS ctx, tok, count(*) AS c FROM k{n + 1} GROUP BY 1, 2)")
    for n in range(1, order + 1):
        out.append(f"n{n} AS (SELECT count_if(c = 1)::DOUBLE AS n1, count_if(c = 2)::DOUBLE AS n2, count_if(c = 3)::DOUBLE AS n3, count_if(c = 4)::DOUBLE AS n4, count(*) AS size FROM k{n})")
        out.append(f"y{n} AS (SELECT *, 1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1 AS a, 2 - 3 * n1 / (n1 + 2 * n2) * n3 / n2 AS b, 3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3 AS d FROM n{n})")
        out.append(f"d{n} AS (SELECT size, ok, CASE WHEN ok THEN a ELSE 0.5 END AS d1, CASE WHEN ok THEN b ELSE 1.0 END AS d2, CASE WHEN ok THEN d ELSE 1.5 END AS d3 FROM (SELECT *, coalesce(n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AND a > 0 AND a <= 1 AND b > 0 AND b <= 2 AND d > 0 AND d <= 3, FALSE) AS ok FROM y{n}))")
        taken = "CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
        out.append(f"t{n} AS (SELECT ctx, sum(c) AS total, sum({taken}) / sum(c) AS gamma FROM k{n}, d{n} GROUP BY 1)")
        low = "gamma / (size + 1)" if n == 1 else "gamma * l.p"
        join = "" if n == 1 else f" JOIN p{n - 1} l ON l.tok = k.tok AND l.ctx = {cut.replace('ctx', 'k.ctx')}"
        out.append(f"p{n} AS (SELECT k.ctx, k.tok, (c - {taken}) / total + {low} AS p FROM k{n} k JOIN t{n} t ON t.ctx = k.ctx{join}, d{n})")
    out.append("p AS (" + " UNION ALL ".join(f"SELECT ctx, tok, ln(p) AS lp FROM p{n}" for n in range(1, order + 1)) + ")")
    out.append("b AS (" + " UNION ALL ".join(f"SELECT ctx, ln(gamma) AS bow FROM t{n}" for n in range(2, order + 1)) + ")")
    return ", ".join(out)


BACKOFF = f"WITH {U}, w AS (SELECT utterance_id, source, list_concat(['<s>'], list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> ''), ['</s>']) AS w FROM u WHERE text IS NOT NULL), e AS (SELECT utterance_id, source, w[i + 1] AS tok, array_to_string(w[greatest(i - 1, 1) : i], ' ') AS ctx, least(3, i + 1) AS n FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)), r AS (SELECT n, ctx, tok, count(*) AS c FROM e WHERE source = 'dd' GROUP BY ALL), {_kneser_ney(3)}, s AS (SELECT utterance_id, tok, ctx AS c0, CASE WHEN n = 3 THEN substr(ctx, strpos(ctx, ' ') + 1) ELSE '' END AS c1, CASE WHEN n = 3 THEN '' END AS c2 FROM e) SELECT utterance_id, round(sum(coalesce(p0.lp, coalesce(b0.bow, 0) + p1.lp, coalesce(b0.bow, 0) + coalesce(b1.bow, 0) + p2.lp, -20.0)), 5) AS score FROM s LEFT JOIN p p0 ON p0.ctx = c0 AND p0.tok = s.tok LEFT JOIN p p1 ON p1.ctx = c1 AND p1.tok = s.tok LEFT JOIN p p2 ON p2.ctx = c2 AND p2.tok = s.tok LEFT JOIN b b0 ON b0.ctx = c0 LEFT JOIN b b1 ON b1.ctx = c1 GROUP BY 1"


@query(BACKOFF)
def lm_score_arpa(spark, d):
    """Interpolated Kneser-Ney of order three, learnt from the competition's texts, through ARPA text to scores of all."""
    s = utterances(spark, d).where("text IS NOT NULL").select("utterance_id", "source", ngrams.padded(F.col("text")).alias("w"))
    path = new_path(spark, "arpa")
    ngrams.write_arpa(*ngrams.estimate(s.where("source = 'dd'"), "w", 3), 3, path)
    return ngrams.score(s, "utterance_id", "w", *ngrams.read_arpa(spark, path), 3).select("utterance_id", F.round("logp", 5).alias("score"))


# ---- timestamps, segments, chunks


def spoken(spark, d):
    """Words with start and duration: a word lasts as long as it has letters, and sentence ends pause."""
    w = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1), lambda x: x != "")
    return utterances(spark, d).select("utterance_id", w.alias("w"))


def timed(words):
    at, out = 0.0, []
    for w in words:
        out.append((at, len(w) / 15))
        at += len(w) / 15 + (0.4 if w[-1] in ".," else 0.05)
    return out


@query()
def segment_words(spark, d):
    def f(i, w):
        t = timed(w)
        return [(f"{i}_{k:03d}", t[a][0], t[b - 1][0] + t[b - 1][1], " ".join(w[a:b])) for k, (a, b) in enumerate(kernels.segment_words(t, 6.5))]

    return flat_map_rows(spoken(spark, d), f, "id string, start double, stop double, text string")


@query()
def lis_fix_timestamps(spark, d):
    def f(i, w):
        times = [int(1000 * s) - (700 if k % 7 == 3 else 0) for k, (s, _) in enumerate(timed(w))]
        return i, kernels.fix_timestamps(times)

    return map_rows(spoken(spark, d), f, "utterance_id string, times array<int>")


@query()
def chunk_low_energy(spark, d):
    return flat_map_rows(vectors(spark, d), lambda i, v: [(i, k, *x) for k, x in enumerate(kernels.chunk_low_energy(np.array(v), 16, 1.0, 0.25, 0.25))], "vec_id long, part int, start int, stop int, samples int")


@query()
def chunk_vad(spark, d):
    """Chunks of speech: a letter is a frame of 64 ms that is surely speech, a space may be, a stop is not."""
    def f(i, t):
        p = [0.02 if c in ".,;\n" else 0.4 if c == " " else 0.95 for c in t]

        def find(threshold, silence):
            spans = machines.speech_spans(p, threshold, steps=max(1, round(silence / 0.064)), least=4, pad=3)
            return [(a * 0.064, b * 0.064) for a, b in spans]

        return [(i, k, round(a, 6), round(b, 6)) for k, (a, b) in enumerate(kernels.chunk_speech(find, len(p) * 0.064, 10.0))]

    return flat_map_rows(utterances(spark, d).select("utterance_id", "text").where("text IS NOT NULL"), f, "utterance_id string, part int, start double, stop double")


@query("SELECT vec_id, list_concat(embedding[1:8], embedding[33:40]) AS kept, embedding[9:] AS rest FROM embeddings")
def spans_collect(spark, d):
    """The samples inside some spans, and those outside others."""
    def inside(i, spans):
        return F.exists(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in spans]), lambda s: (i >= s["a"]) & (i < s["b"]))

    kept = F.filter("embedding", lambda x, i: inside(i, [(0, 8), (32, 40)]))
    return vectors(spark, d).select("vec_id", kept.alias("kept"), F.filter("embedding", lambda x, i: ~inside(i, [(0, 8)])).alias("rest"))


# ---- signals: a vector is a short wave


#: A vector over and over is a wave with a pitch: so many times.
TURNS = 64


@query()
def dsp_metrics(spark, d):
    names = ("rms_db", "peak_db", "centroid", "band_ratio", "snr", "zero_crossings", "clipped", "score")

    def f(i, v):
        m = kernels.signal_metrics(np.array(v))
        return (i, *[m[n] for n in names], signals.mean_pitch(np.tile(v, TURNS), 16000) if len(v) else None)

    return map_rows(vectors(spark, d), f, "vec_id long, " + ", ".join(f"{n} double" for n in names) + ", pitch double")


@query()
def dsp_scan(spark, d):
    """Files of waves of several rates, depths and channels, written and read again; a file that fails is a row with its error."""
    def pack(i, v):
        wave = np.tile(v, TURNS) if len(v) else np.zeros(0)
        content = signals.write_wav(np.stack([wave, wave * 0.5], 1) if i % 3 == 0 else wave, 16000 if i % 2 else 8000, (16, 24, 32)[i % 3])
        return f"{i % 10}/{i}.wav", content[: len(content) // 2] if i % 17 == 5 else b"not a wave" if i % 17 == 6 else content

    path = new_path(spark, "waves")
    writers.files(map_rows(vectors(spark, d).where("vec_id IS NOT NULL AND embedding IS NOT NULL"), pack, "name string, content binary"), path)
    return readers.waves(spark, path)


@query()
def dsp_clean(spark, d):
    """Spikes out, noise gated, level set: what is left of each wave."""
    def f(i, v):
        x = kernels.clean(signals.denoised(np.tile(v, TURNS)) if len(v) else np.zeros(0))
        return i, float(np.sqrt((x**2).mean())) if len(x) else 0.0, float(np.abs(x).max(initial=0.0))

    return map_rows(vectors(spark, d), f, "vec_id long, rms double, peak double")


@query()
def dsp_speed(spark, d):
    """Each wave, and the same slower and faster by a tenth: how long, how loud, and its values to four digits as a digest."""
    def told(name, x):
        values = ",".join(f"{z + 0.0:.4f}" for z in np.round(x, 4))
        return name, len(x), float(np.round(np.sqrt((x**2).mean()), 6)) if len(x) else 0.0, hashlib.md5(values.encode()).hexdigest()

    def f(i, v):
        x = np.array(v, float)
        return [told(str(i), x)] + [told(f"{i}_sp{round(s * 10):02d}", signals.change_speed(x, s)) for s in (0.9, 1.1)]

    return flat_map_rows(vectors(spark, d), f, "id string, n int, rms double, digest string")


DRAWN = "CAST('0x' || substr(md5('{seed}:' || vec_id), 1, 8) AS BIGINT)"


@query(f"SELECT vec_id, CAST({DRAWN.format(seed='noise')} % 8 AS INTEGER) AS noise, CAST({DRAWN.format(seed='from')} % 64 AS INTEGER) AS begins, round(5 + 15 * ({DRAWN.format(seed='snr')} / 4294967296.0::DOUBLE), 6) AS snr, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) * pow(10, -(5 + 15 * ({DRAWN.format(seed='snr')} / 4294967296.0::DOUBLE)) / 20), 6) AS added FROM embeddings WHERE CAST({DRAWN.format(seed='take')} AS DOUBLE) / 4294967296.0 < 0.5")
def dsp_noise_mix(spark, d):
    """Half the waves by a draw, each with a drawn clip of noise from a drawn place, tiled and brought to a drawn level.

    The plan is made of hashes of ids alone, so it can be made again; what the mix has added is measured on its values.
    """
    draw = lambda seed: F.conv(F.substring(splits.hashed("vec_id", seed), 1, 8), 16, 10).cast("long")
    plan = vectors(spark, d).where(draw("take") / F.lit(2.0**32) < 0.5)
    plan = plan.select("vec_id", (draw("noise") % 8).cast("int").alias("noise"), (draw("from") % 64).cast("int").alias("begins"), (5 + 15 * (draw("snr") / F.lit(2.0**32))).alias("snr"), "embedding")
    clips = [np.sin(np.arange(200) * (0.3 + 0.1 * k)) for k in range(8)]

    def f(i, k, begins, snr, v):
        x = np.array(v, float)
        added = kernels.mix_noise(x, clips[k][begins:], snr) - x
        return i, k, begins, round(snr, 6), round(float(np.sqrt((added**2).mean())), 6)

    return map_rows(plan, f, "vec_id long, noise int, begins int, snr double, added double")


@query(f"WITH {U}, t AS (SELECT utterance_id, source, '^^' || text AS t FROM u), g AS (SELECT utterance_id, source, substr(t, i, 2) AS c2, substr(t, i + 1, 1) AS c1, substr(t, i + 2, 1) AS nxt FROM (SELECT *, unnest(range(1, length(t) - 1)) AS i FROM t)), l AS (SELECT * FROM g WHERE source = 'dd'), p2 AS (SELECT c2, nxt, count(*) / sum(count(*)) OVER (PARTITION BY c2)::DOUBLE AS p FROM l GROUP BY 1, 2), p1 AS (SELECT c1, nxt, count(*) / sum(count(*)) OVER (PARTITION BY c1)::DOUBLE AS p FROM l GROUP BY 1, 2) SELECT utterance_id, round(sum(CASE WHEN p2.p IS NOT NULL THEN ln(p2.p) WHEN p1.p IS NOT NULL THEN ln(0.4) + ln(p1.p) ELSE -20.0 END), 5) AS score FROM g LEFT JOIN p2 ON g.c2 = p2.c2 AND g.nxt = p2.nxt LEFT JOIN p1 ON g.c1 = p1.c1 AND g.nxt = p1.nxt GROUP BY 1")
def lm_score_char(spark, d):
    """Characters after two, else one before them, learnt from the competition's texts. Contexts are a bounded table."""
    t = utterances(spark, d).select("utterance_id", "source", F.concat(F.lit("^^"), "text").alias("t")).where(F.length("t") > 2)
    g = t.select("utterance_id", "source", F.split("t", "", -1).alias("c"), F.length("t").alias("n"))
    at = lambda i: F.get("c", i)
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.concat(at(i), at(i + 1)).alias("c2"), at(i + 1).alias("c1"), at(i + 2).alias("nxt")))
    g = g.select("utterance_id", "source", F.explode(grams).alias("g")).select("utterance_id", "source", "g.*")
    learnt = g.where("source = 'dd'")

    def share(c, name):
        return learnt.groupBy(c, "nxt").agg(F.count("*").alias("n")).select(c, "nxt", (F.col("n") / F.sum("n").over(W.partitionBy(c))).alias(name))

    # occurrences are summed per utterance first, so each context is looked up once
    g = g.groupBy("utterance_id", "c2", "c1", "nxt").agg(F.count("*").alias("times"))
    out = g.join(share("c2", "p2"), ["c2", "nxt"], "left").join(share("c1", "p1"), ["c1", "nxt"], "left")
    logp = F.when(F.col("p2").isNotNull(), F.log("p2")).when(F.col("p1").isNotNull(), F.log(F.lit(0.4)) + F.log("p1")).otherwise(-20.0)
    return out.groupBy("utterance_id").agg(F.round(F.sum(logp * F.col("times")), 5).alias("score"))


@query()
def align_del_pref(spark, d):
    """The path that prefers deletions to insertions is read off the reversed alignment."""
    p = spread(predictions(spark, d), "utterance_id").where("pred <> text").select("utterance_id", "model", *word_rows())
    swap = {"match": "match", "sub": "sub", "del": "ins", "ins": "del"}
    return map_rows(p, lambda i, m, r, h: (i, m, "".join(swap[op][0] for op, _, _ in kernels.edit_ops(h, r))), "utterance_id string, model int, path string")


#: Pairs of sounds that a rescorer may exchange.
CONFUSABLE = (("ə", "ʌ"), ("ɪ", "i"), ("ɛ", "æ"), ("ɔ", "ɑ"), ("e", "ɛ"), ("ɹ", "ɚ"), ("d", "ð"))
#: What a lattice's symbols stand for: three pairs of those, and one sound that is in none.
SOUNDS = [None, "ə", "ʌ", "ɪ", "i", "ɛ", "æ", "n"]
PAIR_OF = {s: (k, c) for k, pair in enumerate(CONFUSABLE[:3]) for c, s in enumerate(pair)}
RESCORE_FOLDS = 3


def heard_lattice(v):
    """A lattice as a recogniser hears it that finds the first sound of a pair a little likelier wherever the second is said."""
    x = lattice(v)
    for first, second in ((1, 2), (3, 4), (5, 6)):
        x[:, first] = np.maximum(x[:, first], x[:, second] + 0.5)
    return kernels.log_softmax(x)


def span_features(logp, v, span, kind):
    """Duration, pitch, energy, both sounds' mean log-probabilities over an aligned span, and which of them is likelier."""
    a, b = span
    wave = np.array(v[8 * a : 8 * b], float)
    first, second = (SOUNDS.index(x) for x in CONFUSABLE[kind])
    p0, p1 = logp[a:b, first].mean(), logp[a:b, second].mean()
    pitch = signals.mean_pitch(np.tile(wave, TURNS), 16000) or 0.0
    return [(b - a) / 4, pitch / 1000, 8 * float(np.sqrt((wave**2).mean())), float(p0) / 10, float(p1) / 10, float(p1 > p0)]


def confusable_spans(logp, v, labels):
    """(place, kind, class, features) of each label of a pair along the best path."""
    a = kernels.force_align(logp, labels)
    return [(i, *PAIR_OF[SOUNDS[s]], span_features(logp, v, span, PAIR_OF[SOUNDS[s]][0])) for i, (s, span) in enumerate(zip(labels, a["spans"], strict=False)) if SOUNDS[s] in PAIR_OF]


@query()
def vowel_rescore(spark, d):
    """A pair's sound becomes the other where a classifier of its aligned span says so, one that no utterance of the same
    fold has trained. Truth is aligned for training, what was heard for correction."""
    fold = F.pmod(F.xxhash64("vec_id"), F.lit(RESCORE_FOLDS)).cast("int")
    rows = vectors(spark, d).where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", fold.alias("fold"), "embedding")

    def learnt(f, v):
        return [(kind, f, float(c), x) for _, kind, c, x in confusable_spans(heard_lattice(v), v, kernels.greedy(lattice(v)))]

    spans = materialise(flat_map_rows(rows.select("fold", "embedding"), learnt, "kind int, fold int, y double, x array<double>"), "spans")
    models = spark.sparkContext.broadcast(classifiers.train(spans, 6, RESCORE_FOLDS))

    def mended(i, f, v):
        x = heard_lattice(v)
        labels = kernels.greedy(x)
        said = [SOUNDS[s] for s in labels]
        after = list(said)
        for at, kind, _, features in confusable_spans(x, v, labels):
            w = models.value.get((kind, f))
            if w is not None:
                after[at] = CONFUSABLE[kind][int(classifiers.probability(w, np.array(features)[None, :])[0] >= 0.5)]
        return i, "".join(SOUNDS[s] for s in kernels.greedy(lattice(v))), "".join(said), "".join(after)

    return map_rows(rows, mended, "vec_id long, truth string, before string, after string")

"""Rerank features of candidate texts: one row per utterance and different text, from the texts and scores of its models.

An utterance's models are gathered once; every feature is an expression over that short array, so no family joins anew.
What a candidate lacks is -1, not null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import lattices, metrics
from voxframe.operators import fusion

ABSENT = -1


def pool(p: DataFrame, key: str = "key", carry: Sequence[str] = ()) -> DataFrame:
    """(utterance_id, cand, at, models, texts, apart, *carry), one row for each different text of an utterance.

    ``models`` is an array of (model, key, score) in model order, ``texts`` the different texts, of which the candidate is
    number ``at``, and ``apart`` their edit distances below the diagonal: each two are compared once, whatever is asked.
    """
    first = [F.min_by(c, "model").alias(c) for c in carry]
    g = fusion.dealt(p).groupBy("utterance_id").agg(F.array_sort(F.collect_list(F.struct("model", F.col(key).alias("key"), "score"))).alias("models"), *first)
    g = g.withColumn("texts", F.array_distinct(F.transform("models", lambda m: m["key"])))
    g = fusion.with_distances(g, {"texts": "apart"})
    return g.select("utterance_id", F.posexplode("texts").alias("_at", "cand"), "models", "texts", "apart", *carry).withColumn("at", F.col("_at") + 1).drop("_at")


def edits_to(text: Column) -> Column:
    """Edits between the candidate and one of the utterance's texts, looked up; null where the text is none of them."""
    other = F.array_position("texts", text).cast("int")
    hi, lo = F.greatest("at", other), F.least("at", other)
    return F.when(other == F.col("at"), 0).when(other > 0, F.element_at(F.element_at("apart", hi), F.greatest(lo, F.lit(1))))


def _of(model: int, field: str) -> Column:
    return F.get(F.filter("models", lambda m: m["model"] == model), F.lit(0))[field]


def _or_absent(c: Column, kind: str = "double") -> Column:
    return F.coalesce(c.cast(kind), F.lit(ABSENT).cast(kind))


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def by_length(edits: Column, a: Column) -> Column:
    """Edits between a text and the candidate by the length of the longer."""
    return edits / F.greatest(F.length(a), F.length("cand"), F.lit(1))


def scores(n_models: int) -> dict[str, Column]:
    """A candidate's score from each model that has it, and their spread."""
    mine = F.transform(F.filter("models", lambda m: m["key"] == F.col("cand")), lambda m: m["score"])
    n = F.size(mine)
    mean = lattices.total(mine) / n
    each = {f"ctc_score_{m}": _or_absent(F.when(_of(m, "key") == F.col("cand"), _of(m, "score"))) for m in range(n_models)}
    return each | {"score_mean": mean, "score_std": F.sqrt(lattices.total(F.transform(mine, lambda x: (x - mean) * (x - mean))) / n), "score_min": F.array_min(mine), "score_max": F.array_max(mine), "score_range": F.array_max(mine) - F.array_min(mine), "n_score_models": n}


def beam_ranks(n_models: int, nbest: int) -> dict[str, Column]:
    """Places in the models' lists, for a column ``beams``: an array of (model, rank, key). Absent ones count as ``nbest`` in the mean."""
    def best(model: int) -> Column:
        return F.array_min(F.transform(F.filter("beams", lambda b: (b["model"] == model) & (b["key"] == F.col("cand"))), lambda b: b["rank"]))

    rank = {m: best(m) for m in range(n_models)}
    filled = [F.coalesce(r, F.lit(nbest)) for r in rank.values()]
    return {f"beam_rank_{m}": _or_absent(r, "int") for m, r in rank.items()} | {
        "rank_mean": sum(filled[1:], filled[0]) / n_models, "rank_min": F.least(*filled), "rank_max": F.greatest(*filled),
        "n_models_has": sum((r.isNotNull().cast("int") for r in rank.values()), F.lit(0)), "n_models_in_top3": sum((F.coalesce(r < 3, F.lit(False)).cast("int") for r in rank.values()), F.lit(0)), "n_exact_best": sum((F.coalesce(r == 0, F.lit(False)).cast("int") for r in rank.values()), F.lit(0)),
    }


def dual_heads(ctc: int, tdt: int, primary: int) -> dict[str, Column]:
    """Which heads of one network say the candidate, and whether they agree."""
    says = {name: F.coalesce(_of(m, "key") == F.col("cand"), F.lit(False)).cast("int") for name, m in (("ctc", ctc), ("tdt", tdt), ("primary", primary))}
    both = _of(ctc, "key").isNotNull() & _of(tdt, "key").isNotNull()
    return {f"is_dual_{k}": v for k, v in says.items()} | {"dual_heads_agree": _or_absent(F.when(both, (_of(ctc, "key") == _of(tdt, "key")).cast("int")), "int"), "dual_len_gap": _or_absent(F.when(both, F.abs(F.length(_of(ctc, "key")) - F.length(_of(tdt, "key")))), "int"), "n_dual_hits": says["ctc"] + says["tdt"]}


def heads_against(models: Sequence[int]) -> dict[str, Column]:
    """How each head's text differs from the candidate, with the mean and least over the heads that there are."""
    out: dict[str, Column] = {}
    edits = []
    for m in models:
        head = _of(m, "key")
        edits.append(by_length(edits_to(head), head))
        out |= {f"len_diff_{m}": F.coalesce(F.length(head) - F.length("cand"), F.lit(0)), f"space_diff_{m}": F.coalesce(spaces(head) - spaces(F.col("cand")), F.lit(0)), f"edit_{m}": _or_absent(edits_to(head), "int"), f"norm_edit_{m}": _or_absent(edits[-1])}
    there = F.filter(F.array(*edits), lambda x: x.isNotNull())
    return out | {"norm_edit_mean": _or_absent(F.when(F.size(there) > 0, lattices.total(there) / F.size(there))), "norm_edit_min": _or_absent(F.array_min(there))}


def word_head(head: int, primary: int) -> dict[str, Column]:
    """The head of another task: its score and gap to the primary's, lengths, and how far its text is from the candidate."""
    own = _of(head, "key")
    return {"word_score": _or_absent(_of(head, "score")), "word_gap": F.coalesce(_of(head, "score") - _of(primary, "score"), F.lit(0.0)), "word_len": _or_absent(F.length(own), "int"), "word_spaces": _or_absent(spaces(own), "int"), "word_edit": _or_absent(edits_to(own), "int"), "word_norm_edit": _or_absent(by_length(edits_to(own), own))}


def word_label(label: Column, edits: Column) -> dict[str, Column]:
    """Against a label that some utterances have; its ``edits`` to the candidate are the caller's."""
    flag = lambda c: _or_absent(c.cast("int"), "int")
    return {"has_label": label.isNotNull().cast("int"), "label_len": _or_absent(F.length(label), "int"), "label_edit": _or_absent(edits, "int"), "label_norm_edit": _or_absent(by_length(edits, label)), "label_same_len": flag(F.length(label) == F.length("cand")), "label_same_spaces": flag(spaces(label) == spaces(F.col("cand"))), "label_exact": flag(label == F.col("cand"))}


def second_scorer(df: DataFrame, model: int) -> DataFrame:
    """Adds what another scorer says: whether it has the candidate, its score there, and the score against the utterance's others."""
    w = W.partitionBy("utterance_id")
    hit = F.exists("models", lambda m: (m["model"] == model) & (m["key"] == F.col("cand")))
    masked = F.array_max(F.transform(F.filter("models", lambda m: m["key"] == F.col("cand")), lambda m: F.when(m["model"] >= model, m["score"])))
    df = df.withColumns({"second_hit": hit.cast("int"), "_s": masked, "second_len_diff": F.coalesce(F.length(_of(model, "key")) - F.length("cand"), F.lit(0)), "second_space_diff": F.coalesce(spaces(_of(model, "key")) - spaces(F.col("cand")), F.lit(0))})
    df = df.withColumns({"_n": F.count("_s").over(w), "_mean": F.avg("_s").over(w), "_sd": F.stddev_samp("_s").over(w), "second_rank": F.rank().over(w.orderBy(F.col("_s").desc_nulls_last())), "_top": F.sort_array(F.collect_list("_s").over(w), asc=False)})
    runner_up = F.when(F.col("_s") == F.get("_top", F.lit(0)), F.coalesce(F.get("_top", F.lit(1)), F.get("_top", F.lit(0)))).otherwise(F.get("_top", F.lit(0)))
    return df.select("utterance_id", "cand", "second_hit", "second_len_diff", "second_space_diff", _or_absent(F.col("_s")).alias("second_score"), "second_rank", F.round(F.col("second_rank") / F.count("*").over(w), 8).alias("second_pct"), F.round(F.coalesce((F.col("_s") - F.col("_mean")) / F.greatest("_sd", F.lit(1e-8)), F.lit(0.0)), 6).alias("second_z"), F.round(F.coalesce(F.col("_s") - F.col("_mean"), F.lit(0.0)), 8).alias("second_centered"), F.round(F.coalesce(F.col("_s") - runner_up, F.lit(0.0)), 8).alias("second_margin"))


def auxiliary(ages: Column, domain: Column, predicted_chars: Column, predicted_spaces: Column) -> dict[str, Column]:
    """Probabilities of auxiliary heads from their raw outputs, and what they expect of the text."""
    top = F.array_max(ages)
    mass = lattices.total(F.transform(ages, lambda x: F.exp(x - top)))
    probs = F.transform(ages, lambda x: F.exp(x - top) / mass)
    return {"age_top": F.array_position(ages, top).cast("int") - 1, "age_prob": F.array_max(probs), "age_expected": F.aggregate(F.transform(probs, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x), "domain_prob": 1.0 / (1.0 + F.exp(-domain)), "chars_diff": F.length("cand") - predicted_chars, "spaces_diff": spaces(F.col("cand")) - predicted_spaces}


def mean_risk() -> Column:
    """A candidate's mean error rate with each other model's text as reference, for the first model that says it."""
    rates = F.transform("models", lambda m: metrics.rate(edits_to(m["key"]), F.length(m["key"])))
    own = metrics.rate(F.lit(0), F.length("cand"))
    return (lattices.total(rates) - own) / (F.size("models") - 1)

"""Hypothesis fusion over long tables: one row per utterance and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import batched, kernels, metrics, text


def _votes(p: DataFrame, weight: Column) -> DataFrame:
    """Votes by normalised text: weight, first model, and the first model's raw form."""
    keyed = p.withColumn("key", text.norm_simple(F.col("pred"))).withColumn("_w", weight)
    return keyed.groupBy("utterance_id", "key").agg(F.sum("_w").alias("votes"), F.min("model").alias("first"), F.min_by("pred", "model").alias("pred"), F.max("score").alias("score") if "score" in p.columns else F.lit(None).alias("score"))


def majority(p: DataFrame) -> DataFrame:
    """Most models agree on the normalised text; ties go to the earliest model, whose raw form is kept.

    Empty texts don't vote; if all are empty the first model's text is kept, stripped.
    """
    v = _votes(p, F.lit(1))
    best = v.groupBy("utterance_id").agg(F.min_by(F.struct("key", "pred"), F.struct(F.when(F.col("key") == "", 1).otherwise(0), -F.col("votes"), "first")).alias("b"))
    return best.select("utterance_id", F.when(F.col("b.key") == "", F.trim("b.pred")).otherwise(F.col("b.pred")).alias("pred"))


def consensus(p: DataFrame) -> DataFrame:
    """The text that all agree on, else null."""
    keyed = p.withColumn("key", text.norm_simple(F.col("pred")))
    g = keyed.groupBy("utterance_id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min_by("pred", "model").alias("pred"))
    return g.select("utterance_id", F.when((F.col("a") == F.col("b")) & (F.col("a") != ""), F.col("pred")).alias("pred"))


def count_unique(p: DataFrame) -> DataFrame:
    key = text.norm_simple(F.col("pred"))
    return p.groupBy("utterance_id").agg(F.greatest(F.lit(1), F.count_distinct(F.when(key != "", key))).alias("n_unique"))


def weighted(p: DataFrame, weights: DataFrame) -> DataFrame:
    """Largest sum of model weights by normalised text; ties go to the earliest model."""
    joined = p.join(F.broadcast(weights), "model")
    v = _votes(joined, F.col("weight")).withColumn("votes", F.round("votes", 6))
    return v.groupBy("utterance_id").agg(F.min_by("pred", F.struct(-F.col("votes"), "first")).alias("pred"))


def vote_max_score(p: DataFrame) -> DataFrame:
    """Most votes by text, then the highest score, then the earliest model."""
    v = p.groupBy("utterance_id", "pred").agg(F.count("*").alias("votes"), F.max("score").alias("score"), F.min("model").alias("first"))
    return v.groupBy("utterance_id").agg(F.min_by("pred", F.struct(-F.col("votes"), -F.col("score"), "first")).alias("pred"))


def best_score(p: DataFrame) -> DataFrame:
    return p.groupBy("utterance_id").agg(F.min_by(F.struct("pred", "score"), F.struct(-F.col("score"), "model")).alias("b")).select("utterance_id", "b.*")


def gated(p: DataFrame, chooser: DataFrame, at_least: int = 3) -> DataFrame:
    """Consensus, else majority unless enough texts differ; then the chooser's option, falling back to the majority.

    ``source`` says which: consensus, majority, llm, llm_invalid_choice_fallback or llm_empty_fallback.
    """
    out = majority(p).withColumnRenamed("pred", "major").join(consensus(p).withColumnRenamed("pred", "agreed"), "utterance_id").join(count_unique(p), "utterance_id").join(chooser, "utterance_id", "left")
    option = p.select("utterance_id", F.col("model").alias("choice"), F.col("pred").alias("chosen"))
    out = out.join(option, ["utterance_id", "choice"], "left")
    # made by hand: which branch holds, then its text
    source = F.when(F.col("agreed").isNotNull(), "consensus").when(F.col("n_unique") < at_least, "majority").when(F.col("choice").isNull(), "llm_empty_fallback").when(F.col("chosen").isNull(), "llm_invalid_choice_fallback").otherwise("llm")
    out = out.withColumn("source", source)
    return out.select("utterance_id", "source", F.when(F.col("source") == "consensus", F.col("agreed")).when(F.col("source") == "llm", F.col("chosen")).otherwise(F.col("major")).alias("pred"))


def rule_switch(p: DataFrame, best_model: int, at_least: int = 3) -> DataFrame:
    """The majority where few texts differ, else one model's text."""
    out = majority(p).withColumnRenamed("pred", "major").join(count_unique(p), "utterance_id").join(p.where(F.col("model") == best_model).select("utterance_id", F.col("pred").alias("own")), "utterance_id")
    return out.select("utterance_id", F.when(F.col("n_unique") < at_least, F.col("major")).otherwise(F.col("own")).alias("pred"))


def dealt(p: DataFrame, key: str = "utterance_id") -> DataFrame:
    """Rows by key over several partitions a core: what is computed for a group costs far more than its shuffle, so small
    partitions must not be put together before it."""
    spark = p.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return p.repartition(n, key)


def with_distances(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds tables of edit distances below the diagonal of arrays of texts, in Arrow batches by a bit-parallel kernel."""
    return batched.with_columns(df, kernels.below_diagonal, "array<array<int>>", columns)


def compared(p: DataFrame, text_col: str = "pred", by_word: bool = False) -> DataFrame:
    """One row per utterance: ``_t`` its different texts, ``_d`` below the diagonal their edit distances, ``_h`` per model
    the place of its text, the text's length and its number of words, in model order; ``_e``, if asked for, as ``_d`` in words.

    An utterance's texts, as many as there are models, are gathered once; each two different ones are compared once.
    """
    g = dealt(p).groupBy("utterance_id").agg(F.array_sort(F.collect_list(F.struct("model", F.col(text_col).alias("x")))).alias("_h"))
    g = g.withColumn("_t", F.array_distinct(F.transform("_h", lambda h: h["x"])))
    models = F.transform("_h", lambda h: F.struct(h["model"].alias("m"), F.array_position("_t", h["x"]).cast("int").alias("at"), F.length(h["x"]).alias("n"), F.size(text.words(h["x"])).alias("w")))
    tables = {"_t": "_d"}
    if by_word:
        vocab = F.array_distinct(F.flatten(F.transform("_t", text.words)))
        g = g.withColumn("_v", vocab).withColumn("_c", F.transform("_t", lambda x: metrics.coded(text.words(x), F.col("_v")))).drop("_v")
        tables["_c"] = "_e"
    return with_distances(g.withColumn("_h", models), tables).drop("_c")


def apart(table: str, a: Column, b: Column) -> Column:
    """The distance of two texts by their places, looked up in a table below the diagonal."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return F.when(hi == lo, 0).otherwise(F.element_at(F.element_at(table, hi), F.greatest(lo, F.lit(1))))


def pairwise(p: DataFrame, text_col: str = "pred", by_word: bool = False) -> DataFrame:
    """Ordered pairs of an utterance's models: the second is the reference, of length ``n``, and of ``w`` words."""
    g = compared(p, text_col, by_word).drop("_t")
    tables = [c for c in ("_d", "_e") if c in g.columns]
    pairs = g.select("utterance_id", *tables, "_h", F.explode("_h").alias("a")).select("utterance_id", *tables, "a", F.explode("_h").alias("b")).where("a.m <> b.m")
    edits = [apart(t, F.col("a.at"), F.col("b.at")).alias(name) for t, name in zip(tables, ("ed", "we"), strict=False)]
    return pairs.select("utterance_id", F.col("a.m").alias("i"), F.col("b.m").alias("j"), *edits, F.col("b.n").alias("n"), F.col("b.w").alias("w"))


def least_risks(pairs: DataFrame, risks: dict[str, Column]) -> DataFrame:
    """(utterance_id, metric, model, risk): under each risk the model of smallest mean over its pairs; the earliest of ties."""
    out = pairs.groupBy("utterance_id", "i").agg(*[F.round(F.avg(r), 9).alias(k) for k, r in risks.items()])
    best = out.groupBy("utterance_id").agg(*[F.min_by(F.struct(F.lit(k).alias("metric"), F.col("i").alias("model"), F.col(k).alias("risk")), F.struct(k, "i")).alias(k) for k in risks])
    return best.select("utterance_id", F.explode(F.array(*risks)).alias("b")).select("utterance_id", "b.*")


def mbr_by(p: DataFrame, text_col: str = "pred", kinds: tuple[str, ...] = ("char",)) -> DataFrame:
    """(utterance_id, metric, model, risk): the model whose text has the smallest mean error rate with each other text as
    reference; the earliest of ties. Texts are compared once, whatever rates are asked for.

    Kinds: rates of characters (char), of words (word), or the mean of both (mean).
    """
    by_word = kinds != ("char",)
    char = metrics.rate(F.col("ed"), F.col("n"))
    word = metrics.rate(F.col("we"), F.col("w")) if by_word else None
    rates = {"char": char, "word": word, "mean": (char + word) / 2 if by_word else None}
    return least_risks(pairwise(p, text_col, by_word), {k: rates[k] for k in kinds})


def mbr(p: DataFrame, text_col: str = "pred", metric: str = "char") -> DataFrame:
    return mbr_by(p, text_col, (metric,)).drop("metric")


def mbr_weighted(p: DataFrame, text_col: str = "pred", temperature: float = 1.0) -> DataFrame:
    """The smallest expected edit distance under softmax(score / temperature)."""
    w = W.partitionBy("utterance_id")
    share = F.exp((F.col("score") - F.max("score").over(w)) / temperature)
    probs = p.withColumn("_e", share).withColumn("prob", F.col("_e") / F.sum("_e").over(w)).select("utterance_id", F.col("model").alias("j"), "prob")
    risk = pairwise(p, text_col).join(probs, ["utterance_id", "j"]).groupBy("utterance_id", "i").agg(F.round(F.sum(F.col("prob") * F.col("ed")), 9).alias("risk"))
    return risk.groupBy("utterance_id").agg(F.min_by(F.struct(F.col("i").alias("model"), "risk"), F.struct("risk", "i")).alias("b")).select("utterance_id", "b.*")

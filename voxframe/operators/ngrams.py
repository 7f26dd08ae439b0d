"""Back-off language models: interpolated Kneser-Ney estimates as joins level by level, ARPA text, and scores.

A model is two tables: grams (ctx, w, logp), and back-off weights (ctx, bow). A context is its words joined by spaces, of
none at all for single words. Logarithms are natural; ARPA text has those to base ten.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import kernels
from voxframe.sources.workdir import materialise

BEGIN, END, UNKNOWN, FLOOR = "<s>", "</s>", "<unk>", -20.0
#: Grams and weights of a model that is sent to executors.
MOST_GRAMS = 2_000_000
#: Discounts where counts of counts give none.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)


def suffix(ctx: Column) -> Column:
    """A context without its first word; null after the empty one."""
    rest = F.substr(ctx, F.instr(ctx, " ") + 1)
    return F.when(ctx != "", F.when(F.instr(ctx, " ") == 0, F.lit("")).otherwise(rest))


def padded(text: Column) -> Column:
    """A text's words between the marks of beginning and end."""
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    return F.concat(F.array(F.lit(BEGIN)), words, F.array(F.lit(END)))


def longest_grams(sentences: DataFrame, words: str, order: int, *carry: str) -> DataFrame:
    """(*carry, n, ctx, w) of every word after the first, with the longest context there is, of ``order`` - 1 words at most."""
    w = F.col(words)
    at = F.transform(
        F.sequence(F.lit(1), F.size(w) - 1),
        lambda i: F.struct(F.least(F.lit(order), i + 1).alias("n"), F.array_join(F.slice(w, F.greatest(i - order + 2, F.lit(1)), F.least(F.lit(order - 1), i)), " ").alias("ctx"), F.get(w, i).alias("w")),
    )
    return sentences.where(F.size(w) > 1).select(*carry, F.explode(at).alias("g")).select(*carry, "g.*")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What is taken from counts of one, two, and three or more, by how many grams have counts of one to four."""
    n = [0, *counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first()]
    if not all(n[1:]):
        return PLAIN_DISCOUNTS
    y = n[1] / (n[1] + 2 * n[2])
    d = tuple(k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3))
    return d if all(0 < x <= k for k, x in enumerate(d, 1)) else PLAIN_DISCOUNTS


def estimate(sentences: DataFrame, words: str, order: int) -> tuple[DataFrame, DataFrame]:
    """(grams, weights) of padded sentences.

    The longest grams count occurrences; a shorter one counts the different words before it, or its occurrences where it
    begins a sentence. A discount of each count goes to the level below by the context's weight, at last evenly to all
    words and the unknown one. Each level is stored once; a join with the level below gives its probabilities, and sums
    are made before any shuffle. No sentences give no grams.
    """
    raw = materialise(longest_grams(sentences, words, order).groupBy("n", "ctx", "w").agg(F.count("*").alias("c")), "grams")
    levels = [raw.where(F.col("n") == order).select("ctx", "w", "c")]
    for n in range(order - 1, 0, -1):
        before = levels[0].select(suffix(F.col("ctx")).alias("ctx"), "w").groupBy("ctx", "w").agg(F.count("*").alias("c"))
        levels.insert(0, materialise(before.unionByName(raw.where(F.col("n") == n).select("ctx", "w", "c")), "level"))
    below, grams, weights = None, [], []
    for level in levels:
        d = discounts(level)
        taken = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        total = level.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(taken).alias("taken")).select(F.col("ctx").alias("_c"), "total", (F.col("taken") / F.col("total")).alias("gamma"))
        total = materialise(total, "totals")
        own = level.join(total, F.col("ctx") == F.col("_c")).select("ctx", "w", ((F.col("c") - taken) / F.col("total")).alias("own"), "gamma")
        if below is None:
            sizes = level.agg(F.count("*").alias("size"))
            p = own.crossJoin(F.broadcast(sizes)).select("ctx", "w", (F.col("own") + F.col("gamma") / (F.col("size") + 1)).alias("p"))
            rest = total.crossJoin(F.broadcast(sizes)).select(F.lit("").alias("ctx"), F.lit(UNKNOWN).alias("w"), (F.col("gamma") / (F.col("size") + 1)).alias("p"))
            p = p.unionByName(rest)
        else:
            low = below.select(F.col("ctx").alias("_s"), F.col("w").alias("_w"), F.col("p").alias("_p"))
            p = own.join(low, (suffix(F.col("ctx")) == F.col("_s")) & (F.col("w") == F.col("_w"))).select("ctx", "w", (F.col("own") + F.col("gamma") * F.col("_p")).alias("p"))
            weights.append(total.select(F.col("_c").alias("ctx"), F.log("gamma").alias("bow")))
        below = materialise(p, "probabilities")
        grams.append(below.select("ctx", "w", F.log("p").alias("logp")))
    none = grams[0].limit(0).select("ctx", F.col("logp").alias("bow"))
    return reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, weights, none)


def log_probs(asked: DataFrame, grams: DataFrame, weights: DataFrame, order: int) -> DataFrame:
    """asked (ctx, w, ...) with ``logp``: the longest known gram's, and the weights of the contexts given up for it.

    A word that no gram tells costs FLOOR, whatever the context. ``asked`` should be distinct.
    """
    out, at = asked, [F.col("ctx")]
    for _ in range(order - 1):
        at.append(suffix(at[-1]))
    out = out.select("*", *[c.alias(f"_s{k}") for k, c in enumerate(at)])
    for k in range(order):
        g = grams.select(F.col("ctx").alias(f"_g{k}"), F.col("w").alias(f"_w{k}"), F.col("logp").alias(f"_p{k}"))
        out = out.join(g, (F.col(f"_s{k}") == F.col(f"_g{k}")) & (F.col("w") == F.col(f"_w{k}")), "left")
        if k < order - 1:
            b = weights.select(F.col("ctx").alias(f"_x{k}"), F.col("bow").alias(f"_b{k}"))
            out = out.join(b, F.col(f"_s{k}") == F.col(f"_x{k}"), "left")
    given, found = F.lit(0.0), []
    for k in range(order):
        found.append(F.col(f"_p{k}") + given)
        given = given + F.coalesce(F.col(f"_b{k}"), F.lit(0.0)) if k < order - 1 else given
    return out.select(*asked.columns, F.coalesce(*found, F.lit(FLOOR)).alias("logp"))


def score(sentences: DataFrame, key: str, words: str, grams: DataFrame, weights: DataFrame, order: int) -> DataFrame:
    """(key, logp): the sum over a padded sentence's words; each distinct gram of all sentences is looked up once."""
    asked = longest_grams(sentences, words, order, key).groupBy(key, "ctx", "w").agg(F.count("*").alias("times"))
    asked = materialise(asked, "asked")
    known = materialise(log_probs(asked.select("ctx", "w").distinct(), grams, weights, order), "known").select(F.col("ctx").alias("_c"), F.col("w").alias("_v"), "logp")
    out = asked.join(known, (F.col("ctx") == F.col("_c")) & (F.col("w") == F.col("_v")))
    return out.groupBy(key).agg(F.sum(F.col("logp") * F.col("times")).alias("logp"))


def automaton(grams: DataFrame, weights: DataFrame, order: int) -> kernels.Automaton:
    """The model as an automaton, to be sent to executors: of at most MOST_GRAMS grams, which is checked before any is
    fetched. A larger model is for ``score``, which joins it."""
    rows = materialise(grams.select("ctx", "w", "logp").unionByName(weights.select("ctx", F.lit(None).cast("string").alias("w"), F.col("bow").alias("logp"))), "model")
    n = rows.count()
    if n > MOST_GRAMS:
        raise ValueError(f"the model has {n} grams and weights, more than the {MOST_GRAMS} that are sent to executors")
    found = rows.collect()
    return kernels.Automaton([tuple(r) for r in found if r[1] is not None], [(r[0], r[2]) for r in found if r[1] is None], order, FLOOR)


def write_arpa(grams: DataFrame, weights: DataFrame, order: int, path: str) -> None:
    """ARPA text in a folder whose files, in the order of their names, are one ARPA file; grams are written where they are.

    Probabilities and weights to base ten keep all their digits.
    """
    text = lambda c: (c / F.lit(math.log(10.0))).cast("string")
    word = F.when(F.col("ctx") == "", F.col("w")).otherwise(F.concat_ws(" ", "ctx", "w"))
    size = F.when(F.col("ctx") == "", 1).otherwise(F.size(F.split("ctx", " ")) + 1)
    # the mark of beginning is no word that a gram tells, but a context with a weight
    begin = weights.where(F.col("ctx") == BEGIN).select(F.lit("").alias("ctx"), F.lit(BEGIN).alias("w"), F.lit(-99.0 * math.log(10.0)).alias("logp"))
    rows = grams.unionByName(begin).select(size.alias("n"), word.alias("_g"), text(F.col("logp")).alias("_p"))
    rows = rows.join(weights.select(F.col("ctx").alias("_x"), text(F.col("bow")).alias("_b")), F.col("_g") == F.col("_x"), "left")
    rows = materialise(rows.select("n", F.concat_ws("\t", "_p", "_g", "_b").alias("value")), "arpa")
    sizes = {r[0]: r[1] for r in rows.groupBy("n").count().collect()}
    spark = grams.sparkSession

    def lines(name: str, values: list[str]) -> None:
        spark.createDataFrame([(v,) for v in values], "value string").coalesce(1).write.text(f"{path}/{name}")

    lines("0-head", ["\\data\\", *[f"ngram {n}={sizes.get(n, 0)}" for n in range(1, order + 1)]])
    for n in range(1, order + 1):
        lines(f"{n}-0", ["", f"\\{n}-grams:"])
        rows.where(F.col("n") == n).select("value").write.text(f"{path}/{n}-1")
    lines(f"{order + 1}-end", ["", "\\end\\"])


def read_arpa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(grams, weights) of ARPA text: a file, or a folder of its parts. A line tells its own length, so lines are read apart."""
    line = F.split("value", "\t")
    rows = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("value").rlike(r"^-?[0-9.]+(E-?[0-9]+)?\t"))
    e = lambda c: c.cast("double") * F.lit(math.log(10.0))
    rows = rows.select(e(F.get(line, F.lit(0))).alias("logp"), F.get(line, F.lit(1)).alias("g"), e(F.get(line, F.lit(2))).alias("bow"))
    last = F.regexp_extract("g", r"([^ ]*)$", 1)
    grams = rows.where(F.col("g") != BEGIN).select(F.regexp_replace("g", r" ?[^ ]*$", "").alias("ctx"), last.alias("w"), "logp")
    return grams, rows.where(F.col("bow").isNotNull()).select(F.col("g").alias("ctx"), "bow")

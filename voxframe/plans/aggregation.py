"""Error rates, slices and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import metrics, text
from voxframe.operators.ordering import numbered, quantiles, quantiles_of
from voxframe.plans.registered import query
from voxframe.plans.relational import NORM_SIMPLE
from voxframe.plans.tables import P, U, predictions, spread, table, utterances
from voxframe.sources.workdir import materialise

R, H = NORM_SIMPLE.format("text"), NORM_SIMPLE.format("pred")
#: Character edits of normalised texts; equal ones skip the table. The normal form is ASCII, so bytes are characters.
E = f"{P}, x AS (SELECT utterance_id, model, child_id, session_id, ord, age_bucket, source, duration, text, pred, {R} AS r, {H} AS h FROM p), e AS (SELECT *, CASE WHEN r = h THEN 0 ELSE levenshtein(r, h) END AS ed, length(r) AS n FROM x)"


def errors(spark, d):
    p = spread(predictions(spark, d), "utterance_id").withColumns({"r": text.norm_simple(F.col("text")), "h": text.norm_simple(F.col("pred"))})
    return p.withColumns({"ed": metrics.char_distance(F.col("r"), F.col("h")), "n": F.length("r")})


def micro(ed="ed", n="n"):
    return F.when(F.sum(n) > 0, F.sum(ed) / F.sum(n)).otherwise(0.0)


@query(f"WITH {E} SELECT model, age_bucket, sum(ed)::BIGINT AS edits, sum(n)::BIGINT AS chars, sum(ed) / sum(n)::DOUBLE AS cer_micro FROM e GROUP BY 1, 2")
def agg_corpus_er(spark, d):
    return errors(spark, d).groupBy("model", "age_bucket").agg(F.sum("ed").alias("edits"), F.sum("n").alias("chars"), micro().alias("cer_micro"))


@query(f"WITH {E} SELECT model, round(avg(CASE WHEN n > 0 THEN ed / n::DOUBLE WHEN ed > 0 THEN 1.0 ELSE 0.0 END), 8) AS cer_macro FROM e GROUP BY 1")
def agg_macro_er(spark, d):
    return errors(spark, d).groupBy("model").agg(F.round(F.avg(metrics.rate(F.col("ed"), F.col("n"))), 8).alias("cer_macro"))


BY_SOURCE = "s AS (SELECT model, sum(CASE WHEN source = 'dd' THEN ed END) / sum(CASE WHEN source = 'dd' THEN n END)::DOUBLE AS dd, sum(CASE WHEN source = 'ext' THEN ed END) / sum(CASE WHEN source = 'ext' THEN n END)::DOUBLE AS ext, sum(ed) / sum(n)::DOUBLE AS raw FROM e GROUP BY 1)"


def by_source(spark, d):
    one = lambda s: F.sum(F.when(F.col("source") == s, F.col("ed"))) / F.sum(F.when(F.col("source") == s, F.col("n")))
    return errors(spark, d).groupBy("model").agg(one("dd").alias("dd"), one("ext").alias("ext"), (F.sum("ed") / F.sum("n")).alias("raw"))


@query(f"WITH {E}, {BY_SOURCE} SELECT model, raw, round(coalesce((dd + 0.5 * ext) / 1.5, raw), 8) AS weighted FROM s")
def agg_source_weighted(spark, d):
    return by_source(spark, d).select("model", "raw", F.round(F.coalesce((F.col("dd") + 0.5 * F.col("ext")) / 1.5, F.col("raw")), 8).alias("weighted"))


@query(f"WITH {E}, {BY_SOURCE} SELECT model, round((coalesce(dd * 0.7, 0) + coalesce(ext * 0.3, 0)) / (CASE WHEN dd IS NULL THEN 0 ELSE 0.7 END + CASE WHEN ext IS NULL THEN 0 ELSE 0.3 END), 8) AS mixed FROM s")
def agg_source_mix(spark, d):
    w = {"dd": 0.7, "ext": 0.3}
    total = sum((F.coalesce(F.col(k) * v, F.lit(0.0)) for k, v in w.items()), F.lit(0.0))
    weight = sum((F.when(F.col(k).isNull(), 0.0).otherwise(v) for k, v in w.items()), F.lit(0.0))
    return by_source(spark, d).select("model", F.round(total / weight, 8).alias("mixed"))


WORDS = "len(list_filter(string_split(text, ' '), lambda w: w <> ''))"
BUCKETS = f"b AS (SELECT *, CASE WHEN {WORDS} <= 1 THEN '1' WHEN {WORDS} <= 3 THEN '2-3' WHEN {WORDS} <= 6 THEN '4-6' WHEN {WORDS} <= 10 THEN '7-10' ELSE '11+' END AS words, CASE WHEN duration < 1 THEN '<1' WHEN duration < 2 THEN '1-2' WHEN duration < 5 THEN '2-5' ELSE '5+' END AS seconds FROM e)"


@query(f"WITH {E}, {BUCKETS} SELECT model, coalesce(age_bucket, '') AS age_bucket, coalesce(words, '') AS words, coalesce(seconds, '') AS seconds, coalesce(source, '') AS source, sum(ed)::BIGINT AS edits, sum(n)::BIGINT AS chars FROM b GROUP BY GROUPING SETS ((model, age_bucket), (model, age_bucket, source), (model, words), (model, words, source), (model, seconds), (model, seconds, source))")
def agg_bucketed_er(spark, d):
    n = F.size(text.words(F.col("text")))
    s = F.col("duration")
    b = errors(spark, d).withColumns({"words": F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise("11+"), "seconds": F.when(s < 1, "<1").when(s < 2, "1-2").when(s < 5, "2-5").otherwise("5+")})
    keys = ["model", "age_bucket", "words", "seconds", "source"]
    sets = [[F.col("model"), F.col(k), *more] for k in ("age_bucket", "words", "seconds") for more in ([], [F.col("source")])]
    out = b.groupingSets(sets, *keys).agg(F.sum("ed").alias("edits"), F.sum("n").alias("chars"))
    return out.select("model", *[F.coalesce(k, F.lit("")).alias(k) for k in keys[1:]], "edits", "chars")


#: What rates are cut by: (name, SQL value, Column).
SLICES = (
    ("age", "age_bucket", "age_bucket"),
    ("seconds", "CASE WHEN duration < 10 THEN '<10' WHEN duration < 30 THEN '10-30' ELSE '30+' END", "CASE WHEN duration < 10 THEN '<10' WHEN duration < 30 THEN '10-30' ELSE '30+' END"),
    ("length", "CASE WHEN n < 100 THEN '<100' WHEN n < 500 THEN '100-500' ELSE '500+' END", "CASE WHEN n < 100 THEN '<100' WHEN n < 500 THEN '100-500' ELSE '500+' END"),
    ("fold", "CAST(session_id % 5 AS VARCHAR)", "CAST(session_id % 5 AS STRING)"),
    ("source", "source", "source"),
    ("child", "child_id", "child_id"),
)
SLICED = " UNION ALL ".join(f"SELECT '{name}' AS slice, {sql} AS value, model, cer FROM c" for name, sql, _ in SLICES)


@query(f"WITH {E}, c AS (SELECT *, CASE WHEN n > 0 THEN ed / n::DOUBLE WHEN ed > 0 THEN 1.0 ELSE 0.0 END AS cer FROM e), s AS ({SLICED}) SELECT slice, value, model, count(*) AS n, round(avg(cer), 8) AS mean, round(median(cer), 8) AS median, round(stddev_samp(cer), 8) AS std, round(avg(CASE WHEN cer = 0 THEN 1.0 ELSE 0.0 END), 8) AS exact FROM s GROUP BY 1, 2, 3")
def agg_slice_stats(spark, d):
    """Rates by age, duration, length, fold, source and child; each row is compared once and counted in each."""
    c = errors(spark, d).withColumn("cer", metrics.rate(F.col("ed"), F.col("n")))
    cut = F.array(*[F.struct(F.lit(name).alias("slice"), F.expr(sql).alias("value")) for name, _, sql in SLICES])
    c = materialise(c.select("model", "cer", F.explode(cut).alias("s")).select("s.*", "model", "cer"), "slices")
    keys = ("slice", "value", "model")
    some = F.coalesce("value", F.lit("\0"))  # a null value is a slice of its own
    middle = quantiles(c.withColumn("_val", some), "cer", [0.5], ("slice", "_val", "model")).select(*[F.col(k).alias(f"_{k}") for k in ("slice", "model")], "_val", F.get("q", F.lit(0)).alias("median"))
    g = c.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("cer"), 8).alias("mean"), F.round(F.stddev_samp("cer"), 8).alias("std"), F.round(F.avg((F.col("cer") == 0).cast("double")), 8).alias("exact"))
    out = g.join(middle, (F.col("slice") == F.col("_slice")) & (F.col("model") == F.col("_model")) & (some == F.col("_val")), "left")
    return out.select(*keys, "n", "mean", F.round("median", 8).alias("median"), "std", "exact")


def bucket(value, cuts):
    """From 1: one more than the cuts that a value lies above."""
    return F.lit(1) + sum(((F.col(value) > F.lit(c)).cast("int") for c in cuts), F.lit(0))


@query(f"WITH {E}, q AS (SELECT quantile_cont(duration, [0.2, 0.4, 0.6, 0.8]) AS v FROM u), k AS (SELECT e.*, 1 + CAST(duration > v[1] AS INTEGER) + CAST(duration > v[2] AS INTEGER) + CAST(duration > v[3] AS INTEGER) + CAST(duration > v[4] AS INTEGER) AS b FROM e, q) SELECT age_bucket, round(avg(CASE WHEN b = 1 THEN ed / n::DOUBLE END), 8) AS q1, round(avg(CASE WHEN b = 2 THEN ed / n::DOUBLE END), 8) AS q2, round(avg(CASE WHEN b = 3 THEN ed / n::DOUBLE END), 8) AS q3, round(avg(CASE WHEN b = 4 THEN ed / n::DOUBLE END), 8) AS q4, round(avg(CASE WHEN b = 5 THEN ed / n::DOUBLE END), 8) AS q5 FROM k WHERE n > 0 GROUP BY 1")
def agg_pivot_mean(spark, d):
    cuts = quantiles_of(utterances(spark, d), "duration", [0.2, 0.4, 0.6, 0.8])
    e = errors(spark, d).where("n > 0").withColumn("b", F.concat(F.lit("q"), bucket("duration", cuts).cast("string")))
    out = e.groupBy("age_bucket").pivot("b", [f"q{i}" for i in range(1, 6)]).agg(F.avg(F.col("ed") / F.col("n")))
    return out.select("age_bucket", *[F.round(f"q{i}", 8).alias(f"q{i}") for i in range(1, 6)])


@query(f"WITH {U} SELECT age_bucket, round(sum(duration) / 3600, 9) AS hours FROM u GROUP BY 1")
def agg_hours(spark, d):
    return utterances(spark, d).groupBy("age_bucket").agg(F.round(F.sum("duration") / 3600, 9).alias("hours"))


@query(f"WITH {U} SELECT age_bucket, count(DISTINCT child_id) AS children, count(DISTINCT session_id) AS sessions, count(*) AS n FROM u GROUP BY 1")
def agg_distinct(spark, d):
    return utterances(spark, d).groupBy("age_bucket").agg(F.count_distinct("child_id").alias("children"), F.count_distinct("session_id").alias("sessions"), F.count("*").alias("n"))


@query(f"WITH {U} SELECT child_id, coalesce(array_to_string(list_sort(list(DISTINCT CASE WHEN age_bucket <> 'unknown' THEN age_bucket END)), '|'), '') AS ages FROM u GROUP BY 1")
def agg_collect_distinct(spark, d):
    return utterances(spark, d).groupBy("child_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("age_bucket") != "unknown", F.col("age_bucket")))), "|").alias("ages"))


@query("SELECT d.lang, count(*) AS n, count(l.quality) AS n_labelled, count(*) FILTER (WHERE l.quality IS NULL) AS n_null FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg_null_counts(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"), F.count_if(F.col("quality").isNull()).alias("n_null"))


@query("WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT coalesce(sum(n), 0)::BIGINT AS rows_in_groups, coalesce(sum(n - 1), 0)::BIGINT AS extra FROM g")
def agg_dup_audit(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))


@query(f"WITH {U} SELECT count(duration) AS n, round(avg(duration), 8) AS mean, round(stddev_samp(duration), 8) AS std, min(duration) AS least, round(quantile_cont(duration, 0.25), 8) AS q25, round(quantile_cont(duration, 0.5), 8) AS q50, round(quantile_cont(duration, 0.75), 8) AS q75, max(duration) AS most FROM u")
def agg_describe(spark, d):
    u = utterances(spark, d)
    q = [F.round(F.lit(x).cast("double"), 8).alias(f"q{p}") for p, x in zip((25, 50, 75), quantiles_of(u, "duration", [0.25, 0.5, 0.75]), strict=True)]
    return u.agg(F.count("duration").alias("n"), F.round(F.avg("duration"), 8).alias("mean"), F.round(F.stddev_samp("duration"), 8).alias("std"), F.min("duration").alias("least"), *q, F.max("duration").alias("most"))


@query("SELECT l.quality, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def agg_value_counts(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return x.groupBy("quality").agg(F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query(f"WITH {U} SELECT round(avg(duration), 8) AS mean, round(median(duration), 8) AS median, min(duration) AS least, max(duration) AS most, round(sum(duration) / 3600, 8) AS hours, count(DISTINCT child_id) AS children FROM u")
def agg_stats_line(spark, d):
    u = utterances(spark, d)
    middle = F.lit(quantiles_of(u, "duration", [0.5])[0]).cast("double")
    return u.agg(F.round(F.avg("duration"), 8).alias("mean"), F.round(middle, 8).alias("median"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.round(F.sum("duration") / 3600, 8).alias("hours"), F.count_distinct("child_id").alias("children"))


TOKENS = f"{U}, t AS (SELECT session_id, ord, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS w, unnest(range(len(list_filter(string_split(text, ' '), lambda w: w <> '')))) AS i FROM u)"


def token_rows(spark, d):
    return utterances(spark, d).select("session_id", "ord", F.posexplode(text.words(F.col("text"))).alias("i", "w"))


@query(f"WITH {TOKENS}, c AS (SELECT lower(w) AS key, w, count(*) AS n, min(session_id * 1000000000 + ord * 1000000 + i) AS first FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS k FROM c) SELECT key, w AS original, n FROM r WHERE k = 1")
def agg_mode_word(spark, d):
    first = F.min(F.col("session_id") * 1000000000 + F.col("ord") * 1000000 + F.col("i")).alias("first")
    c = token_rows(spark, d).groupBy(F.lower("w").alias("key"), "w").agg(F.count("*").alias("n"), first)
    k = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "first"))
    return c.withColumn("k", k).where("k = 1").select("key", F.col("w").alias("original"), "n")


@query("WITH t AS (SELECT lang, unnest(string_split(replace(text, chr(10), ''), '')) AS ch FROM documents) SELECT lang, ch, count(*) AS n FROM t WHERE ch <> '' GROUP BY 1, 2")
def agg_token_count(spark, d):
    chars = F.explode(F.split(F.replace("text", F.lit("\n"), F.lit("")), "", -1)).alias("ch")
    return table(spark, d, "documents").select("lang", chars).where("ch <> ''").groupBy("lang", "ch").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT lang, text, unnest(range(2, length(text) + 1)) AS i FROM documents WHERE length(text) > 1), c AS (SELECT lang, substr(text, i - 1, 1) AS prev FROM t WHERE substr(text, i, 1) = 'e'), g AS (SELECT lang, prev, count(*) AS n FROM c GROUP BY 1, 2) SELECT lang, prev, n, round(n / sum(n) OVER (PARTITION BY lang)::DOUBLE, 8) AS share FROM g", name="agg_prev_symbol")
def agg_prev_symbol(spark, d):
    """The symbol before each mark, skipping combining marks, its count and share by language."""
    before = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(?=(\P{M})\p{M}*e)"), F.lit(1))).alias("prev")
    g = table(spark, d, "documents").select("lang", before).groupBy("lang", "prev").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 8))


@query(f"WITH {U} SELECT session_id, string_agg(text, '' ORDER BY ord) AS text FROM u GROUP BY 1")
def agg_string_concat(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return utterances(spark, d).groupBy("session_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


@query("WITH l AS (SELECT source, lang, doc_id, CASE WHEN lag(lang) OVER w IS DISTINCT FROM lang THEN 1 ELSE 0 END AS head FROM documents WHERE lang <> '' AND source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id)), r AS (SELECT *, sum(head) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM l) SELECT source, CAST(run AS BIGINT) AS run, any_value(lang) AS lang, min(doc_id) AS first_id, count(*) AS n FROM r GROUP BY source, run")
def agg_runs_uniq(spark, d):
    """Languages of a source in order, blanks dropped and equal neighbours one: a row for each run, with its length.

    Rows are numbered by ranges of (source, id); a run begins where the row before is of another source or language, found
    by its number. No task holds a source, and no window is by source.
    """
    rows = materialise(numbered(table(spark, d, "documents").where("lang <> '' AND source IS NOT NULL").select("source", "lang", "doc_id"), ["source", "doc_id"], "place"), "places")
    before = rows.select((F.col("place") + 1).alias("_p"), F.col("source").alias("_s"), F.col("lang").alias("_l"))
    heads = rows.join(before, F.col("place") == F.col("_p"), "left").where(~(F.col("source").eqNullSafe(F.col("_s")) & F.col("lang").eqNullSafe(F.col("_l"))))
    heads = materialise(numbered(heads.select("source", "lang", "doc_id", "place"), ["place"], "k"), "heads")
    after, total = heads.select((F.col("k") - 1).alias("_k"), F.col("place").alias("_next")), rows.agg((F.count("*") + 1).alias("_end"))
    first = heads.groupBy("source").agg(F.min("k").alias("_first")).select(F.col("source").alias("_s"), "_first")
    out = heads.join(after, F.col("k") == F.col("_k"), "left").crossJoin(F.broadcast(total)).join(first, F.col("source") == F.col("_s"))
    return out.select("source", (F.col("k") - F.col("_first") + 1).alias("run"), "lang", F.col("doc_id").alias("first_id"), (F.coalesce("_next", "_end") - F.col("place")).alias("n"))


PAIRS = "g AS (SELECT CASE WHEN i = 0 THEN '<s>' ELSE w[i] END AS prev, CASE WHEN i = len(w) THEN '</s>' ELSE w[i + 1] END AS cur FROM (SELECT w, unnest(range(0, len(w) + 1)) AS i FROM (SELECT list_filter(string_split(text, ' '), lambda w: w <> '') AS w FROM u)))"


def bigrams(spark, d):
    w = F.concat(F.array(F.lit("<s>")), text.words(F.col("text")), F.array(F.lit("</s>")))
    pairs = F.explode(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("prev"), F.slice(w, F.lit(2), F.size(w) - 1).alias("cur"))).alias("x")
    return utterances(spark, d).select(pairs).select("x.*")


@query(f"WITH {U}, {PAIRS} SELECT prev, cur, count(*) AS n, round(ln(greatest(count(*) / sum(count(*)) OVER (PARTITION BY prev)::DOUBLE, 1e-10)), 8) AS logp FROM g GROUP BY 1, 2")
def agg_bigram_lm(spark, d):
    g = bigrams(spark, d).groupBy("prev", "cur").agg(F.count("*").alias("n"))
    return g.withColumn("logp", F.round(F.log(F.greatest(F.col("n") / F.sum("n").over(W.partitionBy("prev")), F.lit(1e-10))), 8))


@query("WITH t AS (SELECT '^^' || text AS t FROM conversations), g AS (SELECT substr(t, i, 2) AS context, substr(t, i + 2, 1) AS next FROM (SELECT t, unnest(range(1, length(t) - 1)) AS i FROM t)) SELECT context, next, count(*) AS n, round(ln(count(*) / sum(count(*)) OVER (PARTITION BY context)::DOUBLE), 8) AS logp FROM g GROUP BY 1, 2")
def agg_char_ngram_lm(spark, d):
    t = table(spark, d, "conversations").select(F.concat(F.lit("^^"), "text").alias("t")).where(F.length("t") > 2)
    t = t.select(F.split("t", "", -1).alias("c"), F.length("t").alias("n"))
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.concat(F.get("c", i), F.get("c", i + 1)).alias("context"), F.get("c", i + 2).alias("next")))
    g = t.select(F.explode(grams).alias("g")).select("g.*")
    g = g.groupBy("context", "next").agg(F.count("*").alias("n"))
    return g.withColumn("logp", F.round(F.log(F.col("n") / F.sum("n").over(W.partitionBy("context"))), 8))


@query(f"WITH {U}, t AS (SELECT list_concat(['<s>', '<s>'], list_concat(list_filter(string_split(text, ' '), lambda w: w <> ''), ['</s>'])) AS w FROM u), i AS (SELECT w, unnest(range(3, len(w) + 1)) AS i FROM t), g AS (SELECT 2 AS n_words, w[i - 1] AS context, w[i] AS next FROM i UNION ALL SELECT 3, w[i - 2] || ' ' || w[i - 1], w[i] FROM i) SELECT n_words, context, next, count(*) AS n, round(ln(count(*) / sum(count(*)) OVER (PARTITION BY n_words, context)::DOUBLE), 8) AS logp FROM g GROUP BY 1, 2, 3")
def agg_word_ngram_lm(spark, d):
    """Bigrams and trigrams with their log-probabilities after their contexts."""
    w = F.concat(F.array(F.lit("<s>"), F.lit("<s>")), text.words(F.col("text")), F.array(F.lit("</s>")))
    grams = F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda i: F.array(F.struct(F.lit(2).alias("n_words"), F.get("w", i - 1).alias("context"), F.get("w", i).alias("next")), F.struct(F.lit(3).alias("n_words"), F.concat(F.get("w", i - 2), F.lit(" "), F.get("w", i - 1)).alias("context"), F.get("w", i).alias("next"))))
    g = utterances(spark, d).where("text IS NOT NULL").select(w.alias("w")).select(F.explode(F.flatten(grams)).alias("g")).select("g.*")
    g = g.groupBy("n_words", "context", "next").agg(F.count("*").alias("n"))
    # the counts of a context are summed before they meet, so a common one is no task's burden
    whole = g.groupBy("n_words", "context").agg(F.sum("n").alias("all"))
    return g.join(whole, ["n_words", "context"]).select("n_words", "context", "next", "n", F.round(F.log(F.col("n") / F.col("all")), 8).alias("logp"))


@query("WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) SELECT ch, row_number() OVER (ORDER BY ch) + 53 AS id FROM c WHERE ch <> ''")
def agg_vocab(spark, d):
    """Symbols after the fixed vocabulary; the table of distinct characters is bounded by Unicode."""
    c = table(spark, d, "documents").select(F.explode(F.split("text", "", -1)).alias("ch")).where("ch <> ''").distinct()
    return c.select("ch", (F.row_number().over(W.partitionBy().orderBy("ch")) + 53).cast("long").alias("id"))


@query(f"WITH {E} SELECT model, round(corr(duration, ed / n::DOUBLE), 6) AS r FROM e WHERE n > 0 GROUP BY 1 HAVING stddev_pop(ed / n::DOUBLE) > 0")
def agg_corr(spark, d):
    e = errors(spark, d).where("n > 0").withColumn("cer", F.col("ed") / F.col("n"))
    # not corr(): it divides by zero where a model makes no error
    r = e.groupBy("model").agg(F.covar_pop("duration", "cer").alias("c"), (F.stddev_pop("duration") * F.stddev_pop("cer")).alias("s")).where("s > 0")
    return r.select("model", F.round(F.col("c") / F.col("s"), 6).alias("r"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY 1")
def agg_quantiles(spark, d):
    probs = [0.1, 0.5, 0.9, 0.95]
    out = quantiles(table(spark, d, "lineitem"), "l_extendedprice", probs, ("l_returnflag",))
    return out.select("l_returnflag", *[F.round(F.get("q", F.lit(k)), 6).alias(f"p{round(x * 100)}") for k, x in enumerate(probs)])


AB = "ab AS (SELECT utterance_id, duration, n, r, max(CASE WHEN model = 1 THEN ed END) / greatest(n, 1)::DOUBLE AS a, max(CASE WHEN model = 2 THEN ed END) / greatest(n, 1)::DOUBLE AS b FROM e GROUP BY utterance_id, duration, n, r)"


def two_models(spark, d):
    e = errors(spark, d).where("model IN (1, 2)").groupBy("utterance_id", "duration", "n", "r")
    one = lambda m: F.max(F.when(F.col("model") == m, F.col("ed"))) / F.greatest("n", F.lit(1))
    return e.agg(one(1).alias("a"), one(2).alias("b"))


@query(f"WITH {E}, {AB}, q AS (SELECT quantile_cont(duration, [0.25, 0.5, 0.75]) AS v FROM ab) SELECT 1 + CAST(duration > v[1] AS INTEGER) + CAST(duration > v[2] AS INTEGER) + CAST(duration > v[3] AS INTEGER) AS bucket, count(*) AS n, round(avg(a), 8) AS cer_a, round(avg(b), 8) AS cer_b, count(*) FILTER (WHERE a < b) AS wins_a, count(*) FILTER (WHERE b < a) AS wins_b FROM ab, q GROUP BY 1")
def agg_quartile_buckets(spark, d):
    ab = two_models(spark, d)
    b = bucket("duration", quantiles_of(utterances(spark, d), "duration", [0.25, 0.5, 0.75]))
    return ab.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("a"), 8).alias("cer_a"), F.round(F.avg("b"), 8).alias("cer_b"), F.count_if(F.col("a") < F.col("b")).alias("wins_a"), F.count_if(F.col("b") < F.col("a")).alias("wins_b"))


@query(f"WITH {E}, {AB}, c AS (SELECT a, b, unnest(list_distinct(string_split(replace(r, ' ', ''), ''))) AS ch FROM ab) SELECT ch, count(*) AS support, round(avg(a), 8) AS cer_a, round(avg(b), 8) AS cer_b, round(avg(a) - avg(b), 8) AS delta FROM c WHERE ch <> '' GROUP BY 1 HAVING count(*) >= 20")
def agg_char_strength(spark, d):
    c = two_models(spark, d).select("a", "b", F.explode(F.array_distinct(F.split(F.replace("r", F.lit(" "), F.lit("")), "", -1))).alias("ch")).where("ch <> ''")
    out = c.groupBy("ch").agg(F.count("*").alias("support"), F.avg("a").alias("x"), F.avg("b").alias("y")).where("support >= 20")
    return out.select("ch", "support", F.round("x", 8).alias("cer_a"), F.round("y", 8).alias("cer_b"), F.round(F.col("x") - F.col("y"), 8).alias("delta"))


TWO = "t AS (SELECT utterance_id, text, r, max(CASE WHEN model = 0 THEN h END) AS h0, max(CASE WHEN model = 1 THEN h END) AS h1, max(CASE WHEN model = 3 THEN h END) AS h3 FROM x GROUP BY ALL)"


@query(f"WITH {E}, {TWO}, k AS (SELECT *, CASE WHEN h0 = h1 AND h1 <> h3 THEN '0+1|3' WHEN h0 = h3 AND h1 <> h3 THEN '0+3|1' WHEN h1 = h3 AND h0 <> h3 THEN '1+3|0' END AS side, CASE WHEN h0 = h1 THEN h0 WHEN h0 = h3 THEN h0 ELSE h1 END AS agreed, CASE WHEN h0 = h1 THEN h3 WHEN h0 = h3 THEN h1 ELSE h0 END AS lone FROM t) SELECT side, count(*) AS n, round(avg(CASE WHEN agreed = r THEN 1.0 ELSE 0.0 END), 8) AS agreed_exact, round(avg(CASE WHEN lone = r THEN 1.0 ELSE 0.0 END), 8) AS lone_exact FROM k WHERE side IS NOT NULL GROUP BY 1")
def agg_twoway(spark, d):
    e = errors(spark, d).where("model IN (0, 1, 3)").groupBy("utterance_id", "r").agg(*[F.max(F.when(F.col("model") == m, F.col("h"))).alias(f"h{m}") for m in (0, 1, 3)])
    side = F.when(F.expr("h0 = h1 AND h1 <> h3"), F.struct(F.lit("0+1|3").alias("side"), F.col("h0").alias("agreed"), F.col("h3").alias("lone"))).when(F.expr("h0 = h3 AND h1 <> h3"), F.struct(F.lit("0+3|1").alias("side"), F.col("h0").alias("agreed"), F.col("h1").alias("lone"))).when(F.expr("h1 = h3 AND h0 <> h3"), F.struct(F.lit("1+3|0").alias("side"), F.col("h1").alias("agreed"), F.col("h0").alias("lone")))
    k = e.select("r", side.alias("k")).where("k IS NOT NULL").select("r", "k.*")
    exact = lambda c: F.round(F.avg((F.col(c) == F.col("r")).cast("double")), 8).alias(f"{c}_exact")
    return k.groupBy("side").agg(F.count("*").alias("n"), exact("agreed"), exact("lone"))


@query("WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER (), 8) AS p, round(pow(n, 0.5) / sum(pow(n, 0.5)) OVER () / n, 10) AS row_weight FROM g")
def agg_group_probs(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    p = F.pow("n", F.lit(0.5)) / F.sum(F.pow("n", F.lit(0.5))).over(W.partitionBy())
    return g.select("source", "n", F.round(p, 8).alias("p"), F.round(p / F.col("n"), 10).alias("row_weight"))


@query("WITH g AS (SELECT lang, 1.0::DOUBLE / count(*) AS w, count(*) AS n FROM documents GROUP BY 1) SELECT d.doc_id, round(g.w / (SELECT sum(w * n) FROM g), 10) AS weight FROM documents d JOIN g USING (lang)")
def agg_inverse_freq_weight(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    g = docs.groupBy("lang").agg((1.0 / F.count("*")).alias("w"))
    total = g.agg(F.count("*").alias("groups"))
    # rows of a group weigh 1 together, so all weigh as much as there are groups
    return docs.join(g, "lang").crossJoin(F.broadcast(total)).select("doc_id", F.round(F.col("w") / F.col("groups"), 10).alias("weight"))


@query("WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings) SELECT label, CAST(pos AS INTEGER) AS pos, round(sum(v * (1 + vec_id % 3)) / sum(1 + vec_id % 3), 6) AS mean FROM x GROUP BY 1, 2")
def agg_weights_avg(spark, d):
    x = table(spark, d, "embeddings").select("label", (1 + F.col("vec_id") % 3).alias("w"), F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", "pos").agg(F.round(F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w"), 6).alias("mean"))

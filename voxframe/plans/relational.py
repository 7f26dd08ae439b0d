"""Projections, filters, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import metrics, text
from voxframe.operators.ordering import numbered
from voxframe.operators import joins, quality
from voxframe.plans.registered import query
from voxframe.plans.tables import C, P, U, candidates, predictions, table, utterances

# ---- projections


@query(f"WITH {U} SELECT utterance_id, text AS transcript, duration FROM u")
def proj_select_rename(spark, d):
    u = utterances(spark, d).withColumnRenamed("text", "transcript")
    return u.select(*[c for c in ("utterance_id", "transcript", "duration", "not_there") if c in u.columns])


@query(f"WITH {U} SELECT utterance_id, CASE WHEN duration > 0 THEN length(replace(text, ' ', '')) / duration ELSE 0.0 END AS char_per_sec FROM u")
def proj_char_rate(spark, d):
    rate = F.length(F.replace("text", F.lit(" "), F.lit(""))) / F.col("duration")
    return utterances(spark, d).select("utterance_id", F.when(F.col("duration") > 0, rate).otherwise(0.0).alias("char_per_sec"))


@query(f"WITH {U} SELECT age_bucket, count(*) AS n, count(*) FILTER (WHERE length(replace(text, ' ', '')) / greatest(duration, 0.01) < 12.5) AS n_weak FROM u GROUP BY 1")
def proj_cps_weak(spark, d):
    cps = F.length(F.replace("text", F.lit(" "), F.lit(""))) / F.greatest("duration", F.lit(0.01))
    return utterances(spark, d).groupBy("age_bucket").agg(F.count("*").alias("n"), F.count_if(cps < 12.5).alias("n_weak"))


LABELLED = f"{U}, l AS (SELECT *, CASE WHEN ord % 3 = 0 THEN NULL ELSE text END AS label_text, CASE WHEN ord % 2 = 0 THEN ' ' ELSE role END AS word_label FROM u)"


def labelled(spark, d):
    return utterances(spark, d).select("*", F.when(F.col("ord") % 3 != 0, F.col("text")).alias("label_text"), F.when(F.col("ord") % 2 == 0, " ").otherwise(F.col("role")).alias("word_label"))


@query(f"WITH {LABELLED} SELECT utterance_id, coalesce(label_text, word_label, '') AS label FROM l")
def proj_label_coalesce(spark, d):
    return labelled(spark, d).select("utterance_id", F.coalesce("label_text", "word_label", F.lit("")).alias("label"))


@query(f"WITH {LABELLED} SELECT utterance_id, coalesce(CASE WHEN trim(label_text) <> '' THEN label_text END, CASE WHEN trim(word_label) <> '' THEN word_label END, '') AS label FROM l")
def proj_first_nonblank(spark, d):
    return labelled(spark, d).select("utterance_id", F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("label_text", "word_label")], F.lit("")).alias("label"))


@query(f"WITH {U} SELECT utterance_id, CASE WHEN ord % 2 = 0 THEN '/abs/' || utterance_id WHEN source = 'dd' THEN '/data/dd/' || utterance_id ELSE '/data/ext/' || utterance_id END AS audio_file FROM u")
def proj_audio_file(spark, d):
    u = utterances(spark, d).withColumn("path", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("/abs/"), "utterance_id")).otherwise(F.col("utterance_id")))
    root = F.when(F.col("source") == "dd", "/data/dd/").otherwise("/data/ext/")
    return u.select("utterance_id", F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(root, "path")).alias("audio_file"))


@query(f"WITH {U} SELECT utterance_id, CASE WHEN child_id IN ('c1', 'c2', 'c3', 'c30') THEN 'train' ELSE 'valid' END AS split FROM u")
def proj_split_tag(spark, d):
    return utterances(spark, d).select("utterance_id", F.when(F.col("child_id").isin("c1", "c2", "c3", "c30"), "train").otherwise("valid").alias("split"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS raw_a, l_quantity * (1 - l_discount) AS normalized_a, l_quantity * (1 - l_discount) - l_quantity AS delta_a, l_extendedprice AS raw_b, l_extendedprice * (1 + l_tax) AS normalized_b, l_extendedprice * (1 + l_tax) - l_extendedprice AS delta_b FROM lineitem")
def proj_alias_metric_delta(spark, d):
    pairs = {"a": (F.col("l_quantity"), F.col("l_quantity") * (1 - F.col("l_discount"))), "b": (F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax")))}
    made = [c for k, (raw, norm) in pairs.items() for c in (raw.alias(f"raw_{k}"), norm.alias(f"normalized_{k}"), (norm - raw).alias(f"delta_{k}"))]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *made)


TAGGED = f"{U}, t AS (SELECT utterance_id, CASE WHEN ord % 3 = 0 THEN text WHEN ord % 3 = 1 THEN 'language English<asr_text>' || text ELSE 'language None<asr_text> ' || text END AS tagged FROM u)"


def tagged(spark, d):
    t = F.when(F.col("ord") % 3 == 0, F.col("text")).when(F.col("ord") % 3 == 1, F.concat(F.lit("language English<asr_text>"), "text")).otherwise(F.concat(F.lit("language None<asr_text> "), "text"))
    return utterances(spark, d).select("utterance_id", t.alias("tagged"))


@query(f"WITH {TAGGED} SELECT utterance_id, CASE WHEN strpos(tagged, '<asr_text>') > 0 THEN substr(tagged, strpos(tagged, '<asr_text>') + 10) ELSE tagged END AS text FROM t")
def proj_prefix_strip(spark, d):
    return tagged(spark, d).select("utterance_id", text.after_tag(F.col("tagged")).alias("text"))


@query(f"WITH {TAGGED} SELECT utterance_id, CASE WHEN starts_with(tagged, 'language English') THEN 'English' ELSE '' END AS language, trim(CASE WHEN strpos(tagged, '<asr_text>') > 0 THEN substr(tagged, strpos(tagged, '<asr_text>') + 10) ELSE tagged END) AS text FROM t")
def parse_asr(spark, d):
    return tagged(spark, d).select("utterance_id", text.parse_tagged(F.col("tagged")).alias("x")).select("utterance_id", "x.*")


@query(f"WITH {U} SELECT utterance_id, greatest(len(list_filter(string_split(text, ' '), lambda w: w <> '')), 1) AS word_units, greatest(length(replace(text, ' ', '')), 1) AS char_units FROM u")
def proj_units(spark, d):
    return utterances(spark, d).select("utterance_id", F.greatest(F.size(text.words(F.col("text"))), F.lit(1)).alias("word_units"), F.greatest(F.length(F.replace("text", F.lit(" "), F.lit(""))), F.lit(1)).alias("char_units"))


@query(f"WITH {U} SELECT utterance_id, greatest(least(duration, 20.0::DOUBLE), 0.001::DOUBLE) * greatest(len(list_filter(string_split(text, ' '), lambda w: w <> '')), 1) AS cost FROM u")
def proj_rnnt_cost(spark, d):
    return utterances(spark, d).select("utterance_id", (F.greatest(F.least("duration", F.lit(20.0)), F.lit(1e-3)) * F.greatest(F.size(text.words(F.col("text"))), F.lit(1))).alias("cost"))


AGES = f"{U}, a AS (SELECT utterance_id, (['3-4', '5-7', '8-12', '12+', '9', '', '4', 'x', '5+'])[(session_id + ord) % 9 + 1] AS age FROM u)"


def ages(spark, d):
    found = F.array(*[F.lit(x) for x in ("3-4", "5-7", "8-12", "12+", "9", "", "4", "x", "5+")])
    return utterances(spark, d).select("utterance_id", F.get(found, ((F.col("session_id") + F.col("ord")) % 9).cast("int")).alias("age"))


@query(f"WITH {AGES} SELECT utterance_id, CASE WHEN age = '3-4' THEN '3-4' WHEN age IN ('5+', '5-7', '5-12', '8-12', '6-8', '6-12') THEN '5+' WHEN regexp_matches(age, '^[0-9]+') THEN CASE WHEN CAST(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER) <= 4 THEN '3-4' ELSE '5+' END ELSE '' END AS age FROM a")
def proj_age_coarse(spark, d):
    a = F.trim("age")
    first = F.regexp_extract(a, r"^(\d+)", 1)
    return ages(spark, d).select("utterance_id", F.when(a == "3-4", "3-4").when(a.isin("5+", "5-7", "5-12", "8-12", "6-8", "6-12"), "5+").when(first == "", "").when(first.try_cast("int") <= 4, "3-4").otherwise("5+").alias("age"))


@query(f"WITH {AGES} SELECT utterance_id, CASE WHEN age IN ('3-4', '5-7', '12+') THEN age WHEN age IN ('8-11', '8-12') THEN '8-11' WHEN regexp_matches(age, '^[0-9]+') THEN CASE WHEN CAST(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER) <= 4 THEN '3-4' WHEN CAST(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER) <= 7 THEN '5-7' WHEN CAST(regexp_extract(age, '^([0-9]+)', 1) AS INTEGER) <= 11 THEN '8-11' ELSE '12+' END ELSE '' END AS age FROM a")
def proj_age_fine(spark, d):
    a = F.trim("age")
    n = F.regexp_extract(a, r"^(\d+)", 1)
    k = n.try_cast("int")
    return ages(spark, d).select("utterance_id", F.when(a.isin("3-4", "5-7", "12+"), a).when(a.isin("8-11", "8-12"), "8-11").when(n == "", "").when(k <= 4, "3-4").when(k <= 7, "5-7").when(k <= 11, "8-11").otherwise("12+").alias("age"))


def _steps(value, steps, last):
    out = None
    for limit, result in steps:
        out = F.when(value <= limit, result) if out is None else out.when(value <= limit, result)
    return out.otherwise(last)


@query(f"WITH {U} SELECT utterance_id, CASE WHEN duration <= 1.5 THEN 16 WHEN duration <= 3 THEN 24 WHEN duration <= 5 THEN 32 WHEN duration <= 10 THEN 48 WHEN duration <= 15 THEN 72 WHEN duration <= 30 THEN 128 ELSE 192 END AS max_tokens FROM u")
def proj_max_tokens(spark, d):
    return utterances(spark, d).select("utterance_id", _steps(F.col("duration"), [(1.5, 16), (3, 24), (5, 32), (10, 48), (15, 72), (30, 128)], 192).alias("max_tokens"))


@query(f"WITH {U} SELECT utterance_id, CASE WHEN duration > 120 THEN 1 WHEN duration > 60 THEN least(2, 16) WHEN duration > 30 THEN least(4, 16) WHEN duration > 15 THEN least(8, 16) ELSE 16 END AS batch_size FROM u")
def proj_adaptive_bs(spark, d):
    s = F.col("duration")
    return utterances(spark, d).select("utterance_id", F.when(s > 120, 1).when(s > 60, 2).when(s > 30, 4).when(s > 15, 8).otherwise(16).alias("batch_size"))


# ---- filters


@query(f"WITH {P}, x AS (SELECT utterance_id, model, age_bucket, abs(length(pred) - length(text)) / greatest(length(text), 1)::DOUBLE AS cer, CASE WHEN ord = 5 THEN NULL ELSE abs(len(string_split(pred, ' ')) - len(string_split(text, ' '))) / len(string_split(text, ' '))::DOUBLE END AS wer FROM p) SELECT utterance_id, model FROM x WHERE CASE age_bucket WHEN '3-4' THEN coalesce(cer <= 0.05, false) OR coalesce(wer <= 0.1, false) WHEN '5-7' THEN coalesce(cer <= 0.02, false) WHEN '8-11' THEN coalesce(wer <= 0.1, false) ELSE true END")
def filter_quality(spark, d):
    p = predictions(spark, d)
    n = F.size(F.split("text", " ", -1))
    rates = p.select("utterance_id", "model", "age_bucket", (F.abs(F.length("pred") - F.length("text")) / F.greatest(F.length("text"), F.lit(1))).alias("cer"), F.when(F.col("ord") != 5, F.abs(F.size(F.split("pred", " ", -1)) - n) / n).alias("wer"))
    return quality.filter_quality(rates, {"3-4": 0.05, "5-7": 0.02}, {"3-4": 0.1, "8-11": 0.1}, "or").select("utterance_id", "model")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE duration < 20")
def filter_duration_lt(spark, d):
    return utterances(spark, d).where("duration < 20").select("utterance_id")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE length(text) <= 300")
def filter_max_text_len(spark, d):
    return utterances(spark, d).where(F.length("text") <= 300).select("utterance_id")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE duration >= 30.0")
def filter_long_only(spark, d):
    return utterances(spark, d).where("duration >= 30.0").select("utterance_id")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE utterance_id <> 'u3_1' AND duration < 30 AND (duration <= 0 OR length(text) / duration <= 20)")
def filter_valid_entry(spark, d):
    return utterances(spark, d).where(quality.is_valid_entry(F.col("text"), F.col("duration"), F.col("utterance_id") == "u3_1")).select("utterance_id")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE utterance_id NOT IN ('u1_1', 'u2_2')")
def filter_bad_id(spark, d):
    return utterances(spark, d).where(~F.col("utterance_id").isin("u1_1", "u2_2")).select("utterance_id")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE floor(CAST(trunc(greatest(duration / 3, 0) * 16000) AS INTEGER) / 320) > length(text) AND length(text) > 0")
def filter_ctc_feasible(spark, d):
    return utterances(spark, d).where(quality.is_ctc_feasible(F.col("duration") / 3, F.length("text"))).select("utterance_id")


@query("SELECT page_id FROM pages WHERE octet_length(encode(html)) > 1024")
def filter_file_valid(spark, d):
    pages = table(spark, d, "pages").select("page_id", (F.length(F.col("html").cast("binary")) <= 1024).alias("bad"))
    quality.check_ratio(pages, F.col("bad"), 0.9)
    return pages.where("NOT bad").select("page_id")


@query(f"WITH {C} SELECT uid, idx FROM c WHERE coalesce(s1 - 30 >= -2.0 AND s2 - 0.05 >= 0.0, false)")
def filter_audio_delta(spark, d):
    keep = (F.col("s1") - 30 >= -2.0) & (F.col("s2") - 0.05 >= 0.0)
    return candidates(spark, d).where(F.coalesce(keep, F.lit(False))).select("uid", "idx")


@query(f"WITH {P}, m AS (SELECT * FROM (VALUES (0, 0.0, 5.0), (1, 2.0, 15.0), (3, 10.0, NULL)) t(model, lo, hi)) SELECT p.utterance_id, p.model FROM p JOIN m ON p.model = m.model AND p.duration >= m.lo AND (m.hi IS NULL OR p.duration <= m.hi)")
def filter_model_duration(spark, d):
    limits = spark.createDataFrame([(0, 0.0, 5.0), (1, 2.0, 15.0), (3, 10.0, None)], "model int, lo double, hi double")
    p = predictions(spark, d)
    return p.join(F.broadcast(limits), "model").where((F.col("duration") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("duration") <= F.col("hi")))).select("utterance_id", "model")


@query(f"WITH {C} SELECT uid, idx FROM c WHERE coalesce(CASE WHEN idx % 4 <> 1 THEN s2 * 10 END, 0) >= 0.7")
def filter_pseudo_score(spark, d):
    score = F.when(F.col("idx") % 4 != 1, F.col("s2") * 10)
    return candidates(spark, d).where(F.coalesce(score, F.lit(0)) >= 0.7).select("uid", "idx")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE duration BETWEEN 2.5 AND 4.0 AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) >= 3")
def filter_eligible_clip(spark, d):
    return utterances(spark, d).where(F.col("duration").between(2.5, 4.0) & (F.size(text.words(F.col("text"))) >= 3)).select("utterance_id")


NORM_SIMPLE = "trim(regexp_replace(lower(regexp_replace(translate({0}, '’‘', ''''''), '[^A-Za-z0-9'']', ' ', 'g')), ' +', ' ', 'g'))"


@query(f"WITH {U} SELECT utterance_id FROM u WHERE {NORM_SIMPLE.format('CASE WHEN ord = 3 THEN chr(233) ELSE text END')} <> ''")
def filter_empty_after_norm(spark, d):
    u = utterances(spark, d).withColumn("text", F.when(F.col("ord") == 3, "é").otherwise(F.col("text")))
    return u.where(text.norm_simple(F.col("text")) != "").select("utterance_id")


@query(f"WITH {U} SELECT utterance_id FROM u WHERE regexp_matches(CASE WHEN ord = 2 THEN text || '中文' ELSE text END, '[一-鿿]')")
def filter_contains_cjk(spark, d):
    u = utterances(spark, d).withColumn("text", F.when(F.col("ord") == 2, F.concat("text", F.lit("中文"))).otherwise(F.col("text")))
    return u.where(F.col("text").rlike("[一-鿿]")).select("utterance_id")


@query(f"WITH {LABELLED} SELECT utterance_id, trim(word_label) AS label FROM l WHERE trim(word_label) <> ''")
def filter_nonempty_text(spark, d):
    return labelled(spark, d).select("utterance_id", F.trim("word_label").alias("label")).where("label <> ''")


@query(f"WITH {U} SELECT child_id, count(*) AS n FROM u GROUP BY 1 HAVING count(*) >= 20")
def filter_having(spark, d):
    return utterances(spark, d).groupBy("child_id").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"WITH {P} SELECT utterance_id FROM p GROUP BY 1 HAVING count(DISTINCT CASE WHEN {NORM_SIMPLE.format('pred')} <> '' THEN {NORM_SIMPLE.format('pred')} END) = 2")
def filter_two_way(spark, d):
    p = predictions(spark, d).select("utterance_id", text.norm_simple(F.col("pred")).alias("k")).where("k <> ''")
    return p.groupBy("utterance_id").agg(F.count_distinct("k").alias("n")).where("n = 2").select("utterance_id")


@query(f"WITH {U}, s AS (SELECT utterance_id, unnest(range(1, CAST(ceil(duration / 25.0) AS BIGINT) + 1)) AS part, duration FROM u) SELECT utterance_id, part FROM s WHERE duration - 25.0 * (part - 1) <= 30 ")
def filter_length_margin(spark, d):
    s = utterances(spark, d).select("utterance_id", "duration", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("duration") / 25.0))).alias("part"))
    return s.where(F.col("duration") - 25.0 * (F.col("part") - 1) <= 30).select("utterance_id", "part")


# ---- joins


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, o.o_totalprice FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_totalprice < 100000")
def join_left_duration(spark, d):
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return line.join(orders, line.l_orderkey == orders.o_orderkey, "left").where("o_totalprice < 100000").drop("o_orderkey")


@query("SELECT c_mktsegment, count(*) AS n_rows, count(o_orderkey) AS n_matched, round(sum(o_totalprice), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left_pred(spark, d):
    c, o = table(spark, d, "customer").select("c_custkey", "c_mktsegment"), table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_mktsegment").agg(F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_matched"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN r ON c_custkey = o_custkey AND k = 1")
def join_left_dedup_right(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return joins.left_dedup(c, o, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query(f"WITH {U}, r AS (SELECT utterance_id, child_id, length(text) AS n FROM u WHERE ord % 2 = 0) SELECT u.utterance_id, u.child_id, r.n FROM u LEFT JOIN r ON u.utterance_id = r.utterance_id AND u.child_id = r.child_id")
def join_left_composite(spark, d):
    u = utterances(spark, d)
    r = u.where("ord % 2 = 0").select("utterance_id", "child_id", F.length("text").alias("n"))
    return u.select("utterance_id", "child_id").join(r, ["utterance_id", "child_id"], "left")


@query(f"WITH {C} SELECT a.uid, a.idx, b.s1 AS other FROM c a LEFT JOIN (SELECT uid, idx, s1 FROM c WHERE s2 > 0.05) b ON a.uid = b.uid AND a.idx = b.idx")
def join_left_candidate(spark, d):
    c = candidates(spark, d)
    return c.select("uid", "idx").join(c.where("s2 > 0.05").select("uid", "idx", F.col("s1").alias("other")), ["uid", "idx"], "left")


@query("WITH r AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) SELECT c_custkey, coalesce(o_orderpriority, '') AS o_orderpriority FROM customer LEFT JOIN r ON c_custkey = o_custkey AND k = 1")
def join_lookup_map(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_orderdate", "o_orderkey")
    return joins.lookup(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "o_orderpriority", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT s_suppkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_inner_asserted(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return joins.inner_asserted(s, table(spark, d, "nation"), "n_nationkey").select("s_suppkey", "n_name", "n_regionkey")


@query(f"WITH {P} SELECT a.utterance_id, a.pred AS pred_0, b.pred AS pred_1, c.pred AS pred_2, coalesce(a.text, b.text, c.text) AS text FROM p a JOIN p b USING (utterance_id) JOIN p c USING (utterance_id) WHERE a.model = 0 AND b.model = 1 AND c.model = 2 AND a.ord % 5 <> 1 AND b.ord % 7 <> 2")
def join_inner_nway(spark, d):
    p = predictions(spark, d)
    return joins.inner_nway([p.where("model = 0 AND ord % 5 <> 1"), p.where("model = 1 AND ord % 7 <> 2"), p.where("model = 2")], "utterance_id", "pred", truth="text")


@query(f"WITH {P} SELECT a.utterance_id, length(a.pred) AS len_a, length(b.pred) AS len_b, u.duration FROM p a JOIN p b ON a.utterance_id = b.utterance_id AND a.model = 1 AND b.model = 2 JOIN u ON u.utterance_id = a.utterance_id")
def join_inner_pair(spark, d):
    p, u = predictions(spark, d), utterances(spark, d)
    a = p.where("model = 1").select("utterance_id", F.length("pred").alias("len_a"))
    b = p.where("model = 2").select("utterance_id", F.length("pred").alias("len_b"))
    return a.join(b, "utterance_id").join(u.select("utterance_id", "duration"), "utterance_id")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_inner_phon_word(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    return table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("there", F.lit(False)).alias("labelled"), "quality")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def semi_join(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def anti_join(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_anti")


@query(f"WITH {U}, f AS (SELECT *, CASE WHEN source = 'ext' AND ord % 2 = 0 THEN -1 ELSE session_id % 5 END AS fold FROM u) SELECT utterance_id, fold FROM f WHERE NOT (source = 'ext' AND fold = -1 AND child_id IN (SELECT child_id FROM f WHERE source = 'dd' AND fold = 2))")
def anti_join_leak(spark, d):
    f = utterances(spark, d).withColumn("fold", F.when((F.col("source") == "ext") & (F.col("ord") % 2 == 0), F.lit(-1).cast("long")).otherwise(F.col("session_id") % 5))
    return joins.drop_leaking(f, 2).select("utterance_id", "fold")


@query(f"WITH {U} SELECT DISTINCT a.child_id, a.role FROM u a WHERE a.ord = 0 AND NOT EXISTS (SELECT 1 FROM u b WHERE b.ord = 4 AND b.child_id = a.child_id AND b.role = a.role)")
def anti_join_pair(spark, d):
    u = utterances(spark, d)
    return u.where("ord = 0").select("child_id", "role").distinct().join(u.where("ord = 4").select("child_id", "role"), ["child_id", "role"], "left_anti")


@query("SELECT s.s_suppkey, n.n_name FROM supplier s CROSS JOIN nation n WHERE NOT (s.s_nationkey = n.n_nationkey)")
def cross_join(spark, d):
    s, n = table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    done = s.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    # speakers by words that are still to be spoken: a full product by definition
    return s.select("s_suppkey").crossJoin(F.broadcast(n)).join(done, ["s_suppkey", "n_nationkey"], "left_anti").select("s_suppkey", "n_name")


@query(f"WITH {C} SELECT a.uid, a.idx AS i, b.idx AS j, abs(a.s0 - b.s0) AS gap FROM c a JOIN c b ON a.uid = b.uid AND a.idx <> b.idx")
def self_join_pairs(spark, d):
    c = candidates(spark, d)
    a, b = c.select("uid", F.col("idx").alias("i"), F.col("s0").alias("x")), c.select("uid", F.col("idx").alias("j"), F.col("s0").alias("y"))
    return a.join(b, "uid").where("i <> j").select("uid", "i", "j", F.abs(F.col("x") - F.col("y")).alias("gap"))


@query(f"WITH {U}, s AS (SELECT utterance_id || '_' || lpad(CAST(k AS VARCHAR), 3, '0') AS id FROM u, range(0, 2) r(k)) SELECT s.id, u.child_id, u.session_id, u.age_bucket FROM s JOIN u ON regexp_replace(s.id, '_[^_]*$', '') = u.utterance_id")
def join_meta_attach(spark, d):
    u = utterances(spark, d)
    s = u.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "utterance_id").select(F.format_string("%s_%03d", "utterance_id", "k").alias("id"))
    return s.withColumn("utterance_id", text.parent_id(F.col("id"))).join(u.select("utterance_id", "child_id", "session_id", "age_bucket"), "utterance_id").drop("utterance_id")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS in_a, l.doc_id IS NOT NULL AS in_b FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l ON d.doc_id = l.doc_id")
def full_outer_presence(spark, d):
    return joins.presence(table(spark, d, "documents").where("lang = 'en'"), table(spark, d, "labels"), "doc_id")


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN '/raw/' || page_id WHEN page_id % 2 = 0 THEN '/alt/' || page_id END AS path FROM pages")
def path_resolve(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    listing = pages.where("page_id % 3 = 0").select(F.concat(F.lit("/raw/"), F.col("page_id").cast("string")).alias("path")).unionByName(pages.where("page_id % 2 = 0").select(F.concat(F.lit("/alt/"), F.col("page_id").cast("string")).alias("path")))
    tries = [F.concat(F.lit(x), F.col("page_id").cast("string")) for x in ("/raw/", "/alt/", "/none/")]
    return joins.first_existing(tries, listing, pages).select("url", "path")


# ---- sets


@query(f"WITH {U} SELECT utterance_id, text, NULL AS role FROM u WHERE source = 'dd' UNION ALL SELECT utterance_id, NULL, role FROM u WHERE source = 'ext'")
def union_all(spark, d):
    u = utterances(spark, d)
    return u.where("source = 'dd'").select("utterance_id", "text").unionByName(u.where("source = 'ext'").select("utterance_id", "role"), allowMissingColumns=True)


@query(f"WITH {U} SELECT utterance_id AS id, duration FROM u WHERE duration < 30 UNION ALL SELECT utterance_id || '_' || lpad(CAST(k AS VARCHAR), 3, '0'), duration / 2 FROM u, range(0, 2) r(k) WHERE duration >= 30")
def union_then_replace(spark, d):
    u = utterances(spark, d).select(F.col("utterance_id").alias("id"), "duration")
    long = u.where("duration >= 30")
    parts = long.select("id", "duration", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select(F.col("id").alias("parent"), F.format_string("%s_%03d", "id", "k").alias("id"), (F.col("duration") / 2).alias("duration"))
    kept = u.join(parts.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    return kept.unionByName(parts.drop("parent"))


KEYS = f"{P}, k AS (SELECT utterance_id, model FROM p WHERE NOT (model = 1 AND ord = 2) AND NOT (model = 3 AND session_id % 10 = 4))"


def keys(spark, d):
    return predictions(spark, d).where("NOT (model = 1 AND ord = 2) AND NOT (model = 3 AND session_id % 10 = 4)").select("utterance_id", "model")


@query(f"WITH {KEYS} SELECT utterance_id FROM k GROUP BY 1 HAVING count(DISTINCT model) = 4")
def intersect_keys(spark, d):
    return keys(spark, d).groupBy("utterance_id").agg(F.count_distinct("model").alias("n")).where("n = 4").select("utterance_id")


@query(f"WITH {KEYS} SELECT utterance_id FROM k WHERE model = 1 EXCEPT SELECT utterance_id FROM k WHERE model = 3")
def except_keys(spark, d):
    k = keys(spark, d)
    return k.where("model = 1").select("utterance_id").subtract(k.where("model = 3").select("utterance_id"))


@query(f"WITH {KEYS}, h AS (SELECT utterance_id, count(*) AS n FROM k GROUP BY 1), t AS (SELECT count(*) AS all_ids FROM h) SELECT k.model, count(*) AS n_ids, count(*) FILTER (WHERE h.n = 1) AS only_here, max(t.all_ids) - count(*) AS missing FROM k JOIN h USING (utterance_id), t GROUP BY 1")
def uid_set_validation(spark, d):
    k = keys(spark, d)
    held = k.groupBy("utterance_id").agg(F.count("*").alias("n"))
    total = held.agg(F.count("*").alias("all_ids"))
    return k.join(held, "utterance_id").crossJoin(F.broadcast(total)).groupBy("model").agg(F.count("*").alias("n_ids"), F.count_if(F.col("n") == 1).alias("only_here"), (F.max("all_ids") - F.count("*")).alias("missing"))


@query(f"WITH {U} SELECT count(*) AS n_shared FROM (SELECT child_id FROM u WHERE session_id % 37 < 20 INTERSECT SELECT child_id FROM u WHERE session_id % 37 >= 20)")
def overlap_assert(spark, d):
    u = utterances(spark, d)
    return u.where("session_id % 37 < 20").select("child_id").intersect(u.where("session_id % 37 >= 20").select("child_id")).agg(F.count("*").alias("n_shared"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) WHERE k = 1")
def dedup_keep_first(spark, d):
    return joins.keep_first(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]).select("l_orderkey", "l_partkey", "l_quantity")


@query(f"WITH {P} SELECT utterance_id, key, model FROM (SELECT utterance_id, model, {NORM_SIMPLE.format('pred')} AS key, row_number() OVER (PARTITION BY utterance_id, {NORM_SIMPLE.format('pred')} ORDER BY model) AS k FROM p) WHERE k = 1")
def candidate_pool(spark, d):
    p = predictions(spark, d).select("utterance_id", "model", text.norm_simple(F.col("pred")).alias("key"))
    return joins.keep_first(p, ["utterance_id", "key"], ["model"])


POWERSET = f"""{P}, k AS (SELECT utterance_id, model, text, pred, {NORM_SIMPLE.format('pred')} AS key, {NORM_SIMPLE.format('text')} AS ref FROM p),
  s AS (SELECT m FROM range(1, 16) r(m)), v AS (SELECT m, utterance_id, key, count(*) AS votes, min(model) AS first, any_value(ref) AS ref FROM s JOIN k ON (m >> model) & 1 = 1 GROUP BY 1, 2, 3),
  b AS (SELECT m, key, ref FROM (SELECT *, row_number() OVER (PARTITION BY m, utterance_id ORDER BY key = '', votes DESC, first) AS p FROM v) WHERE p = 1),
  e AS (SELECT m, sum(CASE WHEN ref = key THEN 0 ELSE levenshtein(ref, key) END) / sum(length(ref))::DOUBLE AS cer FROM b GROUP BY 1)"""


@query(f"WITH {POWERSET} SELECT CAST(m AS INTEGER) AS mask, bit_count(m)::INTEGER AS n_models, round(cer, 9) AS cer, rank() OVER (ORDER BY round(cer, 9)) AS place FROM e")
def powerset_sweep(spark, d):
    """Every set of models: its majority vote's character error rate over all utterances, and its rank among the sets."""
    p = predictions(spark, d).select("utterance_id", "model", text.norm_simple(F.col("pred")).alias("key"), text.norm_simple(F.col("text")).alias("ref"))
    # fifteen sets of up to four models, whatever the rows
    hit = p.select("*", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("mask")).where(F.expr("(mask >> model) & 1 = 1"))
    votes = hit.groupBy("mask", "utterance_id", "key").agg(F.count("*").alias("votes"), F.min("model").alias("first"), F.any_value("ref").alias("ref"))
    best = votes.groupBy("utterance_id", "mask").agg(F.min_by(F.struct("key", "ref"), F.struct((F.col("key") == "").cast("int"), -F.col("votes"), "first")).alias("b"))
    # an utterance's sets choose among few texts, so each is compared once
    told = best.groupBy("utterance_id", "b.key", "b.ref").agg(F.collect_list("mask").alias("masks"))
    told = told.select(metrics.char_distance(F.col("ref"), F.col("key")).alias("ed"), F.length("ref").alias("n"), F.explode("masks").alias("mask"))
    out = told.groupBy("mask").agg(F.round(F.sum("ed") / F.sum("n"), 9).alias("cer"))
    # one row per set
    return out.select("mask", F.bit_count("mask").alias("n_models"), "cer", F.rank().over(W.partitionBy().orderBy("cer")).cast("long").alias("place"))


# ---- sorts and tops


@query(f"WITH {U} SELECT row_number() OVER (ORDER BY child_id, session_id, utterance_id) AS place, utterance_id FROM u")
def sort_multi(spark, d):
    u = utterances(spark, d).select("child_id", "session_id", "utterance_id")
    return numbered(u, ["child_id", "session_id", "utterance_id"]).select((F.col("place")).alias("place"), "utterance_id")


@query(f"WITH {U} SELECT row_number() OVER (ORDER BY duration DESC, utterance_id) AS place, utterance_id FROM u")
def sort_duration_desc(spark, d):
    return numbered(utterances(spark, d).select("utterance_id", "duration"), [F.desc("duration"), "utterance_id"]).select("place", "utterance_id")


@query(f"WITH {U} SELECT row_number() OVER (ORDER BY len(list_filter(string_split(text, ' '), lambda w: w <> '')) DESC, utterance_id) AS place, utterance_id FROM u")
def sort_length_desc(spark, d):
    u = utterances(spark, d).select("utterance_id", F.size(text.words(F.col("text"))).alias("n"))
    return numbered(u, [F.desc("n"), "utterance_id"]).select("place", "utterance_id")


@query(f"WITH {U} SELECT row_number() OVER (ORDER BY CASE WHEN age_bucket = 'unknown' THEN 999 ELSE CAST(regexp_extract(age_bucket, '^([0-9]+)', 1) AS INTEGER) END, utterance_id) AS place, age_bucket, utterance_id FROM u")
def sort_custom_age(spark, d):
    u = utterances(spark, d).select("utterance_id", "age_bucket", F.coalesce(F.regexp_extract("age_bucket", r"^(\d+)", 1).try_cast("int"), F.lit(999)).alias("age"))
    return numbered(u, ["age", "utterance_id"]).select("place", "age_bucket", "utterance_id")


@query(f"WITH {U} SELECT utterance_id, duration FROM u ORDER BY duration DESC, utterance_id LIMIT 25")
def topk_global(spark, d):
    return utterances(spark, d).select("utterance_id", "duration").orderBy(F.desc("duration"), "utterance_id").limit(25)


@query(f"WITH {U}, w AS (SELECT unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word FROM u) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 15")
def topk_counter(spark, d):
    return utterances(spark, d).select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(15)


@query(f"WITH {U}, r AS (SELECT *, row_number() OVER (PARTITION BY child_id ORDER BY abs(duration - 3.0), utterance_id) AS k FROM u), a AS (SELECT *, row_number() OVER (PARTITION BY age_bucket ORDER BY md5(utterance_id)) AS j FROM r WHERE k = 1) SELECT child_id, age_bucket, utterance_id FROM a WHERE age_bucket = 'unknown' OR j <= 3")
def topk_per_group(spark, d):
    closest = joins.keep_first(utterances(spark, d), ["child_id"], [F.abs(F.col("duration") - 3.0), "utterance_id"])
    drawn = closest.withColumn("j", F.row_number().over(W.partitionBy("age_bucket").orderBy(F.md5(F.col("utterance_id").cast("binary")))))
    return drawn.where("age_bucket = 'unknown' OR j <= 3").select("child_id", "age_bucket", "utterance_id")


@query(f"WITH {C}, r AS (SELECT *, idx = 0 OR s2 = 0 AS forced, row_number() OVER (PARTITION BY uid ORDER BY CASE WHEN idx = 0 OR s2 = 0 THEN 0 ELSE 1 END, s0 DESC, idx) AS k FROM c) SELECT uid, idx FROM r WHERE forced OR k <= 3")
def topk_prune(spark, d):
    c = candidates(spark, d).withColumn("forced", (F.col("idx") == 0) | (F.col("s2") == 0))
    k = F.row_number().over(W.partitionBy("uid").orderBy(F.desc("forced"), F.desc("s0"), "idx"))
    return c.withColumn("k", k).where("forced OR k <= 3").select("uid", "idx")


@query(f"WITH {P}, x AS (SELECT utterance_id, sum(CASE model WHEN 1 THEN length(pred) WHEN 2 THEN -length(pred) ELSE 0 END) AS delta FROM p GROUP BY 1) (SELECT 'low' AS side, utterance_id, CAST(delta AS BIGINT) AS delta FROM x ORDER BY delta, utterance_id LIMIT 10) UNION ALL (SELECT 'high', utterance_id, CAST(delta AS BIGINT) FROM x ORDER BY delta DESC, utterance_id LIMIT 10)")
def extremes_both(spark, d):
    x = predictions(spark, d).groupBy("utterance_id").agg(F.sum(F.when(F.col("model") == 1, F.length("pred")).when(F.col("model") == 2, -F.length("pred")).otherwise(0)).alias("delta"))
    side = lambda s, o: x.orderBy(o, "utterance_id").limit(10).select(F.lit(s).alias("side"), "utterance_id", "delta")
    return side("low", F.asc("delta")).unionAll(side("high", F.desc("delta")))


@query(f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY s1 DESC, idx) AS hi, row_number() OVER (PARTITION BY uid ORDER BY s1, idx) AS lo FROM c) SELECT uid, max(CASE WHEN hi = 1 THEN idx END) AS argmax, max(CASE WHEN lo = 1 THEN idx END) AS argmin FROM r GROUP BY 1")
def arg_extremes_per_group(spark, d):
    pick = lambda s: F.min(F.struct(s, "idx"))["idx"]
    return candidates(spark, d).select("uid", "idx", "s1", (-F.col("s1")).alias("neg")).groupBy("uid").agg(pick("neg").alias("argmax"), pick("s1").alias("argmin"))


@query(f"WITH {U} SELECT utterance_id FROM u ORDER BY session_id, ord LIMIT 100")
def limit_n(spark, d):
    return utterances(spark, d).orderBy("session_id", "ord").limit(100).select("utterance_id")


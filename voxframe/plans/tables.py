"""What the star schema's tables stand for in a transcript corpus, in both dialects.

A turn of a conversation is an utterance, its conversation the session, a residue of the conversation the child.
Model outputs are fixed corruptions of the transcript, one for each of four models. Candidate rows with several scores
are the lines of an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxframe.operators import fusion


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of few, small partitions dealt by key over all cores, for expressions that cost far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    ages = F.array(*[F.lit(x) for x in ("3-4", "5-7", "8-11", "12+", "unknown")])
    return c.select(
        F.format_string("u%d_%d", "conv_id", "turn").alias("utterance_id"),
        F.concat(F.lit("c"), (F.col("conv_id") % 37).cast("string")).alias("child_id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn").cast("int").alias("ord"),
        "role",
        "text",
        (F.length("text") / F.lit(15.0)).alias("duration"),
        F.get(ages, (F.col("conv_id") % 5).cast("int")).alias("age_bucket"),
        F.when(F.col("conv_id") % 4 == 0, "dd").otherwise("ext").alias("source"),
    )


U = """u AS (
  SELECT 'u' || conv_id || '_' || turn AS utterance_id, 'c' || (conv_id % 37) AS child_id, conv_id AS session_id, CAST(turn AS INTEGER) AS ord, role, text,
         length(text) / 15.0::DOUBLE AS duration, (['3-4', '5-7', '8-11', '12+', 'unknown'])[conv_id % 5 + 1] AS age_bucket, CASE WHEN conv_id % 4 = 0 THEN 'dd' ELSE 'ext' END AS source
  FROM conversations
)"""


def predictions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Long form: one row per utterance and model, with the model's place in the ensemble.

    ``dealt`` ones lie by utterance over several partitions a core: a file's pieces are few, or hold no rows, however
    many tasks read it. Only the transcripts are shuffled for that, and grouping by utterance needs no other shuffle.
    """
    u = utterances(spark, sf_dir)
    u = fusion.dealt(u) if dealt else u
    words = F.split("text", " ", -1)
    preds = [
        F.col("text"),
        F.array_join(F.filter(words, lambda w, i: (i + F.col("ord")) % 7 != 3), " "),
        F.replace(F.replace("text", F.lit("en"), F.lit("an")), F.lit("th"), F.lit("t")),
        F.when(F.col("ord") % 2 == 0, F.col("text")).otherwise(F.array_join(F.transform(words, lambda w, i: F.when(i % 5 == 4, F.lit("um")).otherwise(w)), " ")),
    ]
    made = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), p.alias("pred")) for i, p in enumerate(preds)]))
    return u.select("*", made.alias("_p")).select(*u.columns, "_p.model", "_p.pred")


P = (
    U
    + """, p AS (
  SELECT u.*, unnest([0, 1, 2, 3]) AS model, unnest([text,
    array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1 + ord) % 7 <> 3), ' '),
    replace(replace(text, 'en', 'an'), 'th', 't'),
    CASE WHEN ord % 2 = 0 THEN text ELSE array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 5 = 4 THEN 'um' ELSE w END), ' ') END]) AS pred
  FROM u
)"""
)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of an utterance: lines of an order, numbered by a full tie-break; three model scores each."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    c = table(spark, sf_dir, "lineitem")
    return c.select(F.col("l_orderkey").alias("uid"), (F.row_number().over(order) - 1).alias("idx"), F.col("l_extendedprice").alias("s0"), F.col("l_quantity").alias("s1"), F.col("l_discount").alias("s2"), F.col("l_partkey").alias("part"))


C = """c AS (
  SELECT l_orderkey AS uid, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS INTEGER) AS idx,
         l_extendedprice AS s0, l_quantity AS s1, l_discount AS s2, l_partkey AS part
  FROM lineitem
)"""


def word_table(pairs: str, keys: str) -> str:
    """SQL of word edit distances: dp (keys, n, ed) of pairs (keys, a, b) of lists, a row of the table at a time.

    A cell is the least of those above and of insertions after them, which are a running minimum.
    """
    above = "list_transform(range(1, len(b) + 2), lambda j: CASE WHEN j = 1 THEN cells[1] + 1 ELSE least(cells[j] + 1, cells[j - 1] + CASE WHEN b[j - 1] = a[step + 1] THEN 0 ELSE 1 END) END - j)"
    return f"""dr AS (
  SELECT {keys}, a, b, CASE WHEN a = b THEN len(a) ELSE 0 END AS step, CASE WHEN a = b THEN [0::BIGINT] ELSE range(0, len(b) + 1) END AS cells FROM {pairs}
  UNION ALL
  SELECT {keys}, a, b, step + 1, list_transform(range(1, len(t) + 1), lambda j: list_min(t[1:j]) + j) FROM (SELECT *, {above} AS t FROM dr WHERE step < len(a))
), dp AS (SELECT {keys}, len(a) AS n, CAST(cells[len(cells)] AS INTEGER) AS ed FROM dr WHERE step = len(a))"""

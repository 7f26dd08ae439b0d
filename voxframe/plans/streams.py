"""Structured Streaming over files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxframe.plans.registered import query
from voxframe.plans.tables import table, utterances
from voxframe.sources.workdir import new_path
from voxframe.streaming import machines


def stream_of(spark, df, label):
    path = new_path(spark, label)
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{path}/in"), path


def pieces(spark, d, *columns):
    """Utterances as pieces of their session's stream; the last one says so."""
    u = utterances(spark, d).select("session_id", "ord", *columns)
    ends = u.groupBy("session_id").agg(F.max("ord").alias("_end"))
    return u.join(ends, "session_id").select(*u.columns, (F.col("ord") == F.col("_end")).alias("last"))


HEARD = "WITH s AS (SELECT conv_id AS session_id, string_agg(text, '' ORDER BY turn) AS t, sum(length(text)) AS n FROM conversations GROUP BY 1)"


@query(f"{HEARD}, c AS (SELECT session_id, unnest(range(CAST(n // 200 AS BIGINT))) AS chunk, t FROM s), w AS (SELECT *, string_split(substr(t, 1, 200 * chunk), ' ') AS w FROM c) SELECT session_id, CAST(chunk AS INTEGER) AS chunk, CAST(200 * (chunk + 1) AS INTEGER) AS heard, CASE WHEN chunk >= 2 THEN array_to_string(w[1 : greatest(len(w) - 5, 0)], ' ') ELSE '' END AS prefix FROM w")
def stream_chunk_accumulate(spark, d):
    """Full chunks of each session's stream; every chunk hears all before it and keeps a prefix of what was decoded."""
    s, path = stream_of(spark, pieces(spark, d, "text"), "chunks")
    return machines.run_once(spark, machines.chunk_stream(s, 200), path).where("NOT flushed").drop("flushed")


@query(f"{HEARD} SELECT session_id, CAST(n // 200 AS INTEGER) AS chunk, CAST(n % 200 AS INTEGER) AS tail FROM s WHERE n % 200 > 0")
def stream_flush(spark, d):
    """What a session's buffer holds when its last piece has come, emitted once; an empty buffer emits nothing."""
    s, path = stream_of(spark, pieces(spark, d, "text"), "chunks")
    out = machines.run_once(spark, machines.chunk_stream(s, 200), path).where("flushed")
    return out.select("session_id", "chunk", (F.col("heard") - 200 * F.col("chunk")).alias("tail"))


FRAMES = "p AS (SELECT conv_id AS session_id, turn, text, unnest(range(greatest(length(text) // 10, 1))) AS i FROM conversations), f AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn, i) - 1 AS k, length(regexp_replace(substr(text, 1 + 10 * i, 10), '[^aeiou]', '', 'g')) / 6.0 AS p FROM p)"


@query(f"WITH {FRAMES}, t AS (SELECT session_id, count(*) AS total FROM f GROUP BY 1), h AS (SELECT session_id, k, lead(k) OVER (PARTITION BY session_id ORDER BY k) AS nxt FROM f WHERE p >= 0.5), g AS (SELECT h.session_id, h.k, min(f.k) AS low, coalesce(max(f.k) - min(f.k) + 1 >= 2, FALSE) AS ends FROM h LEFT JOIN f ON f.session_id = h.session_id AND f.p < 0.35 AND f.k > h.k AND (f.k < h.nxt OR h.nxt IS NULL) GROUP BY ALL), r AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM g) SELECT r.session_id, CAST(greatest(min(k) - 1, 0) AS INTEGER) AS start, CAST(coalesce(max(CASE WHEN ends THEN low + 1 END), max(total)) AS INTEGER) AS stop, NOT bool_or(ends) AS flushed FROM r JOIN t ON t.session_id = r.session_id GROUP BY r.session_id, run")
def stream_vad_hysteresis(spark, d):
    """Spans of speech; a frame's probability is the share of vowels in ten characters."""
    chars = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.length("text") / 10).cast("int") - 1, F.lit(0))), lambda i: F.length(F.regexp_replace(F.substr("text", 1 + 10 * i, F.lit(10)), "[^aeiou]", "")) / 6.0)
    s, path = stream_of(spark, pieces(spark, d, chars.alias("p")), "speech")
    return machines.run_once(spark, machines.speech_stream(s), path)


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 10 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 10 MINUTE) AS stop, count(*) AS n FROM s GROUP BY user_id, k")
def stream_session_ttl(spark, d):
    """Sessions of each user, ended ten minutes after the last event. The events come in three slices of time, each a run
    of the stream that goes on from the state of the one before; a clock row past the last lets the timers end the rest."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("clock"))
    first, last = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if first is None:
        return e.limit(0).select("user_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("stop"), F.lit(0).cast("long").alias("n"))
    at = lambda k: F.unix_micros("ts") >= first + (last - first) * k // 3
    clock = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.timestamp_micros(F.lit(last + 86_400_000_000)).alias("ts"), F.lit(True).alias("clock"))
    slices = [e.where(~at(1)), e.where(at(1) & ~at(2)), e.where(at(2)), clock]
    out = machines.run_slices(spark, slices, machines.session_stream, new_path(spark, "sessions"))
    return out.select("user_id", "start", (F.col("last") + 600_000_000).alias("stop"), "n")

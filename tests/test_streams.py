"""Streams over several micro-batches: sessions that end by timers, lazily, and by idleness."""

import time

from pyspark.sql import functions as F

from voxframe.streaming import machines


def test_sessions_end_lazily_by_timer_and_after_restarts(spark, tmp_path):
    us, day = 1_000_000, 86_400
    rows = [[(1, 0), (2, 5), (1, 30)], [(1, 90), (2, 300), (3, 301)], [(2, 310), (1, 1000)]]
    make = lambda part, clock=False: spark.createDataFrame([(u, (day + t) * us, clock) for u, t in part], "user_id long, us long, clock boolean").select("user_id", F.timestamp_micros("us").alias("ts"), "clock")
    slices = [make(p) for p in rows] + [make([(None, 10_000)], True)]
    out = machines.run_slices(spark, slices, lambda s: machines.session_stream(s, 60 * us), str(tmp_path))
    got = sorted((r.user_id, r.start // us - day, r["last"] // us - day, r.n) for r in out.collect())
    # exactly the time to live still belongs, more does not
    assert got == [(1, 0, 90, 3), (1, 1000, 1000, 1), (2, 5, 5, 1), (2, 300, 310, 2), (3, 301, 301, 1)]


def test_a_buffer_is_flushed_when_its_session_idles(spark, tmp_path):
    rows = [(s, k, "word " * n, False) for s, n in ((1, 50), (2, 7)) for k in range(2)]
    kind = "session_id long, ord int, text string, last boolean"
    spark.createDataFrame(rows[:3], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = machines.chunk_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), 200, idle_ms=4000)
    run = stream.writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        time.sleep(3)
        spark.createDataFrame(rows[3:], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        end = time.time() + 60
        while time.time() < end and spark.table("idle").where("flushed").count() < 2:
            time.sleep(0.5)
        got = sorted(tuple(r) for r in spark.table("idle").where("flushed").select("session_id", "heard").collect())
    finally:
        run.stop()
    assert got == [(1, 500), (2, 70)]


def test_speech_ends_when_its_session_idles(spark, tmp_path):
    kind = "session_id long, ord int, p array<double>, last boolean"
    spark.createDataFrame([(1, 0, [0.9, 0.9, 0.8], False), (2, 0, [0.9, 0.1, 0.1], False)], kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = machines.speech_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), idle_ms=2000)
    run = stream.writeStream.format("memory").queryName("speech").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("speech").count() < 2:
            time.sleep(0.5)
        got = sorted(tuple(r) for r in spark.table("speech").collect())
    finally:
        run.stop()
    assert got == [(1, 0, 3, True), (2, 0, 2, False)]

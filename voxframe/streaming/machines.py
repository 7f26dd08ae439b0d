"""State machines over streams of one session each: chunked decoding, speech detection with hysteresis, sessions that end by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Threshold that opens speech; what must fall below the lower one, for so many steps, to close it; steps put around a span.
OPEN, BAND, SILENCE, PAD = 0.5, 0.15, 2, 1


def kept_prefix(heard: str, n: int, warm: int, unfixed: int) -> str:
    """The text so far less its last ``unfixed`` words; nothing during the first ``warm`` chunks."""
    return " ".join(heard.split(" ")[:-unfixed]) if n >= warm else ""


def fold_chunks(state: tuple[str, str, int], piece: str, size: int, warm: int = 2, unfixed: int = 5) -> tuple[tuple[str, str, int], list[tuple[int, int, str]]]:
    """Buffers a piece; each full chunk is decoded with all before it. Gives the new state and (chunk, length so far, prefix)."""
    buffer, heard, n = state
    buffer, out = buffer + piece, []
    while len(buffer) >= size:
        prefix = kept_prefix(heard, n, warm, unfixed)
        heard, buffer = heard + buffer[:size], buffer[size:]
        out.append((n, len(heard), prefix))
        n += 1
    return (buffer, heard, n), out


def flush_chunks(state: tuple[str, str, int], warm: int = 2, unfixed: int = 5) -> list[tuple[int, int, str]]:
    """What a session that ends still holds, decoded as its last chunk; nothing if its buffer is empty."""
    buffer, heard, n = state
    return [(n, len(heard) + len(buffer), kept_prefix(heard, n, warm, unfixed))] if buffer else []


def fold_speech(state: tuple[bool, int, int, int], probabilities: list[float], threshold: float = OPEN, steps: int = SILENCE, least: int = 0, pad: int = 0) -> tuple[tuple[bool, int, int, int], list[tuple[int, int]]]:
    """(speaking, start, possible end, steps so far) and the spans that ended, those of fewer than ``least`` steps left out."""
    speaking, start, end, at = state
    out = []
    for p in probabilities:
        if p >= threshold:
            end = -1
            if not speaking:
                speaking, start = True, at
        elif speaking and p < threshold - BAND:
            if end < 0:
                end = at
            if at - end + 1 >= steps:
                if end - start >= least:
                    out.append((max(0, start - pad), min(end + pad, at + 1)))
                speaking, end = False, -1
        at += 1
    return (speaking, start, end, at), out


def flush_speech(state: tuple[bool, int, int, int], least: int = 0, pad: int = 0) -> list[tuple[int, int]]:
    """The span that is open when a session ends: it ends there."""
    speaking, start, _, at = state
    return [(max(0, start - pad), at)] if speaking and at - start >= least else []


def speech_spans(probabilities: list[float], threshold: float, steps: int, least: int = 0, pad: int = 0) -> list[tuple[int, int]]:
    """All spans of one whole session; padded ones that meet share what lies between them."""
    state, spans = fold_speech((False, 0, -1, 0), probabilities, threshold, steps, least, pad)
    spans += flush_speech(state, least, pad)
    out: list[list[int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1][1] = a = (a + out[-1][1]) // 2
        out.append([a, b])
    return [tuple(x) for x in out]


def _by_session(pieces: DataFrame, column: str, first: tuple, fold, flush, out: str, state: str, idle_ms: int | None) -> DataFrame:
    """Folds each session's pieces in the order of ``ord``; what is left goes out when a piece is marked ``last``, or
    after ``idle_ms`` without one, and the session's state with it. Across micro-batches pieces come in their order."""
    names = [x.split(" ")[0] for x in out.split(", ")]

    def run(key, batches: Iterator[pd.DataFrame], held: GroupState):
        now, made = tuple(held.get) if held.exists else first, []
        ended = held.hasTimedOut
        if not ended:
            rows = pd.concat(list(batches)).sort_values("ord")
            for piece, last in zip(rows[column], rows["last"], strict=True):
                now, more = fold(now, piece)
                made += [(key[0], *m, False) for m in more]
                ended = ended or bool(last)
        if ended:
            made += [(key[0], *m, True) for m in flush(now)]
            if held.exists:
                held.remove()
        else:
            held.update(now)
            if idle_ms:
                held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(made, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return pieces.groupBy("session_id").applyInPandasWithState(run, out, state, "append", timeout)


def chunk_stream(pieces: DataFrame, size: int, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, ord, text, last) to decoded chunks; state is one buffer and text per session."""
    return _by_session(pieces, "text", ("", "", 0), lambda now, x: fold_chunks(now, x or "", size), flush_chunks, "session_id long, chunk int, heard int, prefix string, flushed boolean", "buffer string, heard string, n int", idle_ms)


def speech_stream(frames: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream of (session_id, ord, p array<double>, last) to padded spans of speech."""
    fold = lambda now, p: fold_speech(now, [float(x) for x in p], pad=PAD)
    return _by_session(frames, "p", (False, 0, -1, 0), fold, lambda now: flush_speech(now, pad=PAD), "session_id long, start int, stop int, flushed boolean", "speaking boolean, start int, stop int, at int", idle_ms)


def run_once(spark, stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there, to files and back."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


class Sessions(StatefulProcessor):
    """A session's first and last time and number of events. It ends when it is idle for longer than its time to live:
    lazily, if its user comes back later than that, else by the timer that each access sets anew."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "start long, last long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = pd.concat([r.loc[~r["clock"], "us"] for r in rows]).sort_values().tolist()
        held = self.state.get() if self.state.exists() else None
        ended = []
        for t in times:
            if held and t - held[1] > self.ttl:
                ended.append((key[0], *held))
                held = None
            # what comes late, but within the time to live of a session, belongs to it
            held = (min(held[0], t), max(held[1], t), held[2] + 1) if held else (t, t, 1)
        if held:
            self.state.update(held)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((held[1] + self.ttl) // 1000 + 1)
        if ended:
            yield pd.DataFrame(ended, columns=["user_id", "start", "last", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            yield pd.DataFrame([(key[0], *self.state.get())], columns=["user_id", "start", "last", "n"])
            self.state.clear()

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, ttl_us: int = 600_000_000, late: str = "1 second") -> DataFrame:
    """A stream of (user_id, ts, clock) to ended sessions (user_id, start, last, n), times in microseconds.

    State is one row per live session and goes when the session ends. Time is the stream's own: a row marked ``clock``
    counts for no session and tells the time alone, so that idle sessions end where no one else comes.
    """
    rows = events.withWatermark("ts", late).select("user_id", "ts", "clock", F.unix_micros("ts").alias("us"))
    return rows.groupBy("user_id").transformWithStateInPandas(Sessions(ttl_us), "user_id long, start long, last long, n long", "Append", "EventTime")


def run_slices(spark, slices: list[DataFrame], machine, path: str) -> DataFrame:
    """Runs a stream over slices that come one after another: each is a run of its own that takes up the state of the one
    before from the checkpoint, as after a restart."""
    kind, key = slices[0].schema, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for s in slices:
            s.write.mode("append").parquet(f"{path}/in")
            stream = machine(spark.readStream.schema(kind).parquet(f"{path}/in"))
            stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")

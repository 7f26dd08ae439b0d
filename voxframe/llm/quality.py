"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import as_bytes, bounded_batches, chunks, crc_mod, cut

#: Weights in the model.
BITS = 18
#: Labelled rows that the model is fitted on, at most: those whose ids have the smallest hashes.
FIT_ROWS = 12_000
#: Passes over the fitted rows; they are few because each row brings hundreds of features.
EPOCHS = 4
#: Follow-the-regularised-leader: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.6, 1.0, 0.02, 0.5
#: A document's features weigh this much together.
SCALE = 12.0
#: Words hashed at once when scoring.
SLAB = 300_000
#: Score from which a document counts as good.
THRESHOLD = 0.3

_NOT_MARKS = bytes(b if 33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 else 32 for b in range(256))
_NOT_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


class _Words(dict):
    """Hash of a word; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


def _ngrams(text: bytes, words: _Words) -> list[np.ndarray]:
    """Hashes of a text's words and of its runs of punctuation, in order; case is kept."""
    return [np.array([words[w] for w in text.translate(t).split()], np.uint32) for t in (_NOT_WORDS, _NOT_MARKS)]


def _buckets(runs: list[np.ndarray], bits: int) -> np.ndarray:
    """Buckets of all unigrams and bigrams. A bigram of equal words falls in one bucket whatever the word."""
    mask, out = np.uint32((1 << bits) - 1), []
    for salt, h in zip((0x5BD1E995, 0x2545F491), runs, strict=True):
        if len(h):
            one = h * np.uint32(salt)
            out.append((one ^ (one >> np.uint32(15))) & mask)
        if len(h) > 1:
            two = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (h[1:] * np.uint32(0xC2B2AE35)) ^ np.uint32(salt)
            two = np.where(h[:-1] == h[1:], np.uint32(salt), two)
            out.append((two ^ (two >> np.uint32(13))) & mask)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _features(batches, bits: int):
    words = _Words()
    for batch in batches:
        index, value = [], []
        for text in as_bytes(batch.column("_bytes")):
            b = _buckets(_ngrams(text, words), bits)
            i, n = np.unique(b, return_counts=True)
            index.append(i.astype(np.int32))
            value.append((n * (SCALE / max(1, len(b)))).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("_order"), batch.column("_y"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["_order", "_y", "_index", "_value"])


def ftrl(rows, bits: int, epochs: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights of rows of (indices, values, label), the last weight being the bias, by per-coordinate FTRL-proximal steps."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, v, y in rows:
            i, v = np.append(i, bias), np.append(v, 1.0)
            w = weights(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    return weights(np.arange(len(z))).astype(np.float32)


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out_mod: int = 5, fit_rows: int = FIT_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """The model's weights, learnt from labels whose crc32(doc_id) mod ``held_out_mod`` is not 0.

    A bounded sample is fitted: the ``fit_rows`` labelled ids of smallest md5. Conflicting labels of an id count as the
    larger; null ids or labels are left out. The sample's ids are broadcast (their number is the bound), so no text
    is shuffled but the sample's. One task runs the updates in the order of the hashes. Without labels all weights are 0.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_i"), F.col(label_col).cast("int").alias("_y")).where("_i IS NOT NULL AND _y IS NOT NULL").where(crc_mod("_i", held_out_mod) != 0)
    known = cut(known.groupBy("_i").agg(F.max("_y").alias("_y")).withColumn("_order", F.md5(F.col("_i").cast("string").cast("binary"))))
    # hashes are even, so a share of their range holds the smallest ones: no task gathers more than about twice the sample
    share = min(1.0, 2.0 * fit_rows / max(1, known.count()))
    chosen = known.where(F.substring("_order", 1, 8) <= f"{int(share * 0xFFFFFFFF):08x}").orderBy("_order", "_i").limit(fit_rows)
    rows = docs.select(F.col("doc_id").alias("_d"), F.col("text").cast("binary").alias("_bytes")).join(F.broadcast(chosen), F.col("_d") == F.col("_i"))
    rows = rows.select("_order", "_y", "_bytes").mapInArrow(lambda batches: _features(batches, bits), "_order string, _y int, _index array<int>, _value array<float>")
    rows = rows.withColumn("_tie", F.hash("_index", "_value")).orderBy("_order", "_tie").limit(fit_rows).drop("_tie").repartition(1)

    def train(batches):
        # the sample's features end to end; a row is a view of them
        index, value, sizes, order, label = [], [], [], [], []
        for batch in batches:
            index.append(batch.column("_index").flatten().to_numpy())
            value.append(batch.column("_value").flatten().to_numpy())
            sizes += np.diff(batch.column("_index").offsets.to_numpy()).tolist()
            order += batch.column("_order").to_pylist()
            label += batch.column("_y").to_pylist()
        if order:
            index, value, at = np.concatenate(index), np.concatenate(value), np.concatenate([[0], np.cumsum(sizes)])
            rows = [(index[at[k] : at[k + 1]], value[at[k] : at[k + 1]], min(1, max(0, label[k]))) for k in sorted(range(len(order)), key=lambda k: (order[k], sizes[k]))]
            yield pa.RecordBatch.from_arrays([pa.array([ftrl(rows, bits, epochs).tobytes()], pa.binary())], names=["w"])

    got = rows.mapInArrow(train, "w binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32) if got else np.zeros((1 << bits) + 1, np.float32)


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """All rows of docs in ``row`` with ``score``: the sparse dot product of a whole text's n-grams, through the logistic."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(weights)
    bits = (len(weights) - 1).bit_length() - 1

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        w, words = model.value, _Words()
        texts, scores = as_bytes(column), []
        for lo, hi in chunks([len(t) // 6 + 1 for t in texts], SLAB):
            parts = [_buckets(_ngrams(t, words), bits) for t in texts[lo:hi]]
            n = np.array([len(p) for p in parts])
            sums = np.concatenate([[0.0], np.cumsum(w[np.concatenate(parts)], dtype=np.float64)])
            at = np.concatenate([[0], np.cumsum(n)])
            x = (sums[at[1:]] - sums[at[:-1]]) * SCALE / np.maximum(n, 1) + w[-1]
            scores += (1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))).tolist()
        return pa.array(scores, pa.float64())

    # only the texts go to Python; the other columns wait in the JVM
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(F.col("text").cast("binary")).alias("score"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with the columns of docs.

    Null and empty texts score by the bias alone; repeated rows score alike, so all stay or all go; a score equal to the
    threshold stays; without labels every row scores a half. An empty table gives no rows; columns of any name stay.
    """
    out = score_quality(docs, fit_quality(docs, labels, **options)).where(F.col("score") >= threshold)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The digest of op7: doc_id, held_out, score, predicted.

    Null and empty texts score by the bias alone; repeated rows score alike; empty tables give no rows; columns of
    other names play no part, so neither lang, source, labels nor ids are inputs of a score.
    """
    docs = docs.select("doc_id", "text")
    out = score_quality(docs, fit_quality(docs, labels))
    return out.select("row.doc_id", (crc_mod(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

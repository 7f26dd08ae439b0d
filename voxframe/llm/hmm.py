"""LM scoring by a hidden Markov model over words.

Latent states emit symbols: the most frequent words, one by one, and classes of the others by their last bytes; within a
class a word comes with its add-one share. The tables that executors hold are bounded whatever the vocabulary; counts
of rarer words are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from voxframe.llm.common import as_bytes, bounded_batches, crc_mod, discard, exactly_most_frequent, materialise, new_path, stored

#: Latent states, passes of Baum-Welch over all training texts.
STATES, PASSES = 6, 3
#: Of words that are symbols of their own, and of classes of the others (powers of two): one for so many words of the
#: vocabulary, at least, and at most so that the tables are bounded. Words whose counts executors hold (a bound).
PER, LEAST_HEAD, LEAST_CLASSES, HEAD, CLASSES, HELD = 8, 8_192, 1_024, 65_536, 8_192, 150_000
#: Tokens that go through the recursions together; words counted before they are sent on.
SLAB, FLUSH = 200_000, 400_000
#: Expected counts are summed as whole multiples of this part, so sums don't depend on their order and reruns agree.
GRAIN = 1 << 16
#: The end of a text: no word holds white space.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def word_class(word: bytes, classes: int = CLASSES) -> int:
    return zlib.crc32(word[-3:]) % classes


def symbols_for(v: int) -> tuple[int, int]:
    """Words that are symbols of their own, and classes of the others, for a vocabulary of so many words."""
    return min(max(v // PER, LEAST_HEAD), HEAD), min(max(1 << (v // PER).bit_length() >> 1, LEAST_CLASSES), CLASSES)


def word_counts(train: DataFrame) -> DataFrame:
    """(w, k, n): each token of the training texts, its class and count; summed per task before the shuffle."""

    def run(batches):
        seen: Counter = Counter()

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([word_class(w) for w in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["w", "k", "n"])

        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen.update(tokens(text))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield told()
                    seen.clear()
        yield told()

    rows = train.select(F.col("text").cast("binary").alias("_bytes")).mapInArrow(run, "w binary, k int, n long")
    return materialise(rows.groupBy("w").agg(F.first("k").alias("k"), F.sum("n").alias("n")), "words")


class Model:
    """What executors need to encode and score: symbols, held counts, class totals, and the latent chain."""

    def __init__(self, head: list[bytes], held: dict[bytes, int], n: int, v: int, class_n: np.ndarray, class_v: np.ndarray, symbol_n: np.ndarray, states: int = STATES):
        self.head, self.held, self.n, self.v = {w: i for i, w in enumerate(head)}, held, n, v
        self.classes = len(class_n)
        self.inner = -np.log10(class_n + class_v + 1.0)
        self.prior = (symbol_n + 1.0) / (symbol_n + 1.0).sum()
        draw = np.random.default_rng(7)
        emit = self.prior * np.exp(0.5 * draw.standard_normal((states, len(self.prior))))
        self.emit = (emit / emit.sum(1, keepdims=True)).T.copy()
        self.step = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * (0.95 - 0.05 / max(1, states - 1))
        self.step /= self.step.sum(1, keepdims=True)
        self.first = np.full(states, 1.0 / states)

    def symbol(self):
        head, classes = self.head, self.classes
        size = len(head)

        class Symbols(dict):
            def __missing__(self, w):
                if len(self) > 300_000:
                    self.clear()
                    self.update(head)
                s = self[w] = size + word_class(w, classes)
                return s

        return Symbols(head)

    def update(self, emit: np.ndarray, step: np.ndarray, first: np.ndarray) -> None:
        """The next model from expected counts, smoothed by the symbols' overall shares."""
        emit = emit + 200.0 * self.prior[:, None]
        self.emit = emit / emit.sum(0, keepdims=True)
        self.step = (step + 1.0) / (step + 1.0).sum(1, keepdims=True)
        self.first = (first + 1.0) / (first + 1.0).sum()


def _slabs(encoded):
    """Texts (tag, symbols) gathered by length, so that those that run together end at about the same step."""
    open_: dict[int, list] = {}
    room: Counter = Counter()
    for tag, ids in encoded:
        b = len(ids).bit_length()
        open_.setdefault(b, []).append((tag, ids))
        room[b] += len(ids)
        if room[b] >= SLAB:
            yield open_.pop(b)
            room[b] = 0
    if open_:
        yield [x for slab in open_.values() for x in slab]


class Packed:
    """Texts side by side, longest first, and their tokens step by step: those of step t are a slice of ``running[t]``."""

    def __init__(self, slab):
        self.slab = sorted(slab, key=lambda x: -len(x[1]))
        self.lengths = np.array([len(x[1]) for x in self.slab])
        self.running = np.searchsorted(-self.lengths, -np.arange(self.lengths[0]), "left")
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        self.ids = np.empty(self.at[-1], np.int32)
        for j, (_, ids) in enumerate(self.slab):
            self.ids[self.at[: len(ids)] + j] = ids
        self.text = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.running)


def forward(model: Model, packed: Packed, kind=np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward recursion: emissions, filtered states and scales of all tokens."""
    emit, step = model.emit.astype(kind)[packed.ids], model.step.astype(kind)
    alpha, scale = np.empty_like(emit), np.empty(len(emit), kind)
    ones = np.ones(emit.shape[1], kind)
    at = packed.at.tolist()
    for t, k in enumerate(packed.running.tolist()):
        lo, hi = at[t], at[t] + k
        now = alpha[lo:hi]
        if t:
            np.matmul(alpha[at[t - 1] : at[t - 1] + k], step, out=now)
            now *= emit[lo:hi]
        else:
            np.multiply(emit[lo:hi], model.first.astype(kind), out=now)
        np.matmul(now, ones, out=scale[lo:hi])
        now /= scale[lo:hi, None]
    return emit, alpha, scale


def log10_likelihoods(model: Model, packed: Packed) -> np.ndarray:
    """Of each text, longest first: log10 of the sum over all state paths of its symbols' probability."""
    return np.bincount(packed.text, np.log10(forward(model, packed)[2]), len(packed.slab))


def expected(model: Model, slab, kind=np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of (symbol, state), (state, next state) and first state over a slab of texts."""
    packed = Packed(slab)
    emit, alpha, scale = forward(model, packed, kind)
    back = np.ascontiguousarray(model.step.T.astype(kind))
    beta = np.ones_like(alpha)
    emit /= scale[:, None]
    at, running = packed.at.tolist(), packed.running.tolist()
    for t in range(len(running) - 1, 0, -1):
        lo, hi = at[t], at[t + 1]
        emit[lo:hi] *= beta[lo:hi]
        np.matmul(emit[lo:hi], back, out=beta[at[t - 1] : at[t - 1] + running[t]])
    # a token's predecessor stands as many places before it as texts were running then
    second = at[1] if len(at) > 1 else len(alpha)
    before = np.arange(second, len(alpha)) - np.repeat(packed.running[:-1], packed.running[1:])
    trans = alpha[before].T.astype(np.float64) @ emit[second:].astype(np.float64)
    gamma = np.ascontiguousarray((alpha * beta).T)
    out = np.stack([np.bincount(packed.ids, g, len(model.prior)) for g in gamma], 1)
    return out, trans * model.step, gamma[:, : running[0]].sum(1, dtype=np.float64)


def encode(train: DataFrame, model: Model, path: str) -> DataFrame:
    """The training texts as symbols, 32 bits each, stored once for all passes of Baum-Welch."""
    sent = train.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        symbols = sent.value.symbol()
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(0)):
                words = [*tokens(text), END]
                out.append(np.fromiter(map(symbols.__getitem__, words), np.int32, len(words)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    return stored(train.select(F.col("text").cast("binary").alias("_bytes")).mapInArrow(run, "ids binary"), path)


def baum_welch(encoded: DataFrame, model: Model) -> None:
    """One pass over all training texts: each task sums its expected counts, which a shuffle sums by symbol."""
    sent = encoded.sparkSession.sparkContext.broadcast(model)
    states, size = len(model.first), len(model.prior)

    def run(batches):
        m = sent.value
        total = [np.zeros((size, states)), np.zeros((states, states)), np.zeros(states)]
        texts = ((None, np.frombuffer(x, np.int32)) for batch in batches for x in as_bytes(batch.column(0)))
        for slab in _slabs(texts):
            for t, x in zip(total, expected(m, slab), strict=True):
                t += x
        rows = np.rint(np.concatenate([total[0], total[1], total[2][None, :]]) * GRAIN).astype(np.int64)
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(rows[at, s]) for s in range(states)]], names=["a", *[f"s{s}" for s in range(states)]])

    rows = encoded.mapInArrow(run, "a int, " + ", ".join(f"s{s} long" for s in range(states)))
    got = rows.groupBy("a").agg(*[F.sum(f"s{s}") for s in range(states)]).collect()
    sums = np.zeros((size + states + 1, states))
    for r in got:
        sums[r[0]] = np.array(r[1:], float) / GRAIN
    model.update(sums[:size], sums[size:-1], sums[-1])


def train_model(train: DataFrame, passes: int = PASSES, states: int = STATES, head: int | None = None, held: int = HELD) -> tuple[Model, DataFrame]:
    """The model, and the table of all counts. The driver gets the ``held`` most frequent words and one sum per class.

    ``head`` words are symbols of their own; where it is None their number follows the vocabulary, as that of classes does.
    """
    counts = word_counts(train)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most, classes = symbols_for(v)
    head = most if head is None else head
    top = [(bytes(r[0]), r[1], r[2]) for r in exactly_most_frequent(counts, "n", "w", max(held, head)).collect()]
    top.sort(key=lambda x: (-x[2], x[0]))
    symbols = [END, *[w for w, _, _ in top if w != END][: head - 1]]
    taken = set(symbols)
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for k, a, b in counts.groupBy((F.col("k") % classes).alias("k")).agg(F.sum("n"), F.count("*")).collect():
        class_n[k], class_v[k] = a, b
    known = {w: c for w, _, c in top}
    for w in taken & known.keys():
        class_n[word_class(w, classes)] -= known[w]
        class_v[word_class(w, classes)] -= 1
    symbol_n = np.concatenate([[known.get(w, 0) for w in symbols], class_n])
    model = Model(symbols, known, n, v, class_n, class_v, symbol_n, states)
    if n and passes:
        path = new_path(train.sparkSession, "symbols")
        encoded = encode(train, model, path)
        for _ in range(passes):
            baum_welch(encoded, model)
        discard(train.sparkSession, path)
    return model, counts


def _scored(sent, kind: pa.DataType):
    """Rows of a text: one with what is known here, and one for each word whose count is not held."""

    def run(batches):
        m = sent.value
        symbols = m.symbol()
        less = -np.log10(m.n + m.v + 1.0)
        inner = np.concatenate([np.zeros(len(m.head)), m.inner])
        # places of held words: their symbol, and what their count adds to the base and, within a class, to the score
        place = {w: i for i, w in enumerate(m.held)}
        symbol_of = np.array([symbols[w] for w in m.held] + [0], np.int32)
        log_of = np.append(np.log10(np.array(list(m.held.values()), float) + 1.0), 0.0)
        tail_of = np.append([0.0 if w in m.head else x for w, x in zip(m.held, log_of, strict=False)], 0.0)
        get = place.get

        def texts():
            for batch in batches:
                for r, d, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), as_bytes(batch.column("_bytes")), strict=True):
                    words = [*tokens(text), END]
                    at = np.array([get(w, -1) for w in words], np.int32)
                    ids, absent = symbol_of[at], np.flatnonzero(at < 0).tolist()
                    if absent:
                        ids[absent] = [symbols[words[i]] for i in absent]
                    rare = Counter([words[i] for i in absent])
                    yield (r, d, float(log_of[at].sum()) + len(words) * less, float(tail_of[at].sum()), len(words) - len(absent), rare), ids

        for slab in _slabs(texts()):
            packed = Packed(slab)
            slab, lengths, logp = packed.slab, packed.lengths, log10_likelihoods(m, packed)
            rows = []
            for (tag, ids), n, lp in zip(slab, lengths.tolist(), logp.tolist(), strict=True):
                r, d, base, tail, known, rare = tag
                rows.append((r, d, END + str(r).encode(), 0, lp + float(inner[ids].sum()) + tail, base, known, n))
                rows += [(r, None, w, c, 0.0, 0.0, 0, 0) for w, c in rare.items()]
            kinds = [pa.int64(), kind, pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "doc_id", "w", "n", "score", "base", "known", "size"])

    return run


def score_texts(docs: DataFrame, held_out_mod: int = 7, held_out: int = 2, passes: int = PASSES, states: int = STATES, head: int | None = None, held: int = HELD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each whole text.

    The model learns from rows whose crc32(doc_id as text) mod ``held_out_mod`` is not ``held_out``. Its score is exact:
    log10 of the sum over all state paths, rounded like the base to 9 places; reruns agree. Null text is empty (one end token); a null doc_id is the text 'null'; rows
    that repeat are scored alike; an empty table gives no rows; other columns play no part. Memory in training is
    bound by a slab of texts and by the longest one. Counts of words that executors don't hold come by a join; each
    text brings a row of its own there, whose word is no other's, so no key is common to many texts.
    """
    bounded_batches(docs.sparkSession)
    is_held = crc_mod("doc_id", held_out_mod) == held_out
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    model, counts = train_model(docs.where(~is_held), passes, states, head, held)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("binary").alias("_bytes"))
    of = docs.schema["doc_id"].dataType
    scored = rows.mapInArrow(_scored(sent, to_arrow_type(of)), f"row long, doc_id {of.simpleString()}, w binary, n long, score double, base double, known long, size long")
    scored = scored.join(counts.select(F.col("w").alias("_w"), F.col("n").alias("c")), F.col("w") == F.col("_w"), "left")
    more = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    out = scored.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("size").alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.round(F.sum(F.col("base") + more), 9).alias("base_score"), F.round(F.sum(F.col("score") + more), 9).alias("score"))
    return out.select("doc_id", is_held.alias("held_out"), "n_tokens", "n_known", F.lit(int(model.n)).cast("long").alias("train_tokens"), "base_score", "score")

"""Frames of symbol scores in one flat array, as Column expressions: an array of frames, each an array of log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_softmax(frame: Column) -> Column:
    top = F.array_max(frame)
    return F.transform(frame, lambda x: x - top - F.log(total(F.transform(frame, lambda y: F.exp(y - top)))))


def frames(flat: Column, symbols: int, scale: float = 1.0, shift: int = 0) -> Column:
    """Log-probabilities of a flat array, scaled, and turned to the right by ``shift`` places."""
    n = F.size(flat)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(flat, F.pmod(i - shift, n)).cast("double") * scale)
    cut = F.transform(F.sequence(F.lit(0), F.floor(n / symbols).cast("int") - 1), lambda t: F.slice(turned, t * symbols + 1, F.lit(symbols)))
    return F.transform(cut, log_softmax)


def greedy(scores: Column, blank: int = 0) -> Column:
    """The best symbol of each frame (the first of ties); repeats collapse, then blanks go."""
    best = F.transform(scores, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))
    return F.filter(F.filter(best, lambda x, i: (i == 0) | (F.get(best, i - 1) != x)), lambda x: x != blank)


def fused(lattices: list[Column], how: str, weights: list[float] | None = None) -> Column:
    """Scores of several lattices cut to the fewest frames: the mean of log-probabilities, their maximum, or the mean of probabilities."""
    weights = weights or [1.0 / len(lattices)] * len(lattices)
    n = F.least(*[F.size(x) for x in lattices])

    def cell(t: Column, s: Column) -> Column:
        at = [F.get(F.get(x, t), s) for x in lattices]
        if how == "max":
            return F.greatest(*at)
        out = None
        for w, x in zip(weights, at, strict=True):
            part = w * (F.exp(x) if how == "logmeanexp" else x)
            out = part if out is None else out + part
        return out

    return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.transform(F.sequence(F.lit(0), F.size(F.get(lattices[0], t)) - 1), lambda s: cell(t, s)))


def scaled_blank(frame: Column, scale: float, blank: int = 0) -> Column:
    """A frame's probability of the blank after it is scaled and all are brought to one again."""
    p = F.exp(F.get(frame, F.lit(blank)))
    return p * scale / (1.0 - p + p * scale)


def entropy(frame: Column) -> Column:
    return -total(F.transform(frame, lambda x: F.exp(x) * F.log(F.exp(x) + 1e-12)))

"""Sequence kernels that columns can't express: plain functions on one row or group, and how they run in Arrow batches."""

from __future__ import annotations

import bisect
import math
import os
import re
import unicodedata
from collections import Counter

import numpy as np

INF = float("inf")

# ---- texts


def nfc(s: str) -> str:
    return unicodedata.normalize("NFC", s)


def fix_repetitions(s: str, least: int = 20, longest: int = 20) -> str:
    """Runs of more than ``least`` equal characters to one; then patterns repeated at least so often to one.

    At each place the shortest pattern wins; what follows a found run is treated the same way.
    """
    s = re.sub(r"(.)\1{%d,}" % least, r"\1", s, flags=re.S)
    out, at = [], 0
    while len(s) - at >= 2 * least:
        for k in range(1, longest + 1):
            unit = s[at : at + k]
            if len(s) - at < k * least:
                continue
            n = 1
            while s.startswith(unit, at + n * k):
                n += 1
            if n >= least:
                out.append(unit)
                at += n * k
                break
        else:
            out.append(s[at])
            at += 1
    return "".join(out) + s[at:]


# ---- alignment


def distance_table(ref, hyp) -> np.ndarray:
    """All distances of prefixes. A row follows from the one above at once: insertions are a running minimum."""
    if len(ref) * len(hyp) < 200:  # short ones are quicker cell by cell
        rows = [list(range(len(hyp) + 1))]
        for i, x in enumerate(ref, 1):
            up, row = rows[-1], [i]
            for j, y in enumerate(hyp):
                row.append(min(up[j] + (x != y), up[j + 1] + 1, row[j] + 1))
            rows.append(row)
        return np.array(rows, np.int32)
    codes: dict = {}
    r = [codes.setdefault(x, len(codes)) for x in ref]
    h = np.array([codes.setdefault(x, len(codes)) for x in hyp], np.int64)
    steps = np.arange(len(h) + 1)
    table = np.empty((len(r) + 1, len(h) + 1), np.int32)
    table[0] = steps
    for i, x in enumerate(r, 1):
        up = table[i - 1]
        row = up + 1
        np.minimum(row[1:], up[:-1] + (h != x), out=row[1:])
        table[i] = np.minimum.accumulate(row - steps) + steps
    return table


def distance(a: str, b: str) -> int:
    """Levenshtein distance in code points: a column of the table is two numbers of as many bits as the longer has letters."""
    if len(a) < len(b):
        a, b = b, a
    lo, end = 0, len(b)
    while lo < end and a[lo] == b[lo]:
        lo += 1
    while end > lo and a[end - len(b) - 1] == b[end - 1]:
        end -= 1
    a, b = a[lo : len(a) - len(b) + end], b[lo:end]
    m = len(a)
    if not b:
        return m
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    # where a step down the column adds one, and where it takes one
    up, down, score = full, 0, m
    for c in b:
        same = at.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        plus, minus = down | (full & ~(h | up)), up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full | 1, minus << 1 & full
        up, down = minus | (full & ~(v | plus)), plus & v
    return score


def distances(text: str, others: list[str]) -> list[int]:
    """Levenshtein distances of a text to others, in one walk over it: their columns stand side by side in two numbers,
    each with a bit above it that no carry passes."""
    at: dict[str, int] = {}
    full = ones = place = 0
    for o in others:
        for i, c in enumerate(o, place):
            at[c] = at.get(c, 0) | 1 << i
        if o:
            full, ones = full | ((1 << len(o)) - 1) << place, ones | 1 << place
        place += len(o) + 1
    up, down = full, 0
    for c in text:
        same = at.get(c, 0)
        # where a cell costs what the one before it on the diagonal does
        level = ((((same & up) + up) ^ up) | same | down) & full
        plus = (down | full ^ (level | up)) << 1 | ones
        up, down = ((level & up) << 1 | full ^ (level | plus)) & full, level & plus
    out, place = [], 0
    for o in others:
        own = (1 << len(o)) - 1
        out.append(len(text) + (up >> place & own).bit_count() - (down >> place & own).bit_count())
        place += len(o) + 1
    return out


def below_diagonal(texts: list[str]) -> list[list[int]]:
    """Distances of each text to those before it; ends that all of them share cost nothing."""
    if len(texts) < 2:
        return [[] for _ in texts]
    head = len(os.path.commonprefix(texts))
    rest = [x[head:] for x in texts]
    tail = len(os.path.commonprefix([x[::-1] for x in rest]))
    rest = [x[: len(x) - tail] for x in rest]
    return [distances(x, rest[:i]) for i, x in enumerate(rest)]


#: Steps of an alignment: both sides, the reference alone, the hypothesis alone.
BOTH, REF, HYP = 0, 1, 2


def edit_path(ref, hyp) -> list[int]:
    """Steps of one cheapest alignment; seen from the end, both sides go before the reference alone, that before the other.

    Equal ends are aligned so by that rule, and need no table. A column of the table is two numbers of as many bits as the
    reference has symbols; what stays of it is two bits a cell: whether one side goes alone, and whether that is the reference.
    """
    n, m = len(ref), len(hyp)
    while n and m and ref[n - 1] == hyp[m - 1]:
        n, m = n - 1, m - 1
    tail = [BOTH] * (len(ref) - n)
    if not n or not m:
        return [REF] * n + [HYP] * m + tail
    at: dict = {}
    for i in range(n):
        at[ref[i]] = at.get(ref[i], 0) | 1 << i
    full = (1 << n) - 1
    # where a step down the column adds one, and where it takes one
    up, down = full, 0
    alone, of_ref = [], []
    for j in range(m):
        same = at.get(hyp[j], 0)
        # where a cell costs what the one before it on the diagonal does
        level = ((((same & up) + up) ^ up) | same | down) & full
        plus, minus = (down | (full ^ (level | up))) << 1 | 1, (level & up) << 1
        up, down = (minus | (full ^ (full & (level | plus)))) & full, level & plus
        alone.append(level ^ same)
        of_ref.append(alone[-1] & up)
    out = []
    while n and m:
        if not alone[m - 1] >> (n - 1) & 1:
            out.append(BOTH)
            n, m = n - 1, m - 1
        elif of_ref[m - 1] >> (n - 1) & 1:
            out.append(REF)
            n -= 1
        else:
            out.append(HYP)
            m -= 1
    return [REF] * n + [HYP] * m + out[::-1] + tail


def path_cost(ref, hyp, path: list[int]) -> int:
    cost = i = j = 0
    for step in path:
        cost += step != BOTH or ref[i] != hyp[j]
        i, j = i + (step != HYP), j + (step != REF)
    return cost


def edit_ops(ref, hyp) -> list[tuple[str, str, str]]:
    """(op, ref, hyp) along one cheapest path; from the end, a match is taken before sub, sub before del, del before ins."""
    out, i, j = [], 0, 0
    for step in edit_path(ref, hyp):
        if step == BOTH:
            out.append(("match" if ref[i] == hyp[j] else "sub", ref[i], hyp[j]))
        else:
            out.append(("del", ref[i], "") if step == REF else ("ins", "", hyp[j]))
        i, j = i + (step != HYP), j + (step != REF)
    return out


def edit_pairs(ref, hyp) -> list[tuple[str, str]]:
    """Aligned symbols of what differs, with marks for what one side lacks."""
    out, i, j = [], 0, 0
    for step in edit_path(ref, hyp):
        if step == BOTH:
            if ref[i] != hyp[j]:
                out.append((ref[i], hyp[j]))
        else:
            out.append((ref[i], "[DEL]") if step == REF else ("[INS]", hyp[j]))
        i, j = i + (step != HYP), j + (step != REF)
    return out


# ---- voting over aligned hypotheses


def rover_progressive(hyps: list[str]) -> str:
    """Columns of votes grown in input order: each hypothesis is aligned to the columns' leading symbols.

    A column leads by most votes, the larger code point of ties; hypotheses without a symbol there vote for a gap. A
    symbol stays if it has more votes than the gap.
    """
    if len(set(hyps)) <= 1:
        return hyps[0] if hyps else ""
    columns = [{c: 1} for c in hyps[0]]
    leaders = list(hyps[0])
    for k, hyp in enumerate(hyps[1:], 1):
        grown, heads, i, j = [], [], 0, 0
        for step in edit_path(leaders, hyp):
            if step == HYP:
                grown.append({hyp[j]: 1, "": k})
                heads.append(hyp[j])
            else:
                votes, head = columns[i], leaders[i]
                one = hyp[j] if step == BOTH else ""
                votes[one] = votes.get(one, 0) + 1
                # only the symbol that gained can overtake
                grown.append(votes)
                heads.append(one if one and (votes[one], one) > (votes[head], head) else head)
            i, j = i + (step != HYP), j + (step != REF)
        columns, leaders = grown, heads
    return "".join(c for c, votes in zip(leaders, columns, strict=True) if votes[c] > votes.get("", 0))


def rover_medoid(hyps: list[str], weights: list[float] | None = None, medoid: int | None = None) -> str:
    """Votes on the hypothesis nearest to all others (the first of ties; ``medoid`` where it is known).

    A symbol stays if it has no less weight than its deletion, the first voted for of ties; what others insert needs
    more than half of all weight. Where the nearest is empty, the commonest hypothesis is the answer.
    """
    if len(set(hyps)) <= 1:
        return hyps[0] if hyps else ""
    weights = weights or [1.0] * len(hyps)
    paths: dict[str, list[int]] = {}
    if medoid is None:
        # the first is often the nearest: its distances are told by its paths, which are then needed
        texts = list(dict.fromkeys(hyps))
        paths = {t: edit_path(texts[0], t) for t in texts[1:]}
        apart = {(texts[0], t): path_cost(texts[0], t, path) for t, path in paths.items()}
        for i, x in enumerate(texts[1:], 1):
            apart |= {(x, y): n for y, n in zip(texts[i + 1 :], distances(x, texts[i + 1 :]), strict=True)}
        far = [sum(0 if h == o else apart.get((h, o)) or apart[o, h] for o in hyps) for h in hyps]
        medoid = far.index(min(far))
        paths = paths if medoid == 0 else {}
    base = hyps[medoid]
    if not base:
        return Counter(hyps).most_common(1)[0][0]
    kept: list[dict[str, float]] = [{} for _ in base]
    lost = [0.0] * len(base)
    put: list[dict[str, float]] = [{} for _ in range(len(base) + 1)]
    for hyp, w in zip(hyps, weights, strict=True):
        if hyp not in paths:
            paths[hyp] = edit_path(base, hyp)
        i = j = 0
        run = ""
        for step in [*paths[hyp], None]:
            if step == HYP:
                run, j = run + hyp[j], j + 1
                continue
            if run:
                put[i][run] = put[i].get(run, 0.0) + w
                run = ""
            if step == BOTH:
                kept[i][hyp[j]] = kept[i].get(hyp[j], 0.0) + w
                j += 1
            elif step == REF:
                lost[i] += w
            i += 1
    half, out = sum(weights) / 2, []
    for i in range(len(base) + 1):
        out += [run for run, w in put[i].items() if w > half]
        if i < len(base):
            symbol = max(kept[i], key=kept[i].get)
            if kept[i][symbol] >= lost[i]:
                out.append(symbol)
    return "".join(out)


# ---- lattices: rows are frames, columns log-probabilities, blank first


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    top = x.max(-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(-1, keepdims=True))


def greedy(logp: np.ndarray, blank: int = 0) -> list[int]:
    best = np.asarray(logp).argmax(-1)
    return [int(x) for i, x in enumerate(best) if x != blank and (i == 0 or best[i - 1] != x)]


class Automaton:
    """A back-off language model as states: the contexts it knows. A step falls through shorter contexts, whose weights
    add up, to the first that tells the symbol, and leads to the longest known context that ends what was said.

    Its size is the model's; what a step finds is kept, so a symbol is looked up once from each state.
    """

    def __init__(self, grams, weights, order: int, floor: float = -20.0):
        self.grams, self.weights = {(c, w): p for c, w, p in grams}, dict(weights)
        self.known = {c for c, _ in self.grams} | set(self.weights)
        self.order, self.floor = order, floor
        self.steps: dict[tuple[str, str], tuple[float, str]] = {}

    def state(self, words: list[str]) -> str:
        words = words[-(self.order - 1) :] if self.order > 1 else []
        return next((c for k in range(len(words)) if (c := " ".join(words[k:])) in self.known), "")

    def step(self, state: str, symbol: str) -> tuple[float, str]:
        found = self.steps.get((state, symbol))
        if found is None:
            given, at, p = 0.0, state, self.floor
            while True:
                if (at, symbol) in self.grams:
                    p = given + self.grams[at, symbol]
                    break
                if not at:
                    break
                given += self.weights.get(at, 0.0)
                at = at.split(" ", 1)[1] if " " in at else ""
            found = self.steps[state, symbol] = (p, self.state([*state.split(" "), symbol] if state else [symbol]))
        return found


def beam(logp: np.ndarray, width: int = 10, blank: int = 0, nbest: int = 1, lm: Automaton | None = None, weight: float = 0.0, symbols: list[str] | None = None) -> list[tuple[list[int], float]]:
    """Prefix beam search: the likeliest label sequences with their scores, best first. Ties go to the smaller sequence.

    A prefix's score is its log-probability over all its paths, and ``weight`` times the model's for its ``symbols``,
    from the beginning of a sentence: each beam carries the model's sum and state, so that growing by a symbol is one step.
    """
    said: dict[tuple, tuple[float, str]] = {(): (0.0, lm.state(["<s>"]) if lm else "")}
    beams = {(): (0.0, -INF)}
    for frame in np.asarray(logp, float):
        grown: dict[tuple, list[float]] = {}

        def add(prefix, slot, p, grown=grown):
            old = grown.setdefault(prefix, [-INF, -INF])
            old[slot] = np.logaddexp(old[slot], p)

        for prefix, (end, on) in beams.items():
            both = np.logaddexp(end, on)
            add(prefix, 0, both + frame[blank])
            for s, p in enumerate(frame):
                if s == blank or p == -INF:
                    continue
                longer = (*prefix, s)
                if lm and longer not in said:
                    total, state = said[prefix]
                    more, state = lm.step(state, symbols[s])
                    said[longer] = (total + more, state)
                if prefix and prefix[-1] == s:
                    add(prefix, 1, on + p)
                    add(longer, 1, end + p)
                else:
                    add(longer, 1, both + p)
        score = lambda x: np.logaddexp(*x[1]) + (weight * said[x[0]][0] if lm else 0.0)
        ranked = sorted(grown.items(), key=lambda x: (-score(x), x[0]))[:width]
        beams = {k: tuple(v) for k, v in ranked}
        said = {k: said[k] for k in beams} if lm else said
    return [(list(k), float(np.logaddexp(*v) + (weight * said[k][0] if lm else 0.0))) for k, v in list(beams.items())[:nbest]]


def force_score(logp: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Log-probability of a label sequence summed over all its paths; minus infinity if it can't fit the frames."""
    logp = np.asarray(logp, float)
    states = [blank] + [x for s in labels for x in (s, blank)]
    a = np.full(len(states), -INF)
    if not len(logp):
        return 0.0 if not labels else -INF
    a[:2] = logp[0, states[:2]]
    skip = np.array([k >= 2 and states[k] != blank and states[k] != states[k - 2] for k in range(len(states))])
    for frame in logp[1:]:
        one = np.concatenate([[-INF], a[:-1]])
        two = np.where(skip, np.concatenate([[-INF, -INF], a[:-2]])[: len(a)], -INF)
        a = np.logaddexp(np.logaddexp(a, one), two) + frame[states]
    return float(np.logaddexp.reduce(a[-2:]))


def force_align(logp: np.ndarray, labels: list[int], blank: int = 0) -> dict:
    """Best path of a label sequence: per label mean probability, frames and span, and the share of blank frames.

    All labels of a frame are stepped at once; staying goes before one step, that before two.
    """
    logp = np.asarray(logp, float)
    states = np.array([blank] + [x for s in labels for x in (s, blank)])
    t_all, k_all = len(logp), len(states)
    lost = {"confidence": [], "frames": [], "spans": [], "blank_ratio": 1.0}
    if not t_all:
        return lost
    came = np.zeros((t_all, k_all), np.uint8)
    score = np.full(k_all, -INF)
    score[:2] = logp[0, states[:2]]
    skip = np.zeros(k_all, bool)
    skip[2:] = (states[2:] != blank) & (states[2:] != states[:-2])
    for t in range(1, t_all):
        one = np.concatenate([[-INF], score[:-1]])
        two = np.where(skip, np.concatenate([[-INF, -INF], score[:-2]])[:k_all], -INF)
        step = np.where(one > score, 1, 0)
        best = np.maximum(score, one)
        came[t] = np.where(two > best, 2, step)
        score = np.maximum(best, two) + logp[t, states]
    k = max(range(max(0, k_all - 2), k_all), key=lambda x: score[x])
    if score[k] == -INF:
        return lost
    path = [k]
    for t in range(t_all - 1, 0, -1):
        k -= int(came[t, k])
        path.append(k)
    path.reverse()
    at = np.array(path)
    first, last = np.searchsorted(at, np.arange(1, k_all, 2)), np.searchsorted(at, np.arange(1, k_all, 2), "right")
    seen = np.exp(logp[np.arange(t_all), states[at]])
    return {"confidence": [float(seen[a:b].mean()) for a, b in zip(first, last, strict=True)], "frames": (last - first).tolist(), "spans": list(zip(first.tolist(), last.tolist(), strict=True)), "blank_ratio": float((at % 2 == 0).mean())}


def duration_features(frames: list[int], confidence: list[float]) -> dict:
    """Run lengths of labels along a best path, and how sure they are; zeros (and -30) where there is no label."""
    if not frames:
        return {"conf_mean": -30.0, "conf_min": -30.0, "conf_max": -30.0, "conf_std": 0.0, "dur_mean": 0.0, "dur_std": 0.0, "dur_min": 0.0, "dur_max": 0.0, "dur_z_max": 0.0, "single": 0.0}
    c, d = np.array(confidence), np.array(frames, float)
    return {"conf_mean": c.mean(), "conf_min": c.min(), "conf_max": c.max(), "conf_std": c.std(), "dur_mean": d.mean(), "dur_std": d.std(), "dur_min": d.min(), "dur_max": d.max(), "dur_z_max": (np.abs(d - d.mean()) / max(d.std(), 1e-8)).max(), "single": (d <= 1).mean()}


# ---- timestamps, segments, chunks


def steady(times: list[int]) -> np.ndarray:
    """Places of a longest non-decreasing subsequence: of several, the one that ends first and goes back to first members.

    Members that end runs of the same length stand in falling order of time, so a binary search finds the first that a
    longer run may go on from.
    """
    ends: list[list[int]] = []
    falling: list[list[int]] = []
    before = [-1] * len(times)
    least: list[int] = []
    for i, t in enumerate(times):
        n = bisect.bisect_right(least, t)
        if n:
            before[i] = ends[n - 1][bisect.bisect_left(falling[n - 1], -t)]
        if n == len(ends):
            ends.append([])
            falling.append([])
            least.append(t)
        ends[n].append(i)
        falling[n].append(-t)
        least[n] = t
    out, i = [], ends[-1][0] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], int)


def fix_timestamps(times: list[int]) -> list[int]:
    """Non-decreasing times: a longest non-decreasing subsequence stays; up to two others in a row take the nearer
    neighbour's time (the left of ties), more are spread evenly between both. At an end they take the one neighbour's."""
    t = np.array(times, float)
    good = steady(times)
    if len(good) == len(t):
        return list(times)
    bad = np.setdiff1d(np.arange(len(t)), good)
    # of each other place: the good ones around it, -1 and n where there is none
    k = np.searchsorted(good, bad)
    edges = np.concatenate([[-1], good, [len(t)]])
    left, right = edges[k], edges[k + 1]
    low, high = t[np.where(left < 0, right, left)], t[np.where(right == len(t), left, right)]
    run, place = right - left - 1, bad - left
    spread = low + (high - low) / (run + 1) * place
    nearer = np.where(place <= right - bad, low, high)
    t[bad] = np.where(run <= 2, nearer, spread)
    return [int(x) for x in t]


def segment_words(words: list[tuple[float, float]], longest: float) -> list[tuple[int, int]]:
    """Ranges of words of at most ``longest`` seconds: each is cut at the largest gap (the first of ties) that fits."""
    out, at = [], 0
    while at < len(words):
        stop = at + 1
        while stop < len(words) and words[stop][0] + words[stop][1] - words[at][0] <= longest:
            stop += 1
        if stop < len(words):
            gaps = [words[k][0] - (words[k - 1][0] + words[k - 1][1]) for k in range(at + 1, stop + 1)]
            stop = at + 1 + gaps.index(max(gaps)) if gaps else stop
        out.append((at, stop))
        at = stop
    return out


def chunk_low_energy(wave: np.ndarray, rate: int, longest: float, around: float = 5.0, window: float = 0.1, least: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, stop, samples with padding) of ranges that cover the wave without loss.

    A range longer than ``longest`` seconds ends at the faintest sample of the quietest window within ``around`` seconds
    of that. The windows' levels are differences of one running sum. Ranges under ``least`` seconds are padded to it.
    """
    loud = np.abs(np.asarray(wave, float))
    n, size, reach, span = len(loud), int(longest * rate), int(around * rate), max(4, int(window * rate))
    heard = np.concatenate([[0.0], np.cumsum(loud)])
    edges = [0]
    while n - edges[-1] > size:
        here = edges[-1]
        first, last = max(here, here + size - reach), min(n, here + size + reach) - span
        stop = here + size
        if last > first:
            quiet = first + int((heard[first + span : last + span + 1] - heard[first : last + 1]).argmin())
            stop = quiet + int(loud[quiet : quiet + span].argmin())
        edges.append(min(max(stop, here + 1), n))
    edges.append(n)
    return [(a, b, max(b - a, int(least * rate))) for a, b in zip(edges, edges[1:], strict=False)]


#: Thresholds of speech and shortest silences that are tried in turn until all chunks are short enough.
TRIES = ((0.5, 0.1), (0.3, 0.05), (0.1, 0.05))


def merge_spans(spans: list[tuple[float, float]], longest: float) -> list[tuple[float, float]]:
    """Speech spans merged while the chunk stays within ``longest`` seconds."""
    out: list[list[float]] = []
    for start, stop in spans:
        if out and stop - out[-1][0] <= longest:
            out[-1][1] = stop
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def chunk_speech(find, total: float, longest: float, tries=TRIES) -> list[tuple[float, float]]:
    """Chunks of speech of at most ``longest`` seconds. ``find(threshold, silence)`` gives the spans of speech.

    Lower thresholds and shorter silences are tried where a chunk is too long; at last the whole is cut evenly. Without
    speech the whole is one chunk.
    """
    for threshold, silence in tries:
        chunks = merge_spans(find(threshold, silence), longest) or [(0.0, total)]
        if all(b - a <= longest for a, b in chunks):
            return chunks
    return [(k * longest, min(total, (k + 1) * longest)) for k in range(math.ceil(total / longest))]


def signal_metrics(wave: np.ndarray, rate: int = 16000) -> dict:
    """Level, spectrum shape and noise of a wave; the score weighs noise, band and pitch shares."""
    x = np.asarray(wave, float)
    if not len(x):
        return {"rms_db": -120.0, "peak_db": -120.0, "centroid": 0.0, "band_ratio": 0.0, "snr": 0.0, "zero_crossings": 0.0, "clipped": 0.0, "score": 0.0}
    db = lambda v: float(20 * np.log10(max(v, 1e-6)))
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    total = max(power.sum(), 1e-12)
    frames = np.array([np.sqrt((f**2).mean()) for f in np.array_split(x, max(1, len(x) // 16))])
    snr = db(np.quantile(frames, 0.9)) - db(np.quantile(frames, 0.1))
    band = float(power[(hz >= 300) & (hz <= 3400)].sum() / total)
    child = float(power[(hz >= 250) & (hz <= 600)].sum() / total)
    return {"rms_db": db(np.sqrt((x**2).mean())), "peak_db": db(np.abs(x).max()), "centroid": float((hz * power).sum() / total), "band_ratio": band, "snr": snr, "zero_crossings": float((np.diff(np.signbit(x)) != 0).mean()) if len(x) > 1 else 0.0, "clipped": float((np.abs(x) >= 0.999).mean()), "score": 100 * (0.5 * min(max(snr / 40, 0), 1) + 0.3 * band + 0.2 * child)}


def clean(wave: np.ndarray, level: float = 0.1, headroom: float = 0.95) -> np.ndarray:
    """Spikes to the local median, level to a target, never above the headroom."""
    x = np.asarray(wave, float).copy()
    if len(x) > 2:
        mid = np.median(np.stack([np.roll(x, 1), x, np.roll(x, -1)]), 0)
        spike = np.abs(x - mid) > 6 * max(np.std(x), 1e-9)
        x[spike] = mid[spike]
    rms = np.sqrt((x**2).mean()) if len(x) else 0.0
    x = x * (level / rms) if rms > 0 else x
    peak = np.abs(x).max(initial=0.0)
    return x * (headroom / peak) if peak > headroom else x


def mix_noise(wave: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    x, n = np.asarray(wave, float), np.resize(np.asarray(noise, float), len(wave))
    power = (n**2).mean() if len(n) else 0.0
    return x if power == 0 else x + n * np.sqrt((x**2).mean() / (power * 10 ** (snr_db / 10)))

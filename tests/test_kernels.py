"""Sequence kernels on fixtures worked out by hand, and invariants on random inputs."""

import math
import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from voxframe.functions import kernels as k


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


words = st.text(alphabet="abɑé ", max_size=12)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_edit_ops_cost_the_distance(a, b):
    ops = k.edit_ops(a, b)
    assert k.distance_table(a, b)[-1, -1] == plain_distance(a, b) == sum(op != "match" for op, _, _ in ops)
    assert "".join(r for _, r, _ in ops) == a and "".join(h for _, _, h in ops) == b


def test_votes():
    assert k.rover_progressive(["abc", "abd", "abc"]) == "abc"
    assert k.rover_medoid(["ab", "acb", "acb"]) == "acb"
    assert k.rover_progressive([]) == "" and k.rover_medoid([]) == ""
    for text in ("", "hello", "héé"):
        assert k.rover_progressive([text] * 3) == text == k.rover_medoid([text] * 3)
    assert k.rover_medoid(["ab", "ab", "axxb"]) == "ab"


def test_texts():
    assert k.nfc("ẽ") == "ẽ"
    assert k.fix_repetitions("a" * 21 + "b") == "ab" and k.fix_repetitions("a" * 20) == "a" * 20
    assert k.fix_repetitions("x" + "abc" * 25 + "y") == "xabcy" and k.fix_repetitions("short") == "short"
    assert k.edit_pairs("ab", "b") == [("a", "[DEL]")] and k.edit_pairs("b", "ab") == [("[INS]", "a")]


def paths(logp, labels, blank=0):
    """Sum over all frame paths that collapse to the labels."""
    import itertools

    total = -math.inf
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        if [s for i, s in enumerate(path) if s != blank and (i == 0 or path[i - 1] != s)] == list(labels):
            total = np.logaddexp(total, sum(logp[t, s] for t, s in enumerate(path)))
    return total


def test_ctc():
    draw = np.random.default_rng(0)
    logp = k.log_softmax(draw.normal(size=(5, 3)))
    for labels in ([], [1], [1, 1], [1, 2, 1]):
        assert abs(k.force_score(logp, labels) - paths(logp, labels)) < 1e-9
    assert k.force_score(logp, [1] * 6) == -math.inf
    best = k.beam(logp, 200)[0]
    sums = {tuple(x): paths(logp, x) for n in range(4) for x in np.ndindex(*(3,) * n) if 0 not in x}
    assert tuple(best[0]) == max(sums, key=sums.get) and abs(best[1] - max(sums.values())) < 1e-9
    frames = np.full((6, 3), -9.0)
    for t, s in enumerate([1, 1, 0, 1, 2, 2]):
        frames[t, s] = 0.0
    assert k.greedy(frames) == [1, 1, 2]
    a = k.force_align(k.log_softmax(frames), [1, 1, 2])
    assert a["frames"] == [2, 1, 2] and abs(a["blank_ratio"] - 1 / 6) < 1e-9


def test_segments_and_times():
    assert k.segment_words([(0, 1), (1, 1), (5, 1), (6, 1)], 6.5) == [(0, 2), (2, 4)]
    assert k.segment_words([(0, 50)], 30) == [(0, 1)] and k.segment_words([], 5) == []
    assert k.fix_timestamps([0, 100, 50, 200]) in ([0, 100, 100, 200], [0, 0, 50, 200], [0, 100, 200, 200])
    draw = random.Random(1)
    for _ in range(50):
        t = [draw.randrange(100) for _ in range(draw.randrange(12))]
        fixed = k.fix_timestamps(t)
        assert len(fixed) == len(t) and fixed == sorted(fixed)
    wave = np.random.default_rng(2).normal(size=1000)
    cuts = k.chunk_low_energy(wave, 100, 2.0, 0.5)
    assert all(n == max(b - a, 50) for a, b, n in cuts) and k.chunk_low_energy(wave[:10], 100, 2.0) == [(0, 10, 50)]
    assert cuts[0][0] == 0 and cuts[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert k.merge_spans([(0, 4), (5, 9), (12, 14)], 10) == [(0, 9), (12, 14)]
    tried = []

    def find(threshold, silence):
        tried.append((threshold, silence))
        return {0.5: [(0, 25)], 0.3: [(0, 8), (9, 14)]}[threshold]

    assert k.chunk_speech(find, 25, 10) == [(0, 8), (9, 14)] and tried == [(0.5, 0.1), (0.3, 0.05)]
    assert k.chunk_speech(lambda t, s: [(0, 25)], 25, 10) == [(0, 10), (10, 20), (20, 25)]
    assert k.chunk_speech(lambda t, s: [], 7, 10) == [(0, 7)]


def best_path(logp, labels):
    """All paths of a label sequence, one by one: the largest log-probability."""
    out = -math.inf
    for path in np.ndindex(*(logp.shape[1],) * len(logp)):
        read = [x for i, x in enumerate(path) if x and (i == 0 or path[i - 1] != x)]
        if read == labels:
            out = max(out, sum(logp[t, x] for t, x in enumerate(path)))
    return out


def test_alignment_is_the_best_path():
    draw = np.random.default_rng(3)
    for _ in range(30):
        logp = k.log_softmax(draw.normal(size=(5, 3)) * 2)
        for labels in ([], [1], [2, 2], [1, 2, 1], [1, 1, 1]):
            a = k.force_align(logp, labels)
            assert len(a["frames"]) == len(labels)
            at = [0] * 5
            for (x, y), s in zip(a["spans"], labels, strict=True):
                at[x:y] = [s] * (y - x)
            assert abs(sum(logp[t, s] for t, s in enumerate(at)) - best_path(logp, labels)) < 1e-9
            assert np.allclose(a["confidence"], [np.exp(logp[x:y, s]).mean() for (x, y), s in zip(a["spans"], labels, strict=True)])
    assert k.force_align(logp, [1] * 4)["frames"] == [] and k.force_align(logp[:0], [1])["frames"] == []
    f = k.duration_features([1, 1, 4], [0.5, 0.7, 0.9])
    assert (f["dur_mean"], f["dur_max"], f["single"]) == (2.0, 4.0, 2 / 3) and abs(f["conf_std"] - np.std([0.5, 0.7, 0.9])) < 1e-12


def test_beam_with_a_language_model_is_exhaustive_search():
    grams = [("", "1", -0.9), ("", "2", -1.4), ("", "</s>", -1.2), ("<s>", "1", -0.4), ("1", "2", -0.3), ("1 2", "1", -0.2), ("2", "2", -0.5)]
    lm = k.Automaton(grams, [("<s>", -0.6), ("1", -0.25), ("2", -0.35), ("1 2", -0.15)], 3)
    assert lm.step("1 2", "1") == (-0.2, "1") and lm.step("<s>", "2") == (-0.6 - 1.4, "2")
    assert np.isclose(lm.step("1 2", "2")[0], -0.15 - 0.5) and lm.step("1", "2")[1] == "1 2" and lm.step("", "9") == (-20.0, "")

    def told(labels):
        total, state = 0.0, lm.state(["<s>"])
        for x in labels:
            p, state = lm.step(state, str(x))
            total += p
        return total

    draw = np.random.default_rng(5)
    for w in (0.3, 1.5):
        for _ in range(10):
            logp = k.log_softmax(draw.normal(size=(4, 3)))
            every = {x: paths(logp, x) + w * told(x) for n in range(5) for x in np.ndindex(*(3,) * n) if 0 not in x}
            want = sorted(((-s, x) for x, s in every.items() if s > -math.inf))[:3]
            got = k.beam(logp, 500, nbest=3, lm=lm, weight=w, symbols=["", "1", "2"])
            assert [tuple(x) for x, _ in got] == [x for _, x in want] and np.allclose([s for _, s in got], [-s for s, _ in want])


def test_bit_parallel_distance_is_the_plain_tables():
    draw = random.Random(7)
    for _ in range(400):
        a, b = ("".join(draw.choice("abé😀") for _ in range(draw.choice((0, 1, 3, 9, 70)))) for _ in "ab")
        if draw.random() < 0.3:
            b = a[:5] + b + a[5:]
        assert k.distance(a, b) == k.distance(b, a) == int(k.distance_table(a, b)[-1, -1])
    assert k.below_diagonal(["ab", "b", "", "ab"]) == [[], [1], [2, 1], [0, 1, 2]]


def test_signals():
    wave = np.sin(np.arange(4000) * 0.3)
    assert k.signal_metrics(np.zeros(0))["score"] == 0.0 and k.signal_metrics(wave)["rms_db"] < 0
    assert np.abs(k.clean(wave * 9)).max() <= 0.95 + 1e-9
    mixed = k.mix_noise(wave, np.ones(7), 10)
    assert abs(10 * math.log10((wave**2).mean() / ((mixed - wave) ** 2).mean()) - 10) < 1e-6


def plain_path(a, b):
    """Steps by the plain table, walked from the end: both sides, else the first alone, else the second."""
    n, m = len(a), len(b)
    cost = [[i + j for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out = []
    while n or m:
        if n and m and cost[n][m] == cost[n - 1][m - 1] + (a[n - 1] != b[m - 1]):
            n, m = n - 1, m - 1
            out.append(k.BOTH)
        elif n and cost[n][m] == cost[n - 1][m] + 1:
            n -= 1
            out.append(k.REF)
        else:
            m -= 1
            out.append(k.HYP)
    return out[::-1]


def plain_progressive(hyps):
    """Columns as lists of the votes of all hypotheses so far, counted anew each time."""
    columns = [[c] for c in hyps[0]]

    def head(votes):
        letters = [v for v in votes if v]
        return max(set(letters), key=lambda c: (letters.count(c), c))

    for n, h in enumerate(hyps[1:], 1):
        steps, i, j, grown = plain_path([head(c) for c in columns], h), 0, 0, []
        for step in steps:
            if step == k.HYP:
                grown.append([""] * n + [h[j]])
            else:
                grown.append([*columns[i], h[j] if step == k.BOTH else ""])
            i, j = i + (step != k.HYP), j + (step != k.REF)
        columns = grown
    return "".join(head(c) for c in columns if c.count(head(c)) > c.count(""))


def plain_medoid(hyps, weights):
    far = [sum(plain_distance(h, o) for o in hyps) for h in hyps]
    base = hyps[far.index(min(far))]
    if len(set(hyps)) == 1:
        return base
    if not base:
        return max(hyps, key=hyps.count)
    spoken, between = [], []
    for h in hyps:
        steps, i, j, at, gaps = plain_path(base, h), 0, 0, [None] * len(base), [""] * (len(base) + 1)
        for step in steps:
            if step == k.HYP:
                gaps[i] += h[j]
            elif step == k.BOTH:
                at[i] = h[j]
            i, j = i + (step != k.HYP), j + (step != k.REF)
        spoken.append(at)
        between.append(gaps)
    out = ""
    for i in range(len(base) + 1):
        for g in dict.fromkeys(b[i] for b in between if b[i]):
            if sum(w for b, w in zip(between, weights, strict=True) if b[i] == g) > sum(weights) / 2:
                out += g
        if i < len(base):
            votes = {}
            for at, w in zip(spoken, weights, strict=True):
                votes[at[i]] = votes.get(at[i], 0) + w
            lost = votes.pop(None, 0)
            best = max(votes, key=votes.get)
            out += best if votes[best] >= lost else ""
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(words, min_size=1, max_size=5))
def test_votes_match_plain_ones(hyps):
    assert k.rover_progressive(hyps) == plain_progressive(hyps)
    for weights in ([1.0] * len(hyps), [1.0 + 0.5 * (i % 2) for i in range(len(hyps))]):
        assert k.rover_medoid(hyps, weights) == plain_medoid(hyps, weights)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_paths_match_the_plain_table(a, b):
    assert k.edit_path(a, b) == plain_path(a, b)


def test_paths_of_long_texts_keep_two_bits_a_cell():
    draw = random.Random(5)
    a = "".join(draw.choice("abcdé ") for _ in range(4000))
    b = "".join(draw.choice(("", c, "x")) if draw.random() < 0.2 else c for c in a)
    tracemalloc.start()
    pairs = k.edit_pairs(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == k.distance(a, b) and peak < len(a) * len(b) / 2
    assert pairs == [(r or "[INS]", h or "[DEL]") for op, r, h in k.edit_ops(a, b) if op != "match"]


def test_the_nearest_text_is_found_without_whole_tables():
    draw = random.Random(6)
    base = "".join(draw.choice("abcd ") for _ in range(3000))
    hyps = ["".join("x" if draw.random() < share else c for c in base) for share in (0.2, 0.0, 0.1)]
    tracemalloc.start()
    got = k.rover_medoid(hyps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(base) ** 2 and got == k.rover_medoid(hyps, None, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, max_size=5))
def test_distances_of_several_texts_at_once(texts):
    assert k.below_diagonal(texts) == [[plain_distance(x, y) for y in texts[:i]] for i, x in enumerate(texts)]
    assert all(k.distances(x, texts) == [plain_distance(x, y) for y in texts] for x in texts)


def plain_steady(times):
    """All runs by the quadratic table: the longest that ends first, going back to first members."""
    best, before = [], []
    for i, t in enumerate(times):
        earlier = [j for j in range(i) if times[j] <= t]
        top = max((best[j] for j in earlier), default=0)
        best.append(top + 1)
        before.append(next((j for j in earlier if best[j] == top), -1) if top else -1)
    i, out = best.index(max(best)) if best else -1, []
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def plain_times(times):
    good, out = plain_steady(times), list(times)
    for i in range(len(times)):
        if i not in good:
            left = max((g for g in good if g < i), default=None)
            right = min((g for g in good if g > i), default=None)
            if left is None or right is None:
                out[i] = times[right if left is None else left]
            elif right - left - 1 <= 2:
                out[i] = times[left] if i - left <= right - i else times[right]
            else:
                out[i] = times[left] + (times[right] - times[left]) / (right - left) * (i - left)
    return [int(x) for x in out]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=25))
def test_timestamps_match_the_quadratic_table(times):
    assert k.steady(times).tolist() == plain_steady(times)
    assert k.fix_timestamps(times) == plain_times(times)


def test_timestamps_of_long_texts_take_no_square_of_their_length():
    import time

    times = [i if i % 7 else max(0, i - 700) for i in range(200_000)]
    start = time.time()
    assert k.fix_timestamps(times) == sorted(k.fix_timestamps(times))
    assert time.time() - start < 20


def test_quiet_cuts_match_sums_of_each_window():
    wave = np.random.default_rng(4).integers(-50, 50, 700).astype(float)
    for size, reach, span in ((100, 30, 10), (64, 64, 16), (50, 3, 10)):
        want, at = [], 0
        while len(wave) - at > size:
            lo, hi = max(at, at + size - reach), min(len(wave), at + size + reach)
            cut = at + size
            if hi - lo > span:
                sums = [np.abs(wave[i : i + span]).sum() for i in range(lo, hi - span + 1)]
                i = lo + sums.index(min(sums))
                part = np.abs(wave[i : i + span]).tolist()
                cut = i + part.index(min(part))
            cut = min(max(cut, at + 1), len(wave))
            want.append((at, cut))
            at = cut
        want.append((at, len(wave)))
        assert [x[:2] for x in k.chunk_low_energy(wave, 1, size, reach, span)] == want

"""The language model against exact sums over paths, and the classifier on held-out rows."""

import itertools
import math
import zlib

import numpy as np

from voxframe.llm import common, hmm, quality


def test_forward_is_the_sum_over_all_paths():
    head = [hmm.END, b"a", b"b"]
    m = hmm.Model(head, {}, 30, 5, np.zeros(hmm.CLASSES), np.zeros(hmm.CLASSES), np.concatenate([[3, 10, 5], np.ones(hmm.CLASSES)]), states=3)
    ids = np.array([1, 2, 2, 1, 0], np.int32)
    got = hmm.log10_likelihoods(m, hmm.Packed([(0, ids), (1, ids[:3])])) * math.log(10)
    for j, seq in enumerate((ids, ids[:3])):
        total = sum(m.first[p[0]] * m.emit[seq[0], p[0]] * math.prod(m.step[p[t - 1], p[t]] * m.emit[seq[t], p[t]] for t in range(1, len(seq))) for p in itertools.product(range(3), repeat=len(seq)))
        assert abs(got[j] - math.log(total)) < 1e-9
    # expected counts: posteriors of all paths
    out, trans, first = hmm.expected(m, [(0, ids)], np.float64)
    weight, want = 0.0, np.zeros((3, 3))
    for p in itertools.product(range(3), repeat=5):
        x = m.first[p[0]] * m.emit[ids[0], p[0]] * math.prod(m.step[p[t - 1], p[t]] * m.emit[ids[t], p[t]] for t in range(1, 5))
        weight += x
        for t in range(4):
            want[p[t], p[t + 1]] += x
    assert np.allclose(trans, want / weight) and abs(first.sum() - 1) < 1e-9 and abs(out.sum() - 5) < 1e-9


def corpus(n):
    draw = np.random.default_rng(1)
    langs = [[f"{c}{i}" for i in range(60)] for c in "xyz"]
    rows = [(i, " ".join(draw.choice(langs[i % 3], 40))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "X1 y2\tunseen\x85word"), (3, rows[3][1]), (n + 2, "z1 " * 30000)]


def test_scores(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = hmm.score_texts(docs, states=3, head=100, held=120).collect()
    assert len(got) == len(rows)
    held = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 7 == 2
    counts = {}
    for i, t in rows:
        if not held(i):
            for w in [*(t or "").encode().lower().split(), b"\n"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)
        r = next(r for r in got if r.doc_id == i and r.n_tokens == len(w))
        assert r.held_out == held(i) and r.train_tokens == n and r.n_known == sum(x in counts for x in w)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    told = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in told) > sum(r.base_score for r in told) + 10
    assert hmm.score_texts(docs.where("false")).collect() == []


def test_quality_on_held_out_rows(spark):
    draw = np.random.default_rng(2)
    good, bad = [f"w{i}" for i in range(300)], [f"w{i}!!" for i in range(300)]
    rows = [(i, " ".join(draw.choice(bad if i % 4 == 0 else good, 60)), "a") for i in range(800)]
    rows += [(800, None, "b"), (801, "", "b"), (None, "w1 w2", "b"), (802, "w3 " * 40000, "b"), (5, rows[5][1], "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 7) for i in range(0, 800, 2)] + [(None, 1, 7), (3, None, 7), (2, 0, 7)], "doc_id long, quality int, text int")
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    told = [r for r in got if r.doc_id is not None and r.doc_id < 800 and r.doc_id % 2]
    assert sum(r.predicted for r in told) / len(told) == 1.0
    told = [r for r in got if r.doc_id is not None and r.doc_id < 800 and r.doc_id % 4 == 0 and r.held_out]
    assert told and sum(r.predicted for r in told) / len(told) < 0.05
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.quality_report(docs.where("false"), labels).collect() == []
    assert {r.score for r in quality.quality_report(docs, labels.where("false")).collect()} == {0.5}


def test_symbols_follow_the_vocabulary(spark):
    assert hmm.symbols_for(0) == hmm.symbols_for(5_000) == (8_192, 1_024) and hmm.symbols_for(10**9) == (hmm.HEAD, hmm.CLASSES)
    texts = [" ".join(f"{w:x}" for w in range(k, 100_000, 20) for _ in range(1 + w % 3)) for k in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    m, counts = hmm.train_model(docs, passes=1, states=2)
    assert counts.count() == m.v == 100_001
    assert len(m.head) == 100_001 // 8 and m.classes == 8_192 and len(m.prior) == len(m.head) + m.classes
    rest = np.zeros(m.classes)
    for w in (f"{w:x}".encode() for w in range(100_000)):
        if w not in m.head:
            rest[hmm.word_class(w, m.classes)] += 2 + int(w, 16) % 3
    assert np.allclose(10.0**-m.inner, rest + 1)


def plain_scores(rows, held, states, passes, head, classes):
    """Counts, Baum-Welch and the forward sum by plain loops in probabilities, from the same first model."""
    texts = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    train = [w for i, w in texts.items() if not held(i)]
    counts = {}
    for w in (x for t in train for x in t):
        counts[w] = counts.get(w, 0) + 1
    order = sorted((w for w in counts if w != b"\n"), key=lambda w: (-counts[w], w))
    top = [b"\n", *order[: head - 1]]
    class_n, class_v = np.zeros(classes), np.zeros(classes)
    for w, c in counts.items():
        if w not in top:
            class_n[hmm.word_class(w, classes)] += c
            class_v[hmm.word_class(w, classes)] += 1
    number = {w: i for i, w in enumerate(top)}
    symbol = lambda w: number.get(w, len(top) + hmm.word_class(w, classes))
    m = hmm.Model(top, {}, sum(counts.values()), len(counts), class_n, class_v, np.concatenate([[counts[w] for w in top], class_n]), states)
    emit, step, first, prior = m.emit.tolist(), m.step.tolist(), m.first.tolist(), m.prior.tolist()
    every = range(states)

    def ahead(ids):
        a = [[first[s] * emit[ids[0]][s] for s in every]]
        for x in ids[1:]:
            a.append([sum(a[-1][r] * step[r][s] for r in every) * emit[x][s] for s in every])
        return a

    for _ in range(passes):
        e, t, f = [[200.0 * p] * states for p in prior], [[1.0] * states for _ in every], [1.0] * states
        for ids in ([symbol(w) for w in x] for x in train):
            a, b = ahead(ids), [[1.0] * states]
            for x in ids[:0:-1]:
                b.insert(0, [sum(step[s][r] * emit[x][r] * b[0][r] for r in every) for s in every])
            total = sum(a[-1])
            for k, x in enumerate(ids):
                for s in every:
                    e[x][s] += a[k][s] * b[k][s] / total
                    if k:
                        for r in every:
                            t[r][s] += a[k - 1][r] * step[r][s] * emit[x][s] * b[k][s] / total
            for s in every:
                f[s] += a[0][s] * b[0][s] / total
        sums = [sum(row[s] for row in e) for s in every]
        emit = [[row[s] / sums[s] for s in every] for row in e]
        step, first = [[x / sum(row) for x in row] for row in t], [x / sum(f) for x in f]
    out = {}
    for i, words in texts.items():
        inside = [(counts.get(w, 0) + 1) / (class_n[hmm.word_class(w, classes)] + class_v[hmm.word_class(w, classes)] + 1) for w in words if w not in number]
        out[i] = math.log10(sum(ahead([symbol(w) for w in words])[-1])) + sum(map(math.log10, inside))
    return out


def test_scores_match_plain_loops_and_reruns_agree(spark):
    draw = np.random.default_rng(8)
    rows = [(i, " ".join(draw.choice([f"w{k % 9}" if i % 2 else f"v{k}" for k in range(25)], draw.integers(1, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").cache()
    got = {r.doc_id: r.score for r in hmm.score_texts(docs, states=2, passes=2, head=6, held=8).collect()}
    want = plain_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, 2, 2, 6, 1024)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3
    assert got == {r.doc_id: r.score for r in hmm.score_texts(docs, states=2, passes=2, head=6, held=8).collect()}


def test_the_most_frequent_are_exact(spark):
    import hashlib

    rows = [(f"k{i}", 1 + (i * i) % 13 if i % 5 else 1000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "w string, n long")
    order = sorted(rows, key=lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest()))
    for most in (0, 1, 7, 400, 401, 777, 1999, 2000, 5000):
        assert sorted(tuple(r) for r in common.exactly_most_frequent(df, "n", "w", most).collect()) == sorted(order[:most])


def test_ftrl_matches_plain_steps():
    draw = np.random.default_rng(3)
    rows = [(np.unique(draw.integers(0, 16, 5)).astype(np.int32), None, int(draw.integers(0, 2))) for _ in range(40)]
    rows = [(i, draw.random(len(i)).astype(np.float32), y) for i, _, y in rows]
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(3):
        for idx, values, y in rows:
            pairs = [*zip(idx.tolist(), map(float, values), strict=True), (16, 1.0)]
            w = {i: weight(i) for i, _ in pairs}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in pairs)))
            for i, v in pairs:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    assert np.allclose(quality.ftrl(rows, 4, 3), [weight(i) for i in range(17)], atol=1e-5)


def test_scores_are_sparse_dot_products(spark):
    """Whole texts scored against a plain sum over their words, pairs and marks."""
    draw = np.random.default_rng(5)
    weights = draw.normal(size=(1 << 10) + 1).astype(np.float32)
    texts = ["one two two Three!! four", "", None, "!!!", "x " * 5000 + "end?"]
    got = [r.score for r in quality.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights).orderBy("row.doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        b = quality._buckets(quality._ngrams((text or "").encode(), quality._Words()), 10)
        x = sum(float(weights[k]) for k in b.tolist()) * quality.SCALE / max(1, len(b)) + float(weights[-1])
        assert abs(score - 1 / (1 + math.exp(-x))) < 1e-6

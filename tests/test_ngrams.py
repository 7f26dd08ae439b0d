"""Back-off models: probabilities add up, ARPA text holds all, and scores fall through contexts as plain Python does."""

import math
import random

import pytest

from voxframe.functions.kernels import Automaton
from voxframe.operators import ngrams


@pytest.fixture(scope="module")
def model(spark):
    draw = random.Random(2)
    vocab = [f"w{i}" for i in range(25)]
    texts = [" ".join(draw.choice(vocab[: draw.choice((3, 8, 25))]) for _ in range(draw.choice((0, 1, 4, 12)))) for _ in range(300)]
    s = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", ngrams.padded(ngrams.F.col("text")).alias("w"))
    return texts, s, ngrams.estimate(s, "w", 3)


def test_every_context_adds_up_to_one(spark, model):
    _, _, (grams, weights) = model
    a = Automaton([tuple(r) for r in grams.select("ctx", "w", "logp").collect()], [tuple(r) for r in weights.select("ctx", "bow").collect()], 3)
    words = {w for c, w in a.grams if c == ""}
    assert {"<unk>", "</s>"} <= words and "<s>" not in words
    for ctx in a.known:
        assert abs(sum(math.exp(a.step(ctx, w)[0]) for w in words) - 1) < 1e-9, ctx


def test_counts_of_longest_grams(spark, model):
    texts, s, _ = model
    want = {}
    for t in texts:
        w = ["<s>", *t.split(), "</s>"]
        for i in range(1, len(w)):
            key = (min(3, i + 1), " ".join(w[max(0, i - 2) : i]), w[i])
            want[key] = want.get(key, 0) + 1
    got = {(r.n, r.ctx, r.w): r["count"] for r in ngrams.longest_grams(s, "w", 3).groupBy("n", "ctx", "w").count().collect()}
    assert got == want


def test_arpa_round_trip_and_scores(spark, model, tmp_path):
    texts, s, (grams, weights) = model
    path = str(tmp_path / "arpa")
    ngrams.write_arpa(grams, weights, 3, path)
    back, bows = ngrams.read_arpa(spark, path)
    rows = lambda df, c: {tuple(r)[:-1]: r[-1] for r in df.select(*c).collect()}
    for one, two, c in ((grams, back, ("ctx", "w", "logp")), (weights, bows, ("ctx", "bow"))):
        x, y = rows(one, c), rows(two, c)
        assert x.keys() == y.keys() and all(abs(x[k] - y[k]) < 1e-12 for k in x)
    # the parts, in the order of their names, are one file in the form that others read
    files = sorted(p for p in tmp_path.joinpath("arpa").rglob("part-*"))
    lines = "".join(p.read_text() for p in files).split("\n")
    assert lines[0] == "\\data\\" and lines[-2] == "\\end\\" and [x for x in lines if x.endswith("-grams:")] == ["\\1-grams:", "\\2-grams:", "\\3-grams:"]
    at = {int(x[6]): int(x.split("=")[1]) for x in lines if x.startswith("ngram ")}
    assert all(at[n] == sum("\t" in x and len(x.split("\t")[1].split(" ")) == n for x in lines) for n in (1, 2, 3))
    a = Automaton([tuple(r) for r in grams.select("ctx", "w", "logp").collect()], [tuple(r) for r in weights.select("ctx", "bow").collect()], 3)
    new = [*texts[:40], "w0 zz w1", "zz", "", "w3 w3 w3 w3"]
    asked = spark.createDataFrame(list(enumerate(new)), "id int, text string").select("id", ngrams.padded(ngrams.F.col("text")).alias("w"))
    got = {r.id: r.logp for r in ngrams.score(asked, "id", "w", back, bows, 3).collect()}
    for i, t in enumerate(new):
        total, w = 0.0, ["<s>", *t.split(), "</s>"]
        for k in range(1, len(w)):
            total += a.step(a.state(w[:k]), w[k])[0]
        assert abs(got[i] - total) < 1e-9, t


def test_a_model_too_large_to_send_is_refused(spark, model, monkeypatch):
    monkeypatch.setattr(ngrams, "MOST_GRAMS", 10)
    with pytest.raises(ValueError, match="more than the 10"):
        ngrams.automaton(*model[2], 3)


def test_no_sentences(spark, model):
    grams, weights = ngrams.estimate(model[1].where("false"), "w", 3)
    assert grams.collect() == [] and weights.collect() == []
    assert ngrams.score(model[1].where("id < 2"), "id", "w", grams, weights, 3).count() == 2

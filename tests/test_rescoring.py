"""Classifiers by sums over partitions against a plain fit, and planted confusions that are mended on held-out rows."""

import numpy as np

from voxframe.functions import kernels
from voxframe.operators import classifiers
from voxframe.plans import kernels as plans


def test_sums_over_partitions_are_the_plain_fit(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 3))
    kind, fold = draw.integers(0, 2, 600), draw.integers(0, 3, 600)
    y = (draw.random(600) < 1 / (1 + np.exp(-(x @ [2, -1, 0.5] * np.where(kind, 1, -1) + 0.3)))).astype(float)
    df = spark.createDataFrame([(int(k), int(f), float(c), [float(z) for z in r]) for k, f, c, r in zip(kind, fold, y, x, strict=True)], "kind int, fold int, y double, x array<double>").repartition(5)
    got = classifiers.train(df, 3, 3)
    assert set(got) == {(k, f) for k in (0, 1) for f in range(3)}
    for (k, f), w in got.items():
        rows = (kind == k) & (fold != f)
        z = np.concatenate([x[rows], np.ones((rows.sum(), 1))], 1)
        p = classifiers.probability(w, x[rows])
        # at the maximum the slope is what the ridge takes
        assert np.abs(z.T @ (y[rows] - p) - classifiers.RIDGE * w).max() < 1e-6
    assert classifiers.train(df.where("false"), 3, 3) == {}


def test_planted_confusions_are_mended_on_held_out_rows(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = [(i, [float(z) for z in draw.normal(0, 0.35, 64)], 0) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = plans.vowel_rescore(spark, str(tmp_path)).collect()
    assert len(out) == 400
    before = sum(kernels.distance(r.truth, r.before) for r in out)
    after = sum(kernels.distance(r.truth, r.after) for r in out)
    assert before > 300 and after < 0.7 * before, (before, after)

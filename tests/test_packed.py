"""Packed files: round trips by ranges, numpy's own reading of them, types kept, ranges bounded."""

import numpy as np
import pytest

from voxframe.sources import packed


@pytest.mark.parametrize("dtype", ("<f4", "<f2"))
def test_round_trip_by_ranges(spark, tmp_path, dtype):
    draw = np.random.default_rng(1)
    rows = {f"u{i}": [float(x) for x in draw.normal(size=4 * draw.integers(0, 30)).astype(dtype)] for i in range(60)}
    rows |= {"none": None, "long": [float(x) for x in np.arange(4 * 900).astype(dtype)]}
    df = spark.createDataFrame([*rows.items(), (None, [1.0] * 4)], "k string, v array<float>").repartition(5)
    path = f"{tmp_path}/packed"
    files = packed.write_packed(df, path, "k", "v", 4, dtype, file_bytes=6000)
    assert files > 2 and len(list(tmp_path.joinpath("packed").glob("*.npz"))) == files
    index = packed.index_of(spark, path, batch_bytes=1000)
    ranges = index.collect()
    size = np.dtype(dtype).itemsize * 4
    assert all(len(r.keys) == 1 or (r.offsets[-1] + max(r.lengths[-1], 0)) * size <= 1000 for r in ranges)
    got = {r.key: (r.frames, r.symbols, r.dtype, None if r["values"] is None else list(r["values"])) for r in packed.read_packed(index).collect()}
    assert got == {k: (None if v is None else len(v) // 4, 4, dtype, v) for k, v in rows.items()}
    seen = {}
    for f in tmp_path.joinpath("packed").glob("*.npz"):
        with np.load(f) as z:
            assert z["logits"].dtype == np.dtype(dtype) and z["logits"].shape[1] == 4
            seen |= {str(k): z["logits"][o : o + n] for k, o, n in zip(z["utterance_ids"], z["offsets"], z["lengths"], strict=True) if n >= 0}
    assert all(np.array_equal(seen[k].ravel(), np.array(v, dtype)) for k, v in rows.items() if v is not None)
    some = index.where("array_contains(keys, 'long')")
    assert any(r.key == "long" and r.frames == 900 for r in packed.read_packed(some).collect())


def test_no_rows_and_odd_lengths(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0])], "k string, v array<float>")
    assert packed.write_packed(df.where("false"), f"{tmp_path}/none", "k", "v", 4) == 0
    assert packed.read_packed(packed.index_of(spark, f"{tmp_path}/none")).collect() == []
    with pytest.raises(Exception, match="no whole number of frames"):
        packed.write_packed(df, f"{tmp_path}/odd", "k", "v", 2)

"""Pair sums by tiles against all pairs written out; ids far apart make no more tiles."""

import numpy as np

from flightline.operators.identity import separability


def test_pairs_in_tiles_are_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, who, frame = np.arange(90) * 100_000 + 7, rng.integers(0, 3, 90), rng.integers(0, 9, 90)
    df = spark.createDataFrame([(int(i), int(w), int(f), x.tolist()) for i, w, f, x in zip(ids, who, frame, v)], "id long, identity int, frame long, vec array<double>")
    dots, a, b = v @ v.T, *np.triu_indices(90, 1)
    same = dots[a, b][(who[a] == who[b]) & (abs(frame[a] - frame[b]) >= 2)]
    diff = dots[a, b][(frame[a] == frame[b]) & (who[a] != who[b])]
    mid = (same.mean() + diff.mean()) / 2
    want = [len(same), same.mean(), same.std(), len(diff), diff.mean(), diff.std(), ((same > mid).sum() + (diff <= mid).sum()) / (len(same) + len(diff))]
    for tile in (7, 1024):
        r = separability(df, tile).first()
        assert np.allclose([r[c] for c in ("n_same", "mean_same", "sd_same", "n_diff", "mean_diff", "sd_diff", "accuracy")], want)

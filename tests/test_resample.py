"""Resampling: hand-computed weights, the formula pixel by pixel, sizes that don't change."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.sources.images import PRECISION, ROWS, grey, luma_grid_numpy, resample, resample_weights, resampled


def lanczos(x):
    if x == 0:
        return 1.0
    return math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if -3 <= x < 3 else 0.0


def plain_pass(row, n_out):
    """One row, cell by cell, in Python integers."""
    n_in = len(row)
    if n_in == n_out:
        return list(row)
    scale = n_in / n_out
    wide, out = max(scale, 1.0), []
    for o in range(n_out):
        center = (o + 0.5) * scale
        first, last = max(int(center - 3 * wide + 0.5), 0), min(int(center + 3 * wide + 0.5), n_in)
        w = [lanczos((i - center + 0.5) / wide) for i in range(first, last)]
        total = sum(w)
        fixed = [int(x / total * 2**22 + (-0.5 if x / total < 0 else 0.5)) for x in w]
        got = (sum(k * row[i] for k, i in zip(fixed, range(first, last))) + 2**21) >> 22
        out.append(max(0, min(255, got)))
    return out


def plain(picture, gw, gh):
    rows = [plain_pass([int(v) for v in r], gw) for r in picture]
    cols = [plain_pass([r[c] for r in rows], gh) for c in range(gw)]
    return [[cols[c][r] for c in range(gw)] for r in range(gh)]


def test_weights_by_hand():
    assert resample_weights(2, 1).tolist() == [[1 << 21, 1 << 21]]  # two cells at equal distances
    assert resample_weights(5, 5).tolist() == (np.eye(5, dtype=int) << PRECISION).tolist()
    # doubling: the first cell's centre is a quarter into the first input; cut at the edge
    raw = [lanczos(0.25), lanczos(1.25), lanczos(2.25)]
    got = resample_weights(3, 6)[0]
    assert got.tolist() == [int(x / sum(raw) * 2**22 + math.copysign(0.5, x)) for x in raw]
    for sizes in ((64, 8), (17, 9), (9, 32), (1, 8), (1000, 32)):
        assert abs(resample_weights(*sizes).sum(axis=1) - (1 << PRECISION)).max() <= sizes[0]
    assert resample(np.array([[0, 255]], np.uint8), 1, 1).tolist() == [[128]]


@pytest.mark.parametrize("w,h,gw,gh", [(24, 20, 9, 8), (7, 40, 8, 8), (31, 5, 32, 32), (8, 8, 8, 8), (1, 1, 9, 8), (8, 30, 8, 8)])
def test_resampling_equals_the_formula(w, h, gw, gh):
    rng = np.random.default_rng(w * h)
    picture = rng.integers(0, 256, (h, w)).astype(np.uint8)
    picture[: h // 2] = np.where(picture[: h // 2] > 128, 255, 0)  # overshoot is clipped
    assert resample(picture, gw, gh).tolist() == plain(picture, gw, gh)


def test_grey_and_strips():
    px = np.array([[[0, 0, 255], [0, 255, 0], [255, 0, 0], [255, 255, 255], [1, 2, 3]]], np.uint8)  # B, G, R
    assert grey(px).tolist() == [[76, 150, 29, 255, 2]]
    assert grey(px[:, :, :1]).tolist() == [[0, 0, 255, 255, 1]]
    rng = np.random.default_rng(1)
    tall = rng.integers(0, 256, (2 * ROWS + 17, 40, 3)).astype(np.uint8)
    got = luma_grid_numpy(tall.tobytes(), 40, len(tall), 3, 9, 8)
    assert got.reshape(8, 9).tolist() == resample(grey(tall), 9, 8).tolist()


def test_resampled_column_with_odd_rows(spark):
    df = spark.createDataFrame([(1, list(range(6))), (2, None), (3, [1, 2]), (4, [300, -5, 0, 0, 0, 0])], "id int, cells array<int>")
    got = {r.id: r.g for r in df.select("id", resampled("cells", 3, 2, 3, 2).alias("g")).collect()}
    assert got == {1: list(range(6)), 2: None, 3: None, 4: [255, 0, 0, 0, 0, 0]}
    assert df.limit(0).select(resampled(F.col("cells"), 3, 2, 3, 2)).count() == 0

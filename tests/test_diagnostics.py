"""Batch diagnostics over blocks of points: the same as by definition, and no array as wide as all points."""

import numpy as np
import pytest

from loomstat.operators import diagnostics


def made(spark, n=900, dims=16, copies=True):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, dims)) + 100
    if copies:
        x[n // 2 :] = x[rng.integers(0, n // 2, n - n // 2)]
    batch = rng.integers(0, 3, n)
    order = rng.permutation(n)
    points = spark.createDataFrame([(int(i), "abc"[batch[i]], x[i].tolist()) for i in order], "sample_id long, batch string, coords array<double>")
    return points, x, batch


def distances(x):
    return np.sqrt(np.cumsum((x[:, None, :] - x[None]) ** 2, axis=2)[:, :, -1])


def nearest_counts(x, batch, k):
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.stack([(batch[near] == g).sum(1) for g in range(3)], axis=1)


def test_neighbours_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "BLOCK", 128)
    points, x, batch = made(spark)
    blocks = diagnostics.Blocks(points)
    sizes = [r.n for r in blocks.df.select("n").collect()]
    assert sum(sizes) == 900 and max(sizes) <= 256
    want = nearest_counts(x, batch, 7)
    got = diagnostics.neighbour_shares(blocks, 7).toPandas().sort_values("row")
    assert np.array_equal(np.stack(got.shares), want) and got.batch.tolist() == ["abc"[b] for b in batch]
    squares = (want**2).sum(1)
    assert diagnostics.lisi(points, 7).first()[0] == pytest.approx(np.median(49 / squares))


@pytest.mark.parametrize("scale", [1.0, 1e-27, 1e18])
def test_neighbours_are_exact_in_any_order(scale):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(600, 12)), rng.integers(0, 2, size=(300, 12))]).astype(float) * scale
    codes = rng.integers(0, 3, 900)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :20]
    state = diagnostics._Nearest(list("abc"), 20, np.arange(500, 700), codes[500:700], x[500:700])
    for first in rng.permutation(9) * 100:
        state.add(int(first), codes[first : first + 100], x[first : first + 100])
    assert np.array_equal(state.row, want[500:700])


def test_only_drawn_points_look_for_neighbours(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "BLOCK", 128)
    points, x, batch = made(spark)
    looked, real = [], diagnostics._against_all

    def spied(blocks, own, *more):
        looked.append(sum(len(rows) for _, rows, _, _ in own.collect()))
        return real(blocks, own, *more)

    monkeypatch.setattr(diagnostics, "_against_all", spied)
    got = diagnostics.kbet(points, n_test=40).first()[0]
    drawn = np.random.default_rng(42).choice(900, size=40, replace=False)
    share = np.bincount(batch) / 900
    chi = ((nearest_counts(x, batch, 50)[drawn] - 50 * share) ** 2 / (50 * share)).sum(1)
    assert looked == [40] and got == pytest.approx((chi > 5.991464547107979).mean())


def test_silhouettes_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "BLOCK", 128)
    points, x, batch = made(spark)
    d = distances(x)
    sums = np.stack([d[:, batch == g].sum(1) for g in range(3)], axis=1)
    count, i = np.bincount(batch), np.arange(900)
    inside = sums[i, batch] / (count[batch] - 1)
    means = sums / count
    means[i, batch] = np.inf
    want = (means.min(1) - inside) / np.maximum(means.min(1), inside)
    got = diagnostics.silhouettes(diagnostics.Blocks(points)).toPandas().sort_values("row").silhouette
    assert np.allclose(got, want, atol=1e-12) and diagnostics.silhouette(points).first()[0] == pytest.approx(want.mean(), abs=1e-12)


def test_permutations_over_blocks_and_points_packed_once(spark, monkeypatch):
    monkeypatch.setattr(diagnostics, "BLOCK", 128)
    points, x, batch = made(spark, copies=False)
    x, total = x - x.mean(0), ((x - x.mean(0)) ** 2).sum()
    count = np.bincount(batch)
    between = lambda g: sum((x[g == b].sum(0) ** 2 / count[b]).sum() for b in range(3))
    ratio = lambda s: s / 2 / ((total - s) / 897)
    f = ratio(between(batch))
    hits = sum(ratio(between(np.random.default_rng([42, i]).permutation(batch))) >= f - 1e-12 * f for i in range(19))
    got = diagnostics.permanova(points, 19).first()
    assert got.permanova_f == pytest.approx(f) and got.permanova_p == pytest.approx((hits + 1) / 20)
    packs, real = [], diagnostics.Blocks.__init__
    monkeypatch.setattr(diagnostics.Blocks, "__init__", lambda self, points: (packs.append(1), real(self, points))[1])
    row = diagnostics.global_diagnostics(points.withColumnRenamed("coords", "features"), "raw", 12, 9).first()
    assert len(packs) == 1 and row.permanova_f is not None and row.silhouette_pc is not None and row.lisi_batch is not None

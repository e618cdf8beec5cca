"""Kernels against hand-computed values and properties."""

import numpy as np
import pytest

from netscale.functions import kernels as K

POINTS = np.abs(np.subtract.outer([0, 1, 3, 7.0], [0, 1, 3, 7.0]))


def test_linkage_heights():
    assert np.allclose(K.linkage(POINTS, "average")[:, 2], [1, 2.5, 17 / 3])
    assert np.allclose(K.linkage(POINTS, "ward")[:, 2], [1, 2.886751, 6.940221])
    assert np.allclose(K.linkage(POINTS, "single")[:, 2], [1, 2, 4])
    assert np.allclose(K.linkage(POINTS, "complete")[:, 2], [1, 3, 7])
    with pytest.raises(ValueError):
        K.linkage(POINTS, "median")


def test_linkage_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(5):
        x = rng.normal(size=(9, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        groups, heights = [[i] for i in range(9)], []
        while len(groups) > 1:
            h, i, j = min((np.mean([d[a, b] for a in groups[i] for b in groups[j]]), i, j) for i in range(len(groups)) for j in range(i))
            heights.append(h)
            groups[j] += groups.pop(i)
        assert np.allclose(K.linkage(d, "average")[:, 2], heights)


def test_flat_clusters_number_inner_clusters_first():
    z = K.linkage(POINTS, "average")
    assert K.flat_clusters(z, 2.5).tolist() == [1, 1, 1, 2]
    assert K.flat_clusters(z, 1.0).tolist() == [1, 1, 2, 3]
    assert K.flat_clusters(z, 0.5).tolist() == [1, 2, 3, 4]
    assert K.flat_clusters(z, 9).tolist() == [1, 1, 1, 1]
    assert sorted(K.leaves(z)) == [0, 1, 2, 3]


def test_spectra():
    path = K.dense_laplacian(np.arange(4), np.array([0, 1, 2]), np.array([1, 2, 3]), np.ones(3))
    assert np.allclose(np.linalg.eigvalsh(path), [0, 2 - 2**0.5, 2, 2 + 2**0.5])
    a, b = np.triu_indices(4, 1)
    assert np.allclose(np.linalg.eigvalsh(K.dense_laplacian(np.arange(4), a, b, np.ones(6))), [0, 4, 4, 4])


@pytest.mark.parametrize("tau", [0.01, 1.0, 100.0])
def test_density(tau):
    path = K.dense_laplacian(np.arange(6), np.arange(5), np.arange(1, 6), np.ones(5))
    rho = K.density(tau, path)
    w, v = np.linalg.eigh(path)
    exact = (v * np.exp(-tau * w)) @ v.T
    assert np.isclose(np.trace(rho), 1) and (rho > 0).all() and np.allclose(rho, rho.T)
    assert np.allclose(rho, exact / np.trace(exact), atol=1e-13)


def test_percolation_by_hand():
    grid = np.array([0.1, 0.3, 0.45, 0.6, 0.95])
    edges, nodes = K.percolation(4, np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3]), np.array([0.9, 0.5, 0.4, 0.1]), grid)
    assert nodes.tolist() == [1, 0.75, 0.75, 0.5, 0] and edges.tolist() == [1, 0.75, 0.5, 0.25, 0]


def test_percolation_prefers_the_smallest_node():
    edges, nodes = K.percolation(5, np.array([3, 0]), np.array([4, 1]), np.array([0.9, 0.5]), np.array([0.5, 0.9]))
    assert nodes.tolist() == [0.4, 0.4] and edges.tolist() == [0.5, 0.5]


def test_strong_and_weak_components():
    nodes, src, dst = np.arange(6), np.array([0, 1, 2, 3]), np.array([1, 2, 0, 4])
    assert K.strong_labels(nodes, src, dst).tolist() == [0, 0, 0, 3, 4, 5]
    assert K.weak_labels(nodes, src, dst).tolist() == [0, 0, 0, 3, 3, 5]


def test_butterworth():
    b, a = K.butter_bandpass(0.01, 0.1, 1.0)
    assert len(b) == len(a) == 9 and abs(b.sum()) < 1e-10
    centre = 2 * np.arctan(np.sqrt(np.tan(np.pi * 0.01) * np.tan(np.pi * 0.1)))
    w = np.exp(-1j * centre * np.arange(9))
    assert np.isclose(abs((b @ w) / (a @ w)), 1)
    t = np.arange(500)
    y = K.band_filter(np.sin(2 * np.pi * 0.05 * t) + 5, 0.02, 0.1)[0]
    assert abs(y - np.sin(2 * np.pi * 0.05 * t))[100:400].max() < 0.01
    with pytest.raises(ValueError):
        K.band_filter(np.zeros(27), 0.02, 0.1)


def test_hilbert_and_modes():
    t = np.arange(1000) / 100
    _, f, amplitude = K.hilbert_frequency(3 * np.sin(2 * np.pi * 5 * t), 100)
    assert abs(f[100:-100] - 5).max() < 0.05 and abs(amplitude[100:-100] - 3).max() < 0.05
    x = np.sin(2 * np.pi * 5 * t) + np.sin(2 * np.pi * 0.5 * t) + t
    modes = K.sift(x)
    assert np.allclose(modes.sum(axis=0), x)

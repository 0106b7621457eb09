import numpy as np
from manybody.functions import harmonics as h

RNG = np.random.default_rng(1)


def test_separation_identity():
    x, y, p = np.array([[1.1, -0.4, 0.9]]), np.array([[0.1, 0.2, -0.15]]), 24
    total = (np.conj(h.regular(p, y)) * h.irregular(p, x)).sum()
    assert abs(total - 1 / np.linalg.norm(x - y)) < 1e-12


def test_gradients_by_differences():
    x, e = RNG.normal(size=(5, 3)), 1e-6
    for f, g in ((h.regular, h.regular_gradient), (h.irregular, h.irregular_gradient)):
        value, grad = g(5, x)
        assert np.allclose(value, f(5, x))
        for a in range(3):
            d = np.eye(3)[a] * e
            assert np.allclose(grad[a], (f(5, x + d) - f(5, x - d)) / (2 * e), rtol=1e-5, atol=1e-5 * np.abs(grad[a]).max())


def test_translations_against_the_direct_sum():
    p, q, u = 14, RNG.normal(size=20), RNG.uniform(-1, 1, (20, 3))  # sources around 0, radius 1
    m = q @ h.stored(np.conj(h.regular(p, u)), p)
    x = np.array([[5.2, 0.7, -0.3]])
    exact = (q / np.linalg.norm(x - u, axis=1)).sum()
    assert abs(m @ h.weights(h.irregular(p, x), p)[0] - exact) < 1e-6 * abs(q).sum()
    o = 5
    up = h.up_matrices(p)[o] @ m  # the parent's centre is at -s_o, its radius 2
    v = (x + h.octant_direction(o)) / 2
    assert abs(up @ h.weights(h.irregular(p, v), p)[0] / 2 - exact) < 1e-4 * abs(q).sum()
    places, far = h.far_matrices(p)
    local = far[places[(3, 0, 0)]] @ m  # around (6, 0, 0)
    y = x - np.array([6.0, 0, 0])
    assert abs(local @ h.weights(h.regular(p, y), p)[0] - exact) < 1e-4 * abs(q).sum()
    child = h.down_matrices(p)[o] @ local  # around (6, 0, 0) + s_o / 2, radius 1/2
    w = (y - h.octant_direction(o) / 2) * 2
    assert abs(child @ h.weights(h.regular(p, w), p)[0] * 2 - local @ h.weights(h.regular(p, y), p)[0]) < 1e-9


def test_bessel_and_orthonormality():
    z = np.array([0.3, 2.0, 11.0, 3 + 1j, 0.5j])
    j, hk = h.spherical_j(12, z), h.spherical_h(12, z)
    y = (hk - j) / 1j
    assert np.allclose((j[:, 1:] * y[:, :-1] - j[:, :-1] * y[:, 1:]) * z[:, None] ** 2, 1, rtol=1e-8)
    t, w = np.polynomial.legendre.leggauss(12)
    f = np.arange(24) * 2 * np.pi / 24
    d = np.array([[np.sqrt(1 - a * a) * np.cos(b), np.sqrt(1 - a * a) * np.sin(b), a] for a in t for b in f])
    v = h.orthonormal(5, d)
    assert np.allclose((v * np.repeat(w, 24)[:, None]).T @ v * 2 * np.pi / 24, np.eye(36), atol=1e-12)

import numpy as np
import pytest
from manybody.functions import harmonics as h
from manybody.functions import rotations as rot
from manybody.functions import waves as w
from manybody.operators.kernels import STRATEGIES, Helmholtz, Laplace, Yukawa


def test_turns_and_angles():
    r = np.random.default_rng(2)
    q = rot.euler(0.4, 1.1, -2.0)
    assert np.allclose(q @ q.T, np.eye(3)) and np.isclose(np.linalg.det(q), 1)
    for b in (*r.normal(size=(5, 3)), (0, 0, 2.0), (0, 0, -1.0), (1.0, 0, 0)):
        assert np.allclose(rot.onto_z(b) @ b, [0, 0, np.linalg.norm(b)])
    x = r.normal(size=(9, 3))
    for kind, basis in rot._BASIS.items():
        assert np.allclose(basis(6, x @ q.T), basis(6, x) @ rot.turn(kind, 6, q).T, rtol=1e-9, atol=1e-9 * np.abs(basis(6, x)).max())
    t = rot.turn("Y", 5, q)
    assert np.allclose(t @ t.T, np.eye(36)) and np.allclose(rot.turn("Y", 5, q.T), t.T)


def test_symmetries_and_classes():
    s = rot.symmetries()
    assert len({tuple(x.ravel()) for x in s}) == 48 and np.allclose(s[0], np.eye(3))
    reps, which, element = rot.classes()
    assert len(reps) == 16 and np.bincount(which).sum() == 316
    assert all((s[e] @ reps[c] == o).all() for o, c, e in zip(h.far_offsets(), which, element))


@pytest.mark.parametrize("kernel", [lambda s: Laplace(6, strategy=s), lambda s: Helmholtz(1.2 + 0.1j, p=5, strategy=s), lambda s: Yukawa(2.0, p=5, strategy=s)])
def test_strategies_agree(kernel):
    r, got = np.random.default_rng(3), []
    c = r.normal(size=(4, 1, kernel("dense").size))
    for s in STRATEGIES:
        k = kernel(s)
        k.side = 3.0
        far = k.far(3)
        got.append(np.stack([k.move(c, far[i]) for i in range(0, 316, 7)]))
        assert k.chosen() == (s, "as asked for")
    assert np.allclose(got[1], got[0], rtol=1e-8, atol=1e-9 * np.abs(got[0]).max()) and np.allclose(got[2], got[0], rtol=1e-8, atol=1e-9 * np.abs(got[0]).max())
    assert rot.choose(36)[0] == "dense" and rot.choose(441)[0] == "classes"


def test_up_and_down_by_rotation():
    p, b = 6, h.octant_direction(3) / 2
    z = np.array([0, 0, np.linalg.norm(b)])
    assert np.allclose(rot.rotated("M", "M", p, b, h.m2m(p, z, 0.5)), h.m2m(p, b, 0.5), atol=1e-12)
    assert np.allclose(rot.rotated("L", "L", p, b, h.l2l(p, z, 0.5)), h.l2l(p, b, 0.5), atol=1e-9)
    t = lambda s: w.regular_translation(p, 1.5, 1.0, 0.5, s)
    assert np.allclose(rot.rotated("Y", "Y", p, b, t(z)), t(b), atol=1e-9)


def test_waves():
    x = np.array([0.3, 1.0, 4.0])
    assert np.allclose(w.modified_i(2, x)[:, 1], (x * np.cosh(x) - np.sinh(x)) / x**2) and np.allclose(w.modified_k(1, x)[:, 1], np.exp(-x) * (1 + x) / x**2)
    z = np.array([0.2, -0.9, 1.0, -1.0])
    with np.errstate(divide="ignore", invalid="ignore"):
        want = h.normalised_legendre(5, z) / np.sqrt(1 - z * z)[:, None]
    m = h._orders(5)[1]
    assert np.allclose(w.legendre_over_sin(5, z)[:2, m > 0], want[:2, m > 0]) and np.isfinite(w.legendre_over_sin(5, z)).all()
    assert [w.degree(1e-4, t) for t in (1e-3, 1e-6)] == sorted(w.degree(1e-4, t) for t in (1e-3, 1e-6))
    by = w.degrees_by_level(2.0, 4.0, range(2, 6), 1e-4)
    assert list(by) == [2, 3, 4, 5] and by[2] >= by[5]
    y, k = np.array([0.2, -0.1, 0.3]), 1.3 + 0.2j
    far = np.array([[1.5, 1.0, -2.0]])
    s = (w.waves("R", 14, k, 0.5, y[None]) * w.waves("S", 14, k, 0.5, far)).sum() * 4j * np.pi * k
    d = np.linalg.norm(far - y)
    assert np.isclose(s, np.exp(1j * k * d) / d, rtol=1e-8)

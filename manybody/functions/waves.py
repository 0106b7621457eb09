"""Spherical waves of the Helmholtz equation, their gradients, translations and degrees, in NumPy.

With real orthonormal harmonics Y_nm and complex k:

    R_nm(x) = j_n(k r) / s_n Y_nm,  S_nm(x) = h_n(k r) s_n Y_nm,  s_n = |k a|^n / (2n+1)!!

for a box of half-width a, so that both stay of moderate size, and
e^{ik|x-y|} / |x-y| = 4 pi i k sum_nm R_nm(x) S_nm(y) for |x| < |y|.
Imaginary k gives the modified functions. Translations are projections: a wave
about one centre is integrated against Y_nm on a sphere about another.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from . import harmonics as h


def scales(p: int, ka: complex) -> np.ndarray:
    """s_0 .. s_p."""
    return np.cumprod([1.0, *(abs(ka) / (2 * n + 1) for n in range(1, p + 1))])


def scaled_j(p: int, z: np.ndarray, ka: complex) -> np.ndarray:
    """j_n(z) / s_n."""
    return h.spherical_j(p, z) / scales(p, ka)


def scaled_h(p: int, z: np.ndarray, ka: complex) -> np.ndarray:
    """h_n(z) s_n."""
    return h.spherical_h(p, z) * scales(p, ka)


def modified_i(nmax: int, x: np.ndarray) -> np.ndarray:
    """Modified spherical Bessel functions i_0 .. i_nmax of the first kind: i^-n j_n(ix)."""
    return (h.spherical_j(nmax, 1j * np.asarray(x)) * (-1j) ** np.arange(nmax + 1)).real


def modified_k(nmax: int, x: np.ndarray) -> np.ndarray:
    """Modified spherical functions k_0 .. k_nmax of the second kind, k_0 = e^-x / x: -i^n h_n(ix)."""
    return (-h.spherical_h(nmax, 1j * np.asarray(x)) * 1j ** np.arange(nmax + 1)).real


def legendre_over_sin(nmax: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal P_n^m(x) / sqrt(1 - x^2) for m > 0 at n^2 + n + m, finite at the poles."""
    s, out = np.sqrt(np.maximum(0, 1 - x * x)), np.zeros((*x.shape, (nmax + 1) ** 2))
    sector = np.full(x.shape, np.sqrt(1 / (4 * np.pi)))
    for m in range(1, nmax + 1):
        top = np.sqrt((2 * m + 1) / (2 * m)) * sector
        out[..., h.idx(m, m)] = top
        for n in range(m + 1, nmax + 1):
            low = np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1)) * out[..., h.idx(n - 2, m)] if n - 2 >= m else 0
            out[..., h.idx(n, m)] = np.sqrt((4 * n * n - 1) / (n * n - m * m)) * (x * out[..., h.idx(n - 1, m)] - low)
        sector = top * s
    return out


def angular(p: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Y, dY/dtheta and (dY/dphi) / sin theta of directions x (unit vectors)."""
    z = np.clip(x[..., 2], -1, 1)
    leg, over = h.normalised_legendre(p, z), legendre_over_sin(p, z)
    f = np.arctan2(x[..., 1], x[..., 0])
    y, t, s = np.zeros_like(leg), np.zeros_like(leg), np.zeros_like(leg)
    at = lambda n, m: leg[..., h.idx(n, m)] if m <= n else 0.0
    for n in range(p + 1):
        y[..., h.idx(n, 0)] = at(n, 0)
        t[..., h.idx(n, 0)] = -np.sqrt(n * (n + 1)) * at(n, 1)
        for m in range(1, n + 1):
            slope = (np.sqrt((n + m) * (n - m + 1)) * at(n, m - 1) - np.sqrt((n - m) * (n + m + 1)) * at(n, m + 1)) / 2
            c, d = np.sqrt(2) * np.cos(m * f), np.sqrt(2) * np.sin(m * f)
            y[..., h.idx(n, m)], y[..., h.idx(n, -m)] = at(n, m) * c, at(n, m) * d
            t[..., h.idx(n, m)], t[..., h.idx(n, -m)] = slope * c, slope * d
            q = m * over[..., h.idx(n, m)]
            s[..., h.idx(n, m)], s[..., h.idx(n, -m)] = -q * d, q * c
    return y, t, s


def waves(kind: str, p: int, k: complex, a: float, x: np.ndarray, grad: bool = False):
    """R or S of points x (.., 3), all orders; with grad also the three components of the gradient."""
    r = np.sqrt((x * x).sum(axis=-1))
    centre = r < 1e-13 * a  # the direction of the centre itself does not matter
    x = np.where(centre[..., None], np.array([0, 0, 1e-13 * a]), x)
    r = np.where(centre, 1e-13 * a, r)
    u = x / r[..., None]
    order = h._orders(p)[0]
    radial = (scaled_j if kind == "R" else scaled_h)(p + 1, k * r, k * a)
    if not grad:
        return radial[..., order] * h.orthonormal(p, u)
    y, t, s = angular(p, u)
    sc = scales(p + 1, k * a)
    n = np.arange(p + 1)
    step = sc[1:] / sc[:-1] if kind == "R" else sc[:-1] / sc[1:]
    slope = n / r[..., None] * radial[..., :-1] - k * radial[..., 1:] * step
    f, df = radial[..., order], slope[..., order]
    rho = np.hypot(u[..., 0], u[..., 1])
    c, d = np.where(rho > 0, u[..., 0] / np.where(rho > 0, rho, 1), 1.0), np.where(rho > 0, u[..., 1] / np.where(rho > 0, rho, 1), 0.0)
    theta, phi = (u[..., 2] * c, u[..., 2] * d, -rho), (-d, c, np.zeros_like(c))
    over = f / r[..., None]
    return f * y, [u[..., i, None] * df * y + over * (theta[i][..., None] * t + phi[i][..., None] * s) for i in range(3)]


@lru_cache(8)
def sphere(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that integrate harmonics up to degree 2n - 1 over the unit sphere."""
    z, wz = np.polynomial.legendre.leggauss(n)
    f = 2 * np.pi * np.arange(2 * n) / (2 * n)
    s = np.sqrt(1 - z * z)
    pts = np.stack([np.outer(s, np.cos(f)), np.outer(s, np.sin(f)), np.outer(z, np.ones(2 * n))], axis=-1)
    return pts.reshape(-1, 3), np.repeat(wz, 2 * n) * np.pi / n


def _project(p: int, k: complex, a: float, field) -> np.ndarray:
    """Coefficients in R (about a centre, half-width a) of fields that field(points) gives as columns, by projection.

    Where a radial function is small on the first sphere, a second one is used, degree by
    degree the one on which it is larger.
    """
    pts, weight = sphere(p + 6 + int(abs(k * a)))
    y = h.orthonormal(p, pts) * weight[:, None]
    order = h._orders(p)[0]
    radii = (1.0 * a, 0.71 * a)
    radial = [scaled_j(p, np.array(k * r), k * a) for r in radii]
    one = lambda i: (y.T @ field(radii[i] * pts).reshape(len(pts), -1)) / radial[i][order][:, None]
    if np.abs(radial[0]).min() > 0.2:
        return one(0)
    best = (np.abs(radial[1]) * 1.2 > np.abs(radial[0]))[order]
    return np.where(best[:, None], one(1), one(0))


def regular_translation(p: int, k: complex, a_from: float, a_to: float, shift: np.ndarray) -> np.ndarray:
    """T with R_nm(x; from) = sum T[nm, n'm'] R_n'm'(x - shift; to): rows the old waves, columns the new."""
    return _project(p, k, a_to, lambda x: waves("R", p, k, a_from, x + shift)).T


def far_translations(p: int, k: complex, a: float, shifts: np.ndarray) -> np.ndarray:
    """For each shift (target centre - source centre): T with S_nm(x) = sum T[nm, n'm'] R_n'm'(x - shift)."""
    out = []
    for lo in range(0, len(shifts), 16):  # a few shifts at a time bound the memory
        part = shifts[lo : lo + 16]
        got = _project(p, k, a, lambda x, part=part: waves("S", p, k, a, x[:, None, :] + part[None]))
        out.append(got.reshape(len(got), len(part), -1).transpose(1, 2, 0))
    return np.concatenate(out)


@lru_cache(24)
def tables(name: str, p: int, k: complex, a: float) -> np.ndarray:
    """Translations of boxes of half-width a, kept by the worker: 'far' by offset, 'up' and 'down' by octant below a parent of 2a."""
    if name == "far":
        return far_translations(p, k, a, 2 * a * h.far_offsets().astype(float)).transpose(0, 2, 1)
    t = np.stack([regular_translation(p, k, 2 * a, a, a * h.octant_direction(o)) for o in range(8)])
    return t if name == "up" else t.transpose(0, 2, 1)


def degree(ka: complex, tolerance: float, most: int = 40) -> int:
    """The smallest degree whose truncated series is within the tolerance, relative to the potential.

    For a pair 1.05 and 2.95 half-widths from the centre, in line: with these distances the
    degrees for k = 0 are the Laplace kernel's.
    """
    ka = complex(ka)
    n = np.arange(most + 12)
    term = (2 * n + 1) * h.spherical_j(most + 11, np.array(ka * 1.05)) * h.spherical_h(most + 11, np.array(ka * 2.95))
    rest, size = np.abs(np.cumsum(term[::-1])[::-1]), max(abs(term.sum()), 1e-300)
    for p in range(most):
        if rest[p + 1] <= tolerance * size:
            return p
    raise ValueError("no degree up to the bound reaches the tolerance")


def degrees_by_level(k: complex, side: float, levels: range, tolerance: float) -> dict[int, int]:
    """The degree of each level of a domain of the given side; the worst case is the coarsest level's."""
    return {lev: degree(k * side / 2.0 ** (lev + 1), tolerance) for lev in levels}

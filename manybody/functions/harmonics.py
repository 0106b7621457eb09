"""Solid harmonics and the translation matrices of Laplace expansions, in NumPy.

R_n^m = r^n / (n+m)! P_n^m(cos t) e^{imf} and I_n^m = (n-m)! / r^{n+1} P_n^m e^{imf},
without the Condon-Shortley phase; X_n^{-m} = (-1)^m conj X_n^m. Full arrays hold all
orders at n^2 + n + m. Expansions are stored as reals: the real part of order m > 0
at n^2 + n + m, the imaginary part at n^2 + n - m.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def idx(n: int, m: int) -> int:
    return n * n + n + m


def nm(i: int) -> tuple[int, int]:
    n = int(np.sqrt(i))
    return n, i - n * n - n


def _mirror(out: np.ndarray, p: int) -> np.ndarray:
    for n in range(1, p + 1):
        for m in range(1, n + 1):
            out[..., idx(n, -m)] = (-1) ** m * np.conj(out[..., idx(n, m)])
    return out


def regular(p: int, x: np.ndarray) -> np.ndarray:
    """R_n^m of points x (.., 3), all orders."""
    out = np.moveaxis(np.zeros(((p + 1) ** 2, *x.shape[:-1]), complex), 0, -1)  # an order's values are neighbours
    rho, z, r2 = x[..., 0] + 1j * x[..., 1], x[..., 2], (x * x).sum(axis=-1)
    out[..., 0] = 1
    for m in range(p + 1):
        if m:
            out[..., idx(m, m)] = rho / (2 * m) * out[..., idx(m - 1, m - 1)]
        for n in range(m + 1, p + 1):
            low = r2 * out[..., idx(n - 2, m)] if n - 2 >= m else 0
            out[..., idx(n, m)] = ((2 * n - 1) * z * out[..., idx(n - 1, m)] - low) / ((n + m) * (n - m))
    return _mirror(out, p)


def irregular(p: int, x: np.ndarray) -> np.ndarray:
    """I_n^m of points x (.., 3) other than 0, all orders."""
    out = np.moveaxis(np.zeros(((p + 1) ** 2, *x.shape[:-1]), complex), 0, -1)  # an order's values are neighbours
    rho, z, r2 = x[..., 0] + 1j * x[..., 1], x[..., 2], (x * x).sum(axis=-1)
    out[..., 0] = 1 / np.sqrt(r2)
    for m in range(p + 1):
        if m:
            out[..., idx(m, m)] = (2 * m - 1) * rho / r2 * out[..., idx(m - 1, m - 1)]
        for n in range(m + 1, p + 1):
            low = ((n - 1) ** 2 - m * m) * out[..., idx(n - 2, m)] if n - 2 >= m else 0
            out[..., idx(n, m)] = ((2 * n - 1) * z * out[..., idx(n - 1, m)] - low) / r2
    return _mirror(out, p)


def _at(full: np.ndarray, n: int, m: int):
    return full[..., idx(n, m)] if n >= 0 and abs(m) <= n else 0


def regular_gradient(p: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and its gradient (3, .., (p+1)^2)."""
    r = regular(p, x)
    g = np.zeros((3, *r.shape), complex)
    for n in range(1, p + 1):
        for m in range(-n, n + 1):
            a, b = _at(r, n - 1, m - 1), _at(r, n - 1, m + 1)
            g[0][..., idx(n, m)], g[1][..., idx(n, m)], g[2][..., idx(n, m)] = (a - b) / 2, 1j * (a + b) / 2, _at(r, n - 1, m)
    return r, g


def irregular_gradient(p: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """I and its gradient (3, .., (p+1)^2)."""
    i = irregular(p + 1, x)
    g = np.zeros((3, *i.shape[:-1], (p + 1) ** 2), complex)
    for n in range(p + 1):
        for m in range(-n, n + 1):
            a, b = _at(i, n + 1, m - 1), _at(i, n + 1, m + 1)
            g[0][..., idx(n, m)], g[1][..., idx(n, m)], g[2][..., idx(n, m)] = (a - b) / 2, 1j * (a + b) / 2, -_at(i, n + 1, m)
    return i[..., : (p + 1) ** 2], g


@lru_cache(32)
def _orders(p: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.repeat(np.arange(p + 1), 2 * np.arange(p + 1) + 1)
    return n, np.arange((p + 1) ** 2) - n * n - n


def stored(full: np.ndarray, p: int) -> np.ndarray:
    """Real storage of the orders m >= 0."""
    n, m = _orders(p)
    pos = full[..., n * n + n + np.abs(m)]
    return np.where(m >= 0, pos.real, pos.imag)


def weights(full: np.ndarray, p: int) -> np.ndarray:
    """Coefficients w with sum over all orders of C X = stored(C) . w."""
    n, m = _orders(p)
    pos = full[..., n * n + n + np.abs(m)]
    return np.where(m == 0, pos.real, np.where(m > 0, 2 * pos.real, -2 * pos.imag))


def _real_matrix(t: np.ndarray, p: int) -> np.ndarray:
    """Of a complex map of full arrays, the map of stored ones."""
    n, m = _orders(p)
    size = (p + 1) ** 2
    b = np.zeros((size, size), complex)  # full = b @ stored
    for i in range(size):
        k = abs(m[i])
        if k == 0:
            b[i, i] = 1
        else:
            sign, conj = (1, 1) if m[i] > 0 else ((-1) ** k, -1)
            b[i, idx(n[i], k)], b[i, idx(n[i], -k)] = sign, conj * sign * 1j
    out = t @ b
    pos = out[..., n * n + n + np.abs(m), :]
    return np.where((m >= 0)[:, None], pos.real, pos.imag)


def m2m(p: int, b: np.ndarray, rho: float) -> np.ndarray:
    """Multipole to multipole: b = (c - c') / r', rho = r / r'."""
    r = regular(p, b)
    t = np.zeros(((p + 1) ** 2,) * 2, complex)
    for j in range(p + 1):
        for i in range(-j, j + 1):
            for k in range(j + 1):
                for el in range(-k, k + 1):
                    if abs(i - el) <= j - k:
                        t[idx(j, i), idx(k, el)] = rho**k * np.conj(r[idx(j - k, i - el)])
    return _real_matrix(t, p)


def l2l(p: int, t_: np.ndarray, sigma: float) -> np.ndarray:
    """Local to local: t = (c' - c) / r, sigma = r' / r."""
    r = regular(p, t_)
    t = np.zeros(((p + 1) ** 2,) * 2, complex)
    for j in range(p + 1):
        for i in range(-j, j + 1):
            for n in range(j, p + 1):
                for m in range(-n, n + 1):
                    if abs(m - i) <= n - j:
                        t[idx(j, i), idx(n, m)] = sigma ** (j + 1) * r[idx(n - j, m - i)]
    return _real_matrix(t, p)


def m2l(p: int, b: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Multipole to local for many b = (c' - c) / r (k, 3): matrices (k, size, size)."""
    irr = irregular(2 * p, b)
    n, m = _orders(p)
    j, i = n[:, None], m[:, None]
    at = (n[None, :] + j) ** 2 + (n[None, :] + j) + (m[None, :] - i)
    t = irr[:, at] * ((-1.0) ** (j + i) * sigma ** (j + 1.0))
    return _real_matrix(t, p)


def octant_direction(o: int) -> np.ndarray:
    return np.array([2 * (o >> 2 & 1) - 1, 2 * (o >> 1 & 1) - 1, 2 * (o & 1) - 1], float)


@lru_cache(8)
def up_matrices(p: int) -> np.ndarray:
    """M2M from each octant to the parent."""
    return np.stack([m2m(p, octant_direction(o) / 2, 0.5) for o in range(8)])


@lru_cache(8)
def down_matrices(p: int) -> np.ndarray:
    """L2L from the parent to each octant."""
    return np.stack([l2l(p, octant_direction(o) / 2, 0.5) for o in range(8)])


def far_offsets() -> np.ndarray:
    """The 316 offsets target - source of boxes that are apart while their parents touch, in lexicographic order."""
    r = range(-3, 4)
    return np.array([(x, y, z) for x in r for y in r for z in r if max(abs(x), abs(y), abs(z)) > 1])


@lru_cache(4)
def far_matrices(p: int) -> tuple[dict[tuple[int, int, int], int], np.ndarray]:
    """M2L between boxes of a level, by offset."""
    d = far_offsets()
    return {tuple(map(int, x)): k for k, x in enumerate(d)}, np.concatenate([m2l(p, 2.0 * d[i : i + 40]) for i in range(0, len(d), 40)])


def normalised_legendre(nmax: int, x: np.ndarray) -> np.ndarray:
    """Orthonormal P_n^m(x), m >= 0, at n^2 + n + m, without the Condon-Shortley phase."""
    s = np.sqrt(np.maximum(0, 1 - x * x))
    out = np.zeros((*x.shape, (nmax + 1) ** 2))
    out[..., 0] = np.sqrt(1 / (4 * np.pi))
    for m in range(nmax + 1):
        if m:
            out[..., idx(m, m)] = np.sqrt((2 * m + 1) / (2 * m)) * s * out[..., idx(m - 1, m - 1)]
        for n in range(m + 1, nmax + 1):
            a = np.sqrt((4 * n * n - 1) / (n * n - m * m))
            low = np.sqrt(((n - 1) ** 2 - m * m) / (4 * (n - 1) ** 2 - 1)) * out[..., idx(n - 2, m)] if n - 2 >= m else 0
            out[..., idx(n, m)] = a * (x * out[..., idx(n - 1, m)] - low)
    return out


def orthonormal(p: int, x: np.ndarray) -> np.ndarray:
    """Real orthonormal harmonics of directions x: cosines at +m, sines at -m."""
    r = np.sqrt((x * x).sum(axis=-1))
    leg = normalised_legendre(p, x[..., 2] / r)
    f = np.arctan2(x[..., 1], x[..., 0])
    out = np.zeros_like(leg)
    for n in range(p + 1):
        out[..., idx(n, 0)] = leg[..., idx(n, 0)]
        for m in range(1, n + 1):
            out[..., idx(n, m)] = np.sqrt(2) * leg[..., idx(n, m)] * np.cos(m * f)
            out[..., idx(n, -m)] = np.sqrt(2) * leg[..., idx(n, m)] * np.sin(m * f)
    return out


def spherical_j(nmax: int, z: np.ndarray) -> np.ndarray:
    """Spherical Bessel j_0..j_nmax of complex z: backward ratios from far above, scaled to j_0 or j_1."""
    z = np.asarray(z, complex)
    safe = np.where(np.abs(z) < 1e-12, 1e-12, z)
    top = nmax + 20 + int(np.max(np.abs(z), initial=0.0) * 1.5)
    ratio, out = np.zeros_like(safe), [None] * (top + 1)
    for n in range(top, 0, -1):  # ratio = j_n / j_{n-1}
        den = (2 * n + 1) / safe - ratio
        ratio = 1 / np.where(den == 0, 1e-300, den)
        out[n] = ratio
    j0 = np.sin(safe) / safe
    j1 = np.sin(safe) / safe**2 - np.cos(safe) / safe
    res = np.zeros((*z.shape, nmax + 1), complex)
    res[..., 0] = j0
    if nmax:
        res[..., 1] = np.where(np.abs(j0) > np.abs(j1), j0 * out[1], j1)
        for n in range(2, nmax + 1):
            res[..., n] = res[..., n - 1] * out[n]
    return res


def spherical_h(nmax: int, z: np.ndarray) -> np.ndarray:
    """Spherical Hankel h_0..h_nmax of the first kind, by upward recurrence."""
    z = np.asarray(z, complex)
    res = np.zeros((*z.shape, nmax + 1), complex)
    res[..., 0] = -1j * np.exp(1j * z) / z
    if nmax:
        res[..., 1] = -(z + 1j) * np.exp(1j * z) / z**2
        for n in range(1, nmax):
            res[..., n + 1] = (2 * n + 1) / z * res[..., n] - res[..., n - 1]
    return res

"""Kernels of the tree engine: what it asks of a potential, in NumPy on the arrays of one task.

A kernel turns points into expansions and back and moves expansions between boxes.
Expansions are rows of reals, (vectors, size), so the engine knows nothing of a
kernel's mathematics. Another potential is added by another class with these members:

    parameters  names of the strengths' columns; outputs: names of the results'
    size        reals of an expansion
    expand      P2M and P2L: points and strengths to an expansion
    evaluate    L2P and M2P: an expansion at points
    expansions, evaluations: the same for many boxes at once
    up, down    M2M and L2L matrices of the eight octants below a level
    far         M2L matrices of the far offsets on a level
    move        expansions by one of these matrices
    near        P2P: direct sums of one block
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..functions import harmonics as h
from ..functions import rotations as rot
from ..functions import waves as w

#: Degree by the relative L2 error of the potential that it reaches.
DEGREES = {1e-3: 5, 1e-4: 7, 1e-5: 9, 1e-6: 12, 1e-7: 15, 1e-8: 19}


def degree_for(tolerance: float) -> int:
    """The smallest listed degree that reaches the tolerance."""
    found = [p for t, p in DEGREES.items() if t <= tolerance * (1 + 1e-12)]
    if not found:
        raise ValueError(f"no degree reaches {tolerance}")
    return min(found)


STRATEGIES = ("dense", "classes", "rotation")


class Kernel:
    """Settings shared by all kernels: number of strength vectors, gradients, M2L strategy; side: of the domain, set by the engine.

    strategy: a matrix for each far offset (dense), one for each of 16 classes between turns
    by the cube's symmetries (classes), one for each distance along z between rotations
    (rotation), or auto, which takes dense ones while they are small (`rotations.choose`).
    """

    def __init__(self, vectors: int = 1, gradients: bool = False, strategy: str = "auto"):
        if vectors < 1:
            raise ValueError("vectors must be 1 at least")
        if strategy not in (*STRATEGIES, "auto"):
            raise ValueError(f"no strategy {strategy}")
        self.vectors, self.gradients, self.side, self.strategy = vectors, gradients, 1.0, strategy

    def chosen(self) -> tuple[str, str]:
        """The M2L strategy in use, and why."""
        return (self.strategy, "as asked for") if self.strategy != "auto" else rot.choose((self.p + 1) ** 2, self.itemsize)

    itemsize = 8

    @property
    def tags(self) -> list[str]:
        return [""] if self.vectors == 1 else [str(v) for v in range(self.vectors)]

    def radius(self, level: int) -> float:
        return self.side / 2.0 ** (level + 1)

    def move(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Expansions (.., size) by a translation of up, down or far (a matrix, or several to apply in turn)."""
        for x in t if isinstance(t, tuple) else (t,):
            c = c @ x.T
        return c

    #: Whether matrices differ from level to level.
    by_level = True

    def expansions(self, kind: str, levels: np.ndarray, x: np.ndarray, s: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """expand of many boxes (boxes, vectors, size): box k has the points and strengths from begin[k] on, one at least."""
        ends = [*begin[1:], len(x)]
        return np.stack([self.expand(kind, int(v), x[lo:hi], s[lo:hi]) for v, lo, hi in zip(levels, begin, ends, strict=True)])

    def evaluations(self, kind: str, levels: np.ndarray, x: np.ndarray, c: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """evaluate of many expansions c (boxes, vectors, size): box k at the points from begin[k] on."""
        ends = [*begin[1:], len(x)]
        return np.concatenate([self.evaluate(kind, int(v), x[lo:hi], e) for v, lo, hi, e in zip(levels, begin, ends, c, strict=True)])


def _pairs(x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Differences by axis, and inverse distances (0 where points coincide), of all targets and sources."""
    d = [x[:, None, a] - y[None, :, a] for a in range(3)]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    same = r2 == 0
    r2[same] = 1.0
    inv = 1 / np.sqrt(r2)
    inv[same] = 0.0
    return d, inv


#: Points whose harmonics a task holds at once.
POINTS = 2048


def _runs(begin: np.ndarray, n: int):
    """Runs of boxes with about POINTS points together: first and last box, first and last point."""
    ends = np.append(begin[1:], n)
    lo = 0
    while lo < len(begin):
        hi = max(lo + 1, int(np.searchsorted(ends, begin[lo] + POINTS, "right")))
        yield lo, hi, int(begin[lo]), int(ends[hi - 1])
        lo = hi


@lru_cache(6)
def _laplace_far(strategy: str, p: int):
    if strategy == "dense":
        return h.far_matrices(p)[1]
    return (rot.by_classes if strategy == "classes" else rot.by_rotation)(p, lambda b: h.m2l(p, 2.0 * np.asarray(b, float)), "M", "L")


@lru_cache(12)
def _wave_far(strategy: str, p: int, k: complex, a: float):
    if strategy == "dense":
        return w.tables("far", p, k, a)
    far = lambda b: w.far_translations(p, k, a, 2 * a * np.asarray(b, float)).transpose(0, 2, 1)
    return (rot.by_classes if strategy == "classes" else rot.by_rotation)(p, far, "Y", "Y")


class Laplace(Kernel):
    """Charges q / (4 pi R) and dipoles d.w / (4 pi R^3), by solid harmonics of degree p."""

    def __init__(self, p: int, vectors: int = 1, gradients: bool = False, dipole: bool = False, strategy: str = "auto"):
        super().__init__(vectors, gradients, strategy)
        if not 0 <= p <= 20:
            raise ValueError("p must be 0..20")
        self.p, self.dipole, self.size = p, dipole, (p + 1) ** 2

    @property
    def parameters(self) -> list[str]:
        return [f"q{v}" for v in self.tags] + ([f"m{a}{v}" for v in self.tags for a in "xyz"] if self.dipole else [])

    @property
    def outputs(self) -> list[str]:
        return [f"{n}{v}" for v in self.tags for n in (["phi", "gx", "gy", "gz"] if self.gradients else ["phi"])]

    def _split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        return s[:, : self.vectors], s[:, self.vectors :].reshape(len(s), self.vectors, 3) if self.dipole else None

    def expand(self, kind: str, level: int, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Expansion of points x about the box's centre: multipole (M) from R, local (L) from I, of coordinates by radius."""
        r = self.radius(level)
        q, d = self._split(s)
        x = x / r
        if d is None:
            return q.T @ h.stored(np.conj((h.regular if kind == "M" else h.irregular)(self.p, x)), self.p)
        value, grad = (h.regular_gradient if kind == "M" else h.irregular_gradient)(self.p, x)
        out = q.T @ h.stored(np.conj(value), self.p)
        for a in range(3):
            out = out + (d[:, :, a] / r).T @ h.stored(np.conj(grad[a]), self.p)
        return out

    def evaluate(self, kind: str, level: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        r, p = self.radius(level), self.p
        x = x / r
        if not self.gradients:
            return (h.weights((h.irregular if kind == "M" else h.regular)(p, x), p) @ c.T / r)[..., None]
        value, g = (h.irregular_gradient if kind == "M" else h.regular_gradient)(p, x)
        return np.stack([h.weights(value, p) @ c.T / r, *[h.weights(g[a], p) @ c.T / (r * r) for a in range(3)]], axis=-1)

    by_level = False

    def expansions(self, kind: str, levels: np.ndarray, x: np.ndarray, s: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.empty((len(begin), self.vectors, self.size))
        harmonics = (h.regular if kind == "M" else h.irregular, h.regular_gradient if kind == "M" else h.irregular_gradient)
        for lo, hi, a, z in _runs(begin, len(x)):
            at = begin[lo:hi] - a
            r = np.repeat(self.side / 2.0 ** (levels[lo:hi] + 1), np.diff(np.append(at, z - a)))[:, None]
            q, d = self._split(s[a:z])
            value, grad = (harmonics[0](self.p, x[a:z] / r), None) if d is None else harmonics[1](self.p, x[a:z] / r)
            value = h.stored(np.conj(value), self.p)
            grad = None if d is None else [h.stored(np.conj(g), self.p) for g in grad]
            for v in range(self.vectors):
                row = value * q[:, v : v + 1]
                for k in range(3 if d is not None else 0):
                    row += grad[k] * (d[:, v, k : k + 1] / r)
                out[lo:hi, v] = np.add.reduceat(row, at, axis=0)
        return out

    def evaluations(self, kind: str, levels: np.ndarray, x: np.ndarray, c: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.vectors, len(self.outputs) // self.vectors))
        for lo, hi, a, z in _runs(begin, len(x)):
            row = np.repeat(np.arange(lo, hi), np.diff(np.append(begin[lo:hi], z)))
            r = (self.side / 2.0 ** (levels[row] + 1))[:, None]
            if self.gradients:
                value, g = (h.irregular_gradient if kind == "M" else h.regular_gradient)(self.p, x[a:z] / r)
                parts = [h.weights(value, self.p) / r, *[h.weights(g[k], self.p) / (r * r) for k in range(3)]]
            else:
                parts = [h.weights((h.irregular if kind == "M" else h.regular)(self.p, x[a:z] / r), self.p) / r]
            for v in range(self.vectors):
                own = c[row, v]
                for k, part in enumerate(parts):
                    out[a:z, v, k] = np.einsum("ij,ij->i", part, own)
        return out

    def move(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        if not isinstance(t, tuple):
            return c @ t.T
        return self._turned(self._turned(c, t[0]) @ t[1].T, t[2])

    def _turned(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """c @ t.T for a turn, which keeps degrees apart."""
        out = np.empty_like(c)
        for n in range(self.p + 1):
            k = slice(n * n, (n + 1) ** 2)
            np.matmul(c[..., k], t[k, k].T, out=out[..., k])
        return out

    def up(self, level: int) -> np.ndarray:
        return h.up_matrices(self.p)

    def down(self, level: int) -> np.ndarray:
        return h.down_matrices(self.p)

    def far(self, level: int):
        return _laplace_far(self.chosen()[0], self.p)

    def near(self, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        q, m = self._split(s)
        d, inv = _pairs(x, y)
        out = [inv @ q]
        if self.gradients or m is not None:
            inv3 = inv * inv * inv
        if self.gradients:
            out += [-(inv3 * d[a]) @ q for a in range(3)]
        if m is not None:
            dot = sum(d[a][:, :, None] * m[None, :, :, a] for a in range(3))
            out[0] = out[0] + np.einsum("ts,tsm->tm", inv3, dot)
            if self.gradients:
                inv5 = inv3 * inv * inv
                for a in range(3):
                    out[a + 1] = out[a + 1] + inv3 @ m[:, :, a] - 3 * np.einsum("ts,tsm->tm", inv5 * d[a], dot)
        return np.stack(out, axis=-1)

    def result(self, out: np.ndarray) -> list[np.ndarray]:
        """The results' columns from sums (targets, vectors, parts)."""
        return list((out / (4 * np.pi)).reshape(len(out), -1).T)


class Helmholtz(Kernel):
    """Complex charges q e^{ikR} / (4 pi R), k complex, by spherical waves of degree p; for low frequencies.

    An expansion's reals are the real and then the imaginary parts. The degree is
    given or follows from the tolerance, the wave number and the box size (`waves.degree`).
    """

    real, itemsize = False, 16

    def __init__(self, k: complex, p: int | None = None, tolerance: float = 1e-3, vectors: int = 1, gradients: bool = False, strategy: str = "auto"):
        super().__init__(vectors, gradients, strategy)
        if k == 0 or complex(k).imag < 0 or not np.isfinite(complex(k)):
            raise ValueError("k must be finite, not 0, and not grow")
        self.k, self.tolerance, self.fixed = complex(k), tolerance, p

    @property
    def p(self) -> int:
        return self.fixed if self.fixed is not None else w.degree(self.k * self.radius(2), self.tolerance)

    @property
    def size(self) -> int:
        return 2 * (self.p + 1) ** 2

    @property
    def parameters(self) -> list[str]:
        return [f"q{v}" for v in self.tags] if self.real else [f"{n}{v}" for v in self.tags for n in ("q_re", "q_im")]

    @property
    def outputs(self) -> list[str]:
        names = ["phi", "gx", "gy", "gz"] if self.gradients else ["phi"]
        return [f"{n}{v}" for v in self.tags for n in names] if self.real else [f"{n}_{c}{v}" for v in self.tags for n in names for c in ("re", "im")]

    def _charges(self, s: np.ndarray) -> np.ndarray:
        return s.astype(complex) if self.real else s[:, 0::2] + 1j * s[:, 1::2]

    @staticmethod
    def _reals(c: np.ndarray) -> np.ndarray:
        return np.concatenate([c.real, c.imag], axis=-1)

    def _waves(self, kind: str, level: int, x: np.ndarray, grad: bool = False):
        return w.waves("S" if kind == "M" else "R", self.p, self.k, self.radius(level), x, grad)

    def expand(self, kind: str, level: int, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return self._reals(self._charges(s).T @ self._waves("L" if kind == "M" else "M", level, x))

    def evaluate(self, kind: str, level: int, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        n = self.size // 2
        c = (c[:, :n] + 1j * c[:, n:]).T * (4j * np.pi * self.k)
        if not self.gradients:
            return (self._waves(kind, level, x) @ c)[..., None]
        value, grad = self._waves(kind, level, x, True)
        return np.stack([value @ c, *[g @ c for g in grad]], axis=-1)

    def up(self, level: int) -> np.ndarray:
        return w.tables("up", self.p, self.k, self.radius(level))

    def down(self, level: int) -> np.ndarray:
        return w.tables("down", self.p, self.k, self.radius(level))

    def far(self, level: int):
        return _wave_far(self.chosen()[0], self.p, self.k, self.radius(level))

    def move(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        n = self.size // 2
        return self._reals(super().move(c[..., :n] + 1j * c[..., n:], t))

    def near(self, x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
        q = self._charges(s)
        d, inv = _pairs(x, y)
        r = np.where(inv > 0, 1 / np.where(inv > 0, inv, 1.0), 0.0)
        g = np.exp(1j * self.k * r) * inv
        out = [g @ q]
        if self.gradients:
            f = g * (1j * self.k * r - 1) * inv * inv
            out += [(f * d[a]) @ q for a in range(3)]
        return np.stack(out, axis=-1)

    def result(self, out: np.ndarray) -> list[np.ndarray]:
        flat = (out / (4 * np.pi)).reshape(len(out), -1)
        return list(flat.real.T) if self.real else [c for x in flat.T for c in (x.real.copy(), x.imag.copy())]


class Yukawa(Helmholtz):
    """Real charges q e^{-kappa R} / (4 pi R): the Helmholtz kernel at k = i kappa."""

    real = True

    def __init__(self, kappa: float, p: int | None = None, tolerance: float = 1e-3, vectors: int = 1, gradients: bool = False, strategy: str = "auto"):
        if kappa <= 0:
            raise ValueError("kappa must be positive")
        super().__init__(1j * kappa, p, tolerance, vectors, gradients, strategy)

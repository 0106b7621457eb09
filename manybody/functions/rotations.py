"""Rotations of expansions, the cube's symmetries, and translations made of them.

If all points turn by Q (a 3 x 3 orthogonal matrix), an expansion turns by a matrix
that is block-diagonal in the degree. A translation along b is thus the one along
another vector of the same length between two such turns: along the z axis, where it
keeps the order m (rotation), or along one of the 16 representatives of the far offsets
under the cube's 48 symmetries (classes).
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np

from . import harmonics as h
from . import waves as w


def euler(alpha: float, beta: float, gamma: float) -> np.ndarray:
    """Rotation by gamma about z, then beta about y, then alpha about z."""
    about_z = lambda a: np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    about_y = np.array([[np.cos(beta), 0, np.sin(beta)], [0, 1, 0], [-np.sin(beta), 0, np.cos(beta)]])
    return about_z(alpha) @ about_y @ about_z(gamma)


def onto_z(b: np.ndarray) -> np.ndarray:
    """A rotation that takes the direction of b to the z axis."""
    b = np.asarray(b, float)
    return euler(0, -np.arccos(np.clip(b[2] / np.linalg.norm(b), -1, 1)), -np.arctan2(b[1], b[0]))


_BASIS = {
    "M": lambda p, x: h.stored(np.conj(h.regular(p, x)), p),
    "L": lambda p, x: h.stored(np.conj(h.irregular(p, x)), p),
    "Y": h.orthonormal,
}


def turn(kind: str, p: int, q: np.ndarray) -> np.ndarray:
    """T with E(Qx) = T E(x) for multipoles (M), locals (L) or orthonormal harmonics (Y), degree by degree from its values on a sphere."""
    pts, weight = w.sphere(p + 2)
    a, b = _BASIS[kind](p, pts), _BASIS[kind](p, pts @ q.T)
    out = np.zeros(((p + 1) ** 2,) * 2)
    for n in range(p + 1):
        s = slice(n * n, (n + 1) ** 2)
        out[s, s] = np.linalg.lstsq(a[:, s] * np.sqrt(weight)[:, None], b[:, s] * np.sqrt(weight)[:, None], rcond=None)[0].T
    out[np.abs(out) < 1e-15] = 0.0
    return out


@lru_cache(1)
def symmetries() -> np.ndarray:
    """The 48 signed permutations of the axes, the identity first."""
    return np.stack([np.eye(3)[list(perm)] * np.array(sign)[:, None] for perm in itertools.permutations(range(3)) for sign in itertools.product((1, -1), repeat=3)])


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Representatives of the far offsets (0 <= z <= y <= x), and for each far offset its class and the element that takes the representative to it."""
    offsets = h.far_offsets()
    reps, which = np.unique(-np.sort(-np.abs(offsets), axis=1), axis=0, return_inverse=True)
    turned = np.einsum("eij,rj->eri", symmetries(), reps.astype(float))
    element = np.array([int(np.flatnonzero((turned[:, c] == o).all(axis=1))[0]) for o, c in zip(offsets, which.ravel(), strict=True)])
    return reps, which.ravel(), element


@lru_cache(24)
def symmetry_turns(kind: str, p: int) -> np.ndarray:
    return np.stack([turn(kind, p, q) for q in symmetries()])


class Factored:
    """Far translations as products: item k is the matrices to apply one after the other."""

    def __init__(self, first: np.ndarray, middle: np.ndarray, last: np.ndarray, of: list[tuple[int, int, int]]):
        self.first, self.middle, self.last, self.of = first, middle, last, of

    def __getitem__(self, k: int) -> tuple[np.ndarray, ...]:
        a, b, c = self.of[k]
        return self.first[a], self.middle[b], self.last[c]

    def dense(self) -> np.ndarray:
        """All products, for comparison."""
        return np.stack([c @ b @ a for a, b, c in (self[k] for k in range(len(self.of)))])


def by_classes(p: int, far, before: str, after: str) -> Factored:
    """16 matrices far(offsets) of the representatives, between the turns of the cube's symmetries."""
    reps, which, element = classes()
    back = [int(np.flatnonzero((symmetries() == q.T).all(axis=(1, 2)))[0]) for q in symmetries()]
    return Factored(symmetry_turns(before, p), far(reps), symmetry_turns(after, p), [(back[e], c, e) for c, e in zip(which.tolist(), element.tolist(), strict=True)])


def by_rotation(p: int, far, before: str, after: str) -> Factored:
    """Translations along z, one for each distance, between the rotations onto z and back."""
    offsets = h.far_offsets()
    length = np.round((offsets**2).sum(axis=1)).astype(int)
    kinds, which = np.unique(length, return_inverse=True)
    directions, turned = np.unique(np.round(offsets / np.sqrt(length)[:, None], 12), axis=0, return_inverse=True)
    qs = [onto_z(d) for d in directions]
    coaxial = far(np.stack([np.zeros(len(kinds)), np.zeros(len(kinds)), np.sqrt(kinds)], axis=1))
    coaxial = np.where(_same_order(p), coaxial, 0)
    return Factored(np.stack([turn(before, p, q) for q in qs]), coaxial, np.stack([turn(after, p, q.T) for q in qs]), [(int(d), int(z), int(d)) for d, z in zip(turned.ravel(), which, strict=True)])


def _same_order(p: int) -> np.ndarray:
    m = h._orders(p)[1]
    return m[:, None] == m[None, :]


def rotated(kind_from: str, kind_to: str, p: int, b: np.ndarray, along_z: np.ndarray) -> np.ndarray:
    """A translation along b from that along z by the same distance: rotate, translate, rotate back."""
    q = onto_z(b)
    return turn(kind_to, p, q.T) @ np.where(_same_order(p), along_z, 0) @ turn(kind_from, p, q)


#: Bytes up to which a level's 316 dense matrices are kept by a worker.
DENSE_BYTES = 64 << 20


def choose(size: int, itemsize: int = 8) -> tuple[str, str]:
    """The strategy for expansions of a size, and why."""
    need = 316 * size * size * itemsize
    if need <= DENSE_BYTES:
        return "dense", f"a level's 316 matrices take {need >> 20} MB, at most {DENSE_BYTES >> 20}: one product a pair"
    return "classes", f"a level's 316 matrices would take {need >> 20} MB: 16 matrices and 48 turns take {(16 + 96) * size * size * itemsize >> 20}"

"""Morton keys as Column expressions: LONG keys, bits of x, y, z interleaved above 15 level bits.

A key of level l holds the index (i, j, k), each below 2^l, scaled to level 16. Null
stands for a key that does not exist. No function here needs Python on executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH, LEVEL_BITS = 16, 15
LEVEL_MASK = (1 << LEVEL_BITS) - 1
ROOT = 0
UPPER_BOUND = (1 << 63) - 1
DEEPEST_FIRST = DEPTH
DEEPEST_LAST = (((1 << 48) - 1) << LEVEL_BITS) | DEPTH
# the masks that leave room for two bits between each two, from coarse to fine
_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _spread(x: Column) -> Column:
    for by, mask in _STEPS:
        x = x.bitwiseOR(F.shiftleft(x, by)).bitwiseAND(F.lit(mask))
    return x


def _squeeze(x: Column) -> Column:
    masks = [0xFFFF, *(m for _, m in _STEPS)]
    x = x.bitwiseAND(F.lit(masks[-1]))
    for (by, _), mask in zip(reversed(_STEPS), [m for _, m in reversed(_STEPS[:-1])] + [0xFFFF], strict=True):
        x = x.bitwiseOR(F.shiftright(x, by)).bitwiseAND(F.lit(mask))
    return x


def _pow2(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


#: The bits of an axis within a key; sums on them carry from one to the next of the axis.
AXIS = [sum(1 << (LEVEL_BITS + 3 * b + 2 - a) for b in range(DEPTH)) for a in range(3)]


def _let(value: Column, f) -> Column:
    """f(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _unit(lev: Column, axis: int) -> Column:
    """One box of a level on an axis."""
    return _pow2(F.lit(LEVEL_BITS + 2 - axis + 3 * DEPTH) - lev * 3)


def _after(key: Column, axis: int) -> Column:
    """The axis' bits of the next box of the level, null beyond the last."""
    up = key.bitwiseOR(F.lit(~AXIS[axis])) + _unit(level(key), axis)
    up = up.bitwiseAND(F.lit(AXIS[axis]))
    return F.when((level(key) > 0) & (up != 0), up)


def _before(key: Column, axis: int) -> Column:
    at = key.bitwiseAND(F.lit(AXIS[axis]))
    return F.when((level(key) > 0) & (at != 0), (at - _unit(level(key), axis)).bitwiseAND(F.lit(AXIS[axis])))


def encode(i, j, k, level) -> Column:
    """The key of index (i, j, k) on a level; null if the index is outside."""
    i, j, k, level = (_c(v).cast("long") for v in (i, j, k, level))
    size, scale = _pow2(level), _pow2(F.lit(DEPTH) - level)
    sx, sy, sz = (_spread(v * scale) for v in (i, j, k))
    digits = F.shiftleft(sx, 2).bitwiseOR(F.shiftleft(sy, 1)).bitwiseOR(sz)
    inside = (i >= 0) & (j >= 0) & (k >= 0) & (i < size) & (j < size) & (k < size)
    return F.when(inside, F.shiftleft(digits, LEVEL_BITS).bitwiseOR(level))


def level(key) -> Column:
    return _c(key).bitwiseAND(F.lit(LEVEL_MASK)).cast("int")


def index(key, axis: int) -> Column:
    """i, j or k (axis 0, 1, 2) on the key's own level."""
    key = _c(key)
    wide = _squeeze(F.shiftrightunsigned(key, LEVEL_BITS + 2 - axis))
    return F.floor(wide / _pow2(F.lit(DEPTH) - level(key))).cast("long")


def decode(key) -> Column:
    return F.struct(level(key).alias("level"), *[index(key, a).alias("ijk"[a]) for a in range(3)])


def is_valid(key) -> Column:
    return _c(key) >= 0


def is_root(key) -> Column:
    return _c(key) == ROOT


def _below(lev: Column) -> Column:
    """Ones below the octal digits of a level, level bits included: 2^(15 + 3 (16 - l)) - 1."""
    return F.call_function("shiftrightunsigned", F.lit(UPPER_BOUND), (lev * 3).cast("int"))


def is_well_formed(key) -> Column:
    key = _c(key)
    return (key >= 0) & (level(key) <= DEPTH) & ((key - level(key)).bitwiseAND(_below(level(key))) == 0)


def ancestor(key, lev) -> Column:
    """The ancestor on a level; the key itself on its own, null below it."""
    key, lev = _c(key), _c(lev)
    return F.when(lev <= level(key), key - key.bitwiseAND(_below(lev)) + lev)


def parent(key) -> Column:
    return F.when(level(key) > 0, ancestor(key, level(key) - 1))


def ancestors(key, lowest: int = 0) -> Column:
    """All ancestors from a level down to the key itself."""
    return F.transform(F.sequence(F.lit(lowest), level(key)), lambda lev: ancestor(_c(key), lev))


def proper_ancestors(key) -> Column:
    """All ancestors from the root to the parent; none of the root."""
    key = _c(key)
    return F.when(level(key) > 0, F.transform(F.sequence(F.lit(0), level(key) - 1), lambda lev: ancestor(key, lev))).otherwise(F.array().cast("array<bigint>"))


def octant(key) -> Column:
    """4x + 2y + z of the last digit; null for the root."""
    key = _c(key)
    return F.when(level(key) > 0, F.pmod(F.floor((key - level(key)) / _pow2(F.lit(LEVEL_BITS + 3 * DEPTH) - level(key) * 3)), F.lit(8)).cast("int"))


def child(key, o) -> Column:
    key = _c(key)
    return F.when(level(key) < DEPTH, key + 1 + _c(o).cast("long") * _pow2(F.lit(LEVEL_BITS + 3 * DEPTH - 3) - level(key) * 3))


def children(key) -> Column:
    key = _c(key)
    return F.when(level(key) < DEPTH, F.array(*[child(key, o) for o in range(8)]))


def siblings(key) -> Column:
    return children(parent(key))


def is_ancestor(key, other) -> Column:
    """Whether key is other or an ancestor of it."""
    return F.coalesce(ancestor(other, level(key)) == _c(key), F.lit(False))


def common_ancestor(key, other) -> Column:
    """The finest box that holds both."""
    pairs = F.transform(F.sequence(F.lit(0), F.least(level(key), level(other))), lambda v: F.when(ancestor(_c(key), v) == ancestor(_c(other), v), ancestor(_c(key), v)))
    return F.aggregate(pairs, F.lit(None).cast("long"), lambda a, x: F.coalesce(x, a))


def shifted(key, dx, dy, dz) -> Column:
    """The key moved by whole boxes; null outside the domain."""
    key = _c(key)
    at = F.array(*[index(key, a) + _c(d).cast("long") for a, d in enumerate((dx, dy, dz))])
    return _let(at, lambda v: encode(v[0], v[1], v[2], level(key)))


OFFSETS = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]


def neighbours(key) -> Column:
    """The up to 26 boxes of the same level that touch the box, by sums on the interleaved bits."""
    key = _c(key)
    axes = F.struct(*[F.struct(_before(key, a).alias("a"), key.bitwiseAND(F.lit(AXIS[a])).alias("b"), _after(key, a).alias("c")).alias("xyz"[a]) for a in range(3)])

    def cells(v):
        at = lambda a, d: v["xyz"[a]]["abc"[d + 1]]
        return F.array(*[at(0, x).bitwiseOR(at(1, y)).bitwiseOR(at(2, z)).bitwiseOR(level(key).cast("long")) for x, y, z in OFFSETS])

    return F.filter(_let(axes, cells), lambda k: k.isNotNull())


def last_descendant(key) -> Column:
    """The level-16 key at the box's outer corner."""
    key = _c(key)
    return (key - level(key)).bitwiseOR(_below(level(key)) - LEVEL_MASK).bitwiseOR(F.lit(DEPTH).cast("long"))


def next_outside(key) -> Column:
    """The first level-16 key beyond the box; null at the domain's end."""
    last = last_descendant(key)
    return F.when(last != DEEPEST_LAST, last + (1 << LEVEL_BITS))


def adjacent(a, b) -> Column:
    """Whether two closed boxes touch and neither holds the other."""
    a, b = _c(a), _c(b)
    touch = F.lit(True)
    for axis in range(3):
        m = F.lit(AXIS[axis])
        for p, q in ((a, b), (b, a)):  # the box before p's first cell is not beyond q's last
            last = q.bitwiseAND(m).bitwiseOR(_below(level(q)).bitwiseAND(m))
            first = p.bitwiseAND(m)
            touch = touch & ((first == 0) | ((first - (1 << (LEVEL_BITS + 2 - axis))).bitwiseAND(m) <= last))
    return touch & ~is_ancestor(a, b) & ~is_ancestor(b, a)


def point_key(x, y, z, domain: tuple[float, float, float, float, float, float], lev: int = DEPTH) -> Column:
    """The key of a point in domain (ax, ay, az, wx, wy, wz), clamped at the upper faces."""
    at = [F.least(F.floor((_c(v) - F.lit(domain[a])) / F.lit(domain[a + 3]) * float(1 << lev)).cast("long"), F.lit((1 << lev) - 1)) for a, v in enumerate((x, y, z))]
    return encode(*at, F.lit(lev))


def box(key, domain) -> Column:
    """Lower corner, side length of a box."""
    side = [F.lit(domain[a + 3]) / _pow2(level(key)) for a in range(3)]
    return F.struct(*[(F.lit(domain[a]) + index(key, a) * side[a]).alias("xyz"[a]) for a in range(3)], *[side[a].alias("w" + "xyz"[a]) for a in range(3)])


def centre(key, domain) -> Column:
    r = F.lit(domain[3]) / _pow2(level(key) + 1)
    return F.array(*[F.lit(domain[a]) + (index(key, a) * 2 + 1) * r for a in range(3)])


def radius(key, domain) -> Column:
    return F.lit(domain[3]) / _pow2(level(key) + 1)


def leaf_coordinate(x, key, axis: int, domain) -> Column:
    """(x - a) 2^(l+1) / w - (2i + 1), in that order."""
    return (_c(x) - F.lit(domain[axis])) * _pow2(level(key) + 1) / F.lit(domain[3]) - (index(key, axis) * 2 + 1)


def unit_point(x, axis: int, domain) -> Column:
    """A coordinate mapped to [0, 1] of the domain."""
    return (_c(x) - F.lit(domain[axis])) / F.lit(domain[axis + 3])


def from_unit(u, axis: int, domain) -> Column:
    return _c(u) * F.lit(domain[axis + 3]) + F.lit(domain[axis])


def corners(key, domain) -> Column:
    """The eight corners (structs x, y, z) of a box, x slowest."""
    b = box(key, domain)
    return _let(b, lambda v: F.array(*[F.struct((v["x"] + i * v["wx"]).alias("x"), (v["y"] + j * v["wy"]).alias("y"), (v["z"] + k * v["wz"]).alias("z")) for i in (0, 1) for j in (0, 1) for k in (0, 1)]))


def contains(key, x, y, z, domain) -> Column:
    """Whether the box holds the point: by the point's own key on the box's level."""
    return F.coalesce(ancestor(point_key(x, y, z, domain), level(key)) == _c(key), F.lit(False))


def integer_centre(key, axis: int) -> Column:
    """The centre's coordinate in half-widths of the finest box: an odd multiple of 2^(16 - level)."""
    return (index(key, axis) * 2 + 1) * _pow2(F.lit(DEPTH) - level(key))


def relative_centre(key, other, axis: int) -> Column:
    """The other box's centre seen from the first one's, in the first one's half-widths; exact."""
    return (integer_centre(other, axis) - integer_centre(key, axis)) / _pow2(F.lit(DEPTH) - level(key))

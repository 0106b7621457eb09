"""Vectorised word hashes over Arrow string buffers: no Python object per word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators: every ASCII character but letters and digits.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[65:91] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The low bytes of an 8-byte block.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words are hashed by blocks of 8 bytes up to this length; BLAKE2 takes longer ones.
BY_BLOCKS = 64
#: Bytes of text hashed at once; a few arrays of 8 bytes a word stand beside it.
CHUNK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def spans(buf: np.ndarray, at: np.ndarray, sep: np.ndarray):
    """Chunks (lo, hi) of about CHUNK bytes that end at a separator or a text's end."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n:
            cut = np.flatnonzero(sep[buf[hi : hi + 4096]])
            end = at[np.searchsorted(at, hi)]  # the next text's start, hi itself included
            stop = min(end, hi + cut[0] if len(cut) else n)
            if stop <= hi + 4096 or stop == end:
                hi = int(stop)
                break
            hi += 4096
        yield lo, hi
        lo = hi


def _hash(part: np.ndarray, blocks: np.ndarray, starts: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words at starts: each block is mixed into the hash of those before it, the length goes first."""
    h = mix(blocks[starts] & _LOW[np.minimum(length, 8)] ^ mix(length.astype(np.uint64) + np.uint64(seed * int(_BASE) & (1 << 64) - 1)))
    on = np.flatnonzero(length > 8)
    for at in range(8, BY_BLOCKS, 8):
        if not len(on):
            break
        h[on] = mix(h[on] * _BASE ^ blocks[starts[on] + at] & _LOW[np.minimum(length[on] - at, 8)])
        on = on[length[on] > at + 8]
    for i in on.tolist():
        word = part[starts[i] : starts[i] + length[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=seed.to_bytes(8)).digest(), "little")
    return h


def word_hashes(buf: np.ndarray, at: np.ndarray, sep: np.ndarray, prefixes: tuple[int, ...] = (), cut: np.ndarray | None = None, seeds: tuple[int, ...] = (1,)) -> tuple:
    """64-bit hashes of all words (an array for each seed, the first by itself); where each text's words begin; hashes of the words' first bytes.

    buf is lower-cased already. A prefix (of 7 bytes at most) has hash 0 for words not
    longer than it. cut marks bytes at which a word begins besides those after
    separators. With several seeds the hashes come as a list.
    """
    out, begun, pre = [[] for _ in seeds], [], [[] for _ in prefixes]
    for lo, hi in spans(buf, at, sep):
        part = buf[lo:hi]
        word = ~sep[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        first[inner] |= word[inner]
        if cut is not None:
            first |= cut[lo:hi]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        length = np.add.reduceat(word, starts, dtype=np.int64)
        blocks = np.ndarray(len(part), "<u8", np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))
        for into, seed in zip(out, seeds, strict=True):
            into.append(_hash(part, blocks, starts, length, seed))
        if prefixes:
            head = blocks[starts]
            for into, k in zip(pre, prefixes, strict=True):
                h = mix(head & _LOW[k] ^ mix(np.array([k], np.uint64) + _BASE))
                h[length <= k] = 0
                into.append(h)
        begun.append(starts + lo)
    if not begun:
        none = [np.zeros(0, np.uint64) for _ in seeds]
        return none[0] if len(seeds) == 1 else none, np.zeros(len(at), np.int64), [np.zeros(0, np.uint64) for _ in prefixes]
    where = np.concatenate(begun)
    all_ = [np.concatenate(x) for x in out]
    return all_[0] if len(seeds) == 1 else all_, np.searchsorted(where, at), [np.concatenate(x) for x in pre]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of all words as one run if there are fewer."""
    if not len(words):
        return words
    k, n = min(k, len(words)), len(words) - min(k, len(words)) + 1
    h = np.full(n, np.uint64(k))
    for i in range(k):
        h = mix(h * _BASE + words[i : i + n])
    return np.unique(h)

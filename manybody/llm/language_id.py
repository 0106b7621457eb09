"""Language identification in two steps: the family, then one-versus-one linear SVMs within it.

Features are hashed character 1- to 3-grams of the lower-cased text (all that is
no letter counts as a space), as frequencies. A classifier is a column of
weights, so a text's scores are sums of table entries over its whole length.

Classifiers only tell the learned languages apart. Whether a text resembles any of
them is its likeness: the mean over its n-grams of the log of their frequency in
the language in which they are most frequent. A quarter of the learning sample is
left out of these frequencies and sets the bound.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, table

BITS = 13
#: Characters looked at together; longer texts are summed over such pieces.
PIECE = 1 << 19
#: Language families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "af", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "uk", "bg", "sk", "sl", "hr", "sr"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _grams(texts: list[str], before: list[int] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text begins, and the feature of each character's 1-, 2- and 3-gram (-1: none).

    before: how many characters at a text's start only stand before its n-grams; they end none.
    Texts are lower-cased already.
    """
    low = texts
    at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])])
    code = np.frombuffer("".join(t + "  " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    code[~_letters()[code]] = 32
    p1, p2 = np.concatenate([[32], code[:-1]]).astype(np.uint32), np.concatenate([[32, 32], code[:-2]]).astype(np.uint32)
    none = (code == 32) & (p1 == 32)
    c, a, b = code.astype(np.uint32), p1 * np.uint32(0x9E3779B1), p2 * np.uint32(0x85EBCA77)
    out = []
    for i, h in enumerate((c, c + a, c + a + b)):
        f = (((h + np.uint32(i)) * np.uint32(0xC2B2AE3D) ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)).astype(np.int32)
        f[none | (code == 32) if i == 0 else none] = -1
        out.append(f)
    for a, b, n, t in zip(at[:-1], at[1:], before or [], low):
        whole = n >> 2 == 0  # the text goes on after this piece: the two spaces that end it stand for nothing
        for f in out:
            f[a : a + (n & 3)] = -1
            if not whole:
                f[b - 2 : b] = -1
    return at, out


def _pieces(texts: list[str | None]):
    """Lists of (text number, piece, what stands before and after it) of about PIECE characters together.

    A piece after the first begins with the two characters before it. The last number
    has these characters' count in its low two bits and 4 if the text goes on.
    """
    held, size = [], 0
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for j in range(0, len(t), PIECE):
            back = min(j, 2)
            held.append((i, t[j - back : j + PIECE], back + 4 * (j + PIECE < len(t))))
            size += len(held[-1][1])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _frequencies(batches):
    """Sparse feature frequencies of whole texts."""
    for b in batches:
        texts = b.column("text").to_pylist()
        index, value = [], []
        for t in texts:
            total = np.zeros(1 << BITS)
            for held in _pieces([t]):
                for f in _grams([p for _, p, _ in held], [n for *_, n in held])[1]:
                    total += np.bincount(f[f >= 0], minlength=1 << BITS)
            at = np.flatnonzero(total)
            index.append(at.astype(np.int32))
            value.append((total[at] / max(1.0, total.sum())).astype(np.float32))
        yield pa.record_batch([b.column("lang"), pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["lang", "i", "v"])


class Rows:
    """A matrix of few numbers other than 0, as `svm` needs it; numbers are held by rows and by columns.

    The driver learns from thousands of rows of 2^BITS features, of which a text has a tenth at most.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int], other: "Rows | None" = None):
        """row is ascending, and col within a row."""
        self.row, self.col, self.value, self.shape = row.astype(np.int32, copy=False), col.astype(np.int32, copy=False), value.astype(np.float32, copy=False), shape
        self.begin = np.flatnonzero(np.diff(self.row, prepend=-1))
        self.own = self.row[self.begin]
        if other is None:
            order = np.argsort(self.col, kind="stable")
            other = Rows(self.col[order], self.row[order], self.value[order], shape[::-1], self)
        self.T = other

    def __len__(self) -> int:
        return self.shape[0]

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.zeros(self.shape, dtype or np.float32)
        out[self.row, self.col] = self.value
        return out

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0], v.dtype)
        if len(self.begin):
            out[self.own] = np.add.reduceat(self.value * v[self.col], self.begin)
        return out

    def take(self, rows: np.ndarray) -> "Rows":
        """Some rows, in ascending order."""
        place = np.full(self.shape[0], -1, np.int32)
        place[np.sort(rows)] = np.arange(len(rows))
        on = place[self.row] >= 0
        return Rows(place[self.row[on]], self.col[on], self.value[on], (len(rows), self.shape[1]))

    def scaled(self, by: np.ndarray) -> "Rows":
        """Columns multiplied by numbers."""
        return Rows(self.row, self.col, self.value * by[self.col], self.shape)

    def mean(self) -> np.ndarray:
        """Of each column."""
        return np.bincount(self.col, self.value, minlength=self.shape[1]) / max(1, self.shape[0])


def svm(x: "np.ndarray | Rows", y: np.ndarray, c: float = 100.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is +1 or -1, classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    step = 1.0 / (2 * c * (top + 1.0) + 1.0)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    for k in range(rounds):
        m = k / (k + 3)
        qw, qb = w + m * (w - pw), b + m * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ qw + qb)) * y * weight
        pw, pb = w, b
        w, b = qw - step * (qw - 2 * c * (x.T @ slack)), qb + step * 2 * c * float(slack.sum())
    return w, b


class LanguageModel:
    """weights: a row per feature and a column per classifier (families one-versus-rest, then pairs).

    like: a feature's log frequency (None if too few texts were seen); a text's mean of it is at least ``least``,
    less SHORT_MAY / sqrt(n) for n n-grams, or the text resembles no language.
    """

    def __init__(self, families: list[str], members: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray, like: np.ndarray | None = None, least: float = 0.0):
        self.families, self.members, self.pairs, self.weights, self.bias, self.like, self.least = families, members, pairs, weights, bias, like, least

    def margins(self, texts: list[str | None], known_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The classifiers' margins, and whether each text resembles a language (without known_only it is not looked at)."""
        total, grams = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        alike, known_only = np.zeros(len(texts)), known_only and self.like is not None
        like = np.append(self.like, 0.0) if known_only else None
        for held in _pieces(texts):
            at, features = _grams([p for _, p, _ in held], [n for *_, n in held])
            doc = [i for i, *_ in held]
            for f in features:
                np.add.at(grams, doc, np.add.reduceat((f >= 0).astype(np.int64), at[:-1]))
                for c in range(total.shape[1]):
                    np.add.at(total[:, c], doc, np.add.reduceat(self.padded[c][f], at[:-1]))
                if known_only:
                    np.add.at(alike, doc, np.add.reduceat(like[f], at[:-1]))
        n = np.maximum(1, grams)
        return total / n[:, None] + self.bias, alike / n >= self.least - SHORT_MAY / np.sqrt(n) if known_only else np.ones(len(texts), bool)

    @property
    def padded(self) -> list[np.ndarray]:
        if not hasattr(self, "_padded"):
            self._padded = [np.append(self.weights[:, c], 0.0) for c in range(self.weights.shape[1])]
        return self._padded

    def predict(self, texts: list[str | None], known_only: bool = False) -> tuple[list[str], list[float]]:
        m, known = self.margins(texts, known_only)
        langs, scores = [], []
        for t, row, near in zip(texts, m, known, strict=True):
            if not self.families or not near or not has_letter(t):
                langs.append("und")
                scores.append(0.0)
                continue
            sure = 1 / (1 + np.exp(-4 * np.clip(row, -9, 9)))
            nf = len(self.families)
            best = int(np.argmax(row[:nf])) if nf > 1 else 0
            score = float(sure[best]) if nf > 1 else 1.0
            own = self.members[self.families[best]]
            votes = {lang: [0, 0.0] for lang in own}
            for c, (a, b) in enumerate(self.pairs, nf if nf > 1 else 0):
                if a in votes:
                    for lang, p, x in ((a, sure[c], row[c]), (b, 1 - sure[c], -row[c])):
                        votes[lang][0] += x > 0
                        votes[lang][1] += float(p)
            lang = max(sorted(own), key=lambda k: votes[k])
            langs.append(lang)
            scores.append(score * (votes[lang][1] / (len(own) - 1) if len(own) > 1 else 1.0))
        return langs, scores


#: The bound of likeness lies so many times as far below the held-out texts' median as their 1 % quantile does, which
#: counts as LEAST_SPREAD at least; fewer held-out texts than LEAST_HELD set no bound, and short texts may vary more.
SPREADS, LEAST_SPREAD, LEAST_HELD, SHORT_MAY = 4, 0.25, 8, 8.0


def likeness(x: "Rows", lang: np.ndarray, once: np.ndarray) -> tuple[np.ndarray | None, float]:
    """Log frequencies (relative to even ones) of features in rows x of texts' frequencies, and the bound of their mean; once: rows without repeats."""
    held = np.concatenate([once[lang[once] == k][3::4] for k in np.unique(lang)])
    if len(held) < LEAST_HELD:
        return None, 0.0
    used = np.setdiff1d(once, held)
    best = np.max([x.take(used[lang[used] == k]).mean() for k in np.unique(lang[used])], axis=0)
    like = np.log(np.maximum(best * len(best), 1e-3))
    at = x.take(held) @ like
    middle, low = np.quantile(at, [0.5, 0.01])
    return like, float(middle - SPREADS * max(middle - low, LEAST_SPREAD))


def _matrix(got: pa.Table) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Rows of texts' frequencies in an order that doesn't depend on arrival, their languages, and the rows that repeat none of their language."""
    lang, i, v = got.column("lang").to_pylist(), got.column("i").combine_chunks(), got.column("v").combine_chunks()
    at, n = i.offsets.to_numpy(), np.diff(i.offsets.to_numpy())
    index, value = i.values.to_numpy(), v.values.to_numpy()
    digest = [hashlib.blake2b(index[lo : lo + k].tobytes() + value[lo : lo + k].tobytes(), digest_size=16).digest() for lo, k in zip(at.tolist(), n.tolist())]
    order = sorted(range(len(lang)), key=lambda r: (lang[r], digest[r]))
    once = np.array([k for k, r in enumerate(order) if k == 0 or (lang[r], digest[r]) != (lang[order[k - 1]], digest[order[k - 1]])])
    n = n[order]
    take = np.repeat(at[:-1][order] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return Rows(np.repeat(np.arange(len(n)), n), index[take], value[take], (len(n), 1 << BITS)), np.array(lang)[order], once


def fit(rows: DataFrame, per_language: int = 600) -> LanguageModel:
    """Learns from rows(text, lang): a sample of about per_language whole, different texts of each language.

    Equal texts of a language are chosen, and count, once. The sample bound is the only one; rows without language or letters teach nothing.
    """
    small_batches(rows.sparkSession)
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r[0]: r[1] for r in rows.select("lang", F.xxhash64("text", "lang").alias("h")).distinct().groupBy("lang").count().collect()}
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))]) if counts else None
    if not counts:
        return LanguageModel([], {}, [], np.zeros((1 << BITS, 0)), np.zeros(0))
    chosen = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * float(1 << 20)).select("text", "lang").distinct()
    got = chosen.mapInArrow(_frequencies, "lang string, i array<int>, v array<float>").toArrow()
    x, lang, once = _matrix(got)
    del got
    like, least = likeness(x, lang, once)
    scale = (1 / np.sqrt(x.mean() + 1e-6)).astype(np.float32)
    x = x.scaled(scale)
    langs = sorted(set(lang))
    family = np.array([_FAMILY.get(k, k) for k in lang])
    families = sorted(set(family))
    members = {f: [k for k in langs if _FAMILY.get(k, k) == f] for f in families}
    fits = [svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in families] if len(families) > 1 else []
    pairs = [p for f in families for p in itertools.combinations(members[f], 2)]
    for a, b in pairs:
        at = np.flatnonzero((lang == a) | (lang == b))
        fits.append(svm(x.take(at), np.where(lang[at] == a, 1, -1).astype(np.float32)))
    weights = np.stack([w * scale for w, _ in fits], axis=1).astype(np.float64) if fits else np.zeros((1 << BITS, 0))
    return LanguageModel(families, members, pairs, weights, np.array([b for _, b in fits]), like, least)


def identify(docs: DataFrame, model: LanguageModel, known_only: bool = False, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score added (or replaced); und and 0 where the text is null or has no letter.

    known_only: also where it resembles none of the learned languages. Repeated rows stay.
    """
    small_batches(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    names = [c for c in docs.columns if c not in (pred, score)]
    docs = docs.select(*[f"`{c}`" for c in names])
    schema = StructType([*docs.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])

    def run(batches):
        for b in batches:
            lang, sure = model.predict(b.column("text").to_pylist(), known_only)
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=[*names, pred, score])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """crc32(doc_id as text) mod 5 is 0; rows without doc_id are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents without letters or that resemble none of the learned languages; the columns stay."""
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    pred, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    kept = identify(docs, model, True, pred, score).where(F.col(pred) != "und")
    return kept.select(*[f"`{c}`" for c in docs.columns])

import io
import random
import zlib

import numpy as np
import pyarrow as pa

import public_tokenizers
from manybody.llm import sstable as st


def test_reader_and_lookup():
    rng, out = np.random.default_rng(1), io.BytesIO()
    w = st.Writer(out)
    rows = sorted([(None, 3), (-5, 0), (-5, 2), (0, 70000)] + [(int(i), int(n)) for i, n in zip(rng.choice(10**6, 3000, False), rng.integers(0, 90, 3000))], key=lambda x: st.key_of(x[0]))
    want = [(i, rng.integers(0, 49408, n).astype("<u4")) for i, n in rows]
    for i, ids in want:
        w.add(st.key_of(i), ids)
    w.close()
    r = st.Reader(out)
    got = [(st.doc_of(k), ids) for k, _, ids in r]
    assert len(r.index) > 3 and [g[0] for g in got] == [x[0] for x in want] and all((a[1] == b[1]).all() for a, b in zip(got, want))
    assert len(r.get(-5)) == 2 and len(r.get(None)[0]) == 3 and (r.get(want[99][0])[0] == want[99][1]).all()
    absent = [i for i in range(2000) if i not in {x[0] for x in want}]
    assert all(r.get(i) == [] for i in absent)


def test_query(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, f"Word{i % 7} the\nQuick\tbrown  <|endoftext|> é don't 12 #" * (i % 5)) for i in range(300, -300, -3)] + [(7, None), (7, "twice"), (None, "nobody"), (10**15, "x " * 50_000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS v", "2 AS start").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, st.op2_token_shards(spark, str(tmp_path)).collect()), key=lambda x: x[1])
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {t: np.array(own.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows}
    want = sorted(((i, ids[t]) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    at, out = 0, []
    for i, x in want:
        out.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == out


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert st.op2_token_shards(spark, str(tmp_path)).count() == 0


def test_pieces_equal_the_library_on_hard_texts():
    """Cuts within words change nothing: apostrophes, digits, marks that compose, special tokens, control characters."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        own = st.PieceEncoder(f.read())
    assert own.inner
    rng = random.Random(3)
    letters = "abAB''--..,,01 \t\n\x0b\x0c<|endoftxEN|>()é̸́=İK中ς\u0085\x00\x1c"
    words = ["<|endoftext|>", "don't", "it'S", "rock'n'roll", "x''s", "5's", "<|ENDOFTEXT|>"]
    docs = ["".join(rng.choice(words) if rng.random() < 0.1 else rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for part in ([], [None, ""], docs, docs[::-1]):
        flat, at = own.encode(pa.array(part, pa.string()))
        want = [own.own.encode(d or "", add_special_tokens=False).ids for d in part]
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_capitals_that_compose_only_when_small():
    """Capitals without a precomposed form, followed by a mark that their small letter composes with."""
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        own = st.PieceEncoder(f.read())
    pairs = ["H\u0331", "J\u030c", "T\u0308", "W\u030a", "Y\u030a"]
    rng = random.Random(5)
    docs = ["H\u0331anan", "J\u030cami", *pairs] + ["".join(rng.choice([*pairs, *"aHJTWY ,1'-", "é", "\u0331"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    flat, at = own.encode(pa.array(docs, pa.string()))
    want = [own.own.encode(d, add_special_tokens=False).ids for d in docs]
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def _encoder():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return st.PieceEncoder(f.read())


def test_pieces_that_collide_in_polynomial_hashes():
    x = "".join("a" if bin(i).count("1") % 2 == 0 else "b" for i in range(2048))
    docs = [x, x.translate(str.maketrans("ab", "ba")), x[:1024], x[1024:]]
    own = _encoder()
    flat, at = own.encode(pa.array(docs))
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [own.own.encode(d, add_special_tokens=False).ids for d in docs]


def test_pieces_with_one_first_hash(monkeypatch):
    """If all first hashes are one, the second ones still tell the pieces apart."""
    hashes = st.tb.word_hashes
    monkeypatch.setattr(st.tb, "word_hashes", lambda *a, **k: ((lambda h, *rest: ([h[0] * 0, h[1]], *rest))(*hashes(*a, **k))))
    own, docs = _encoder(), ["some words, some", "others", None, "words again"]
    for _ in range(2):
        flat, at = own.encode(pa.array(docs, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [own.own.encode(d or "", add_special_tokens=False).ids for d in docs]

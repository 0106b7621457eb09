import hashlib
import random

import public_tokenizers as P
import tiktoken
from manybody.llm import bpe_sql as b

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def test_against_tiktoken_and_round_trip(spark):
    with open(PATH, "rb") as f:
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.read_ranks(f.read()), special_tokens={})
    r = random.Random(2)
    texts = [None, "", " ", "\n\n  x  \n", "it's we'LL <|endoftext|>", "a" * 3000, "ab" * 200 + "$" * 500, "日本語 ñandú 😀" * 9, "word " * 20_000]
    texts += ["".join(r.choice("abcdeghinorstu    .,'\n12éß") for _ in range(r.randrange(400))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "x", 1), (3, "again", 1)], "doc_id long, text string, n_tokens int")
    for row in b.digests(docs, PATH, P.PATTERN).where("doc_id IS NOT NULL AND doc_id <> 3").collect():
        t = texts[row.doc_id] or ""
        ids = own.encode_ordinary(t)
        assert row[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    ids = b.encode(docs, PATH, P.PATTERN)
    decoded = sorted(bytes(r.bytes) for r in b.decode(ids, PATH).collect())
    assert decoded == sorted([(t or "").encode() for t in texts] + [b"x", b"again"])
    assert b.encode(docs.where("false"), PATH, P.PATTERN).count() == 0


def test_repeats_are_encoded_once(spark):
    """With small caches equal texts of a batch go through the codec once, and the results are the same."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", "one two", None, "", None, "three", "one two"])], "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, b.digests(docs, PATH, P.PATTERN, small=True).collect())) == sorted(map(tuple, b.digests(docs, PATH, P.PATTERN).collect()))


def test_long_pieces():
    """Pieces up to 100 KB without a place to cut: random letters, runs, and tokens cut short, which restart merges late."""
    with open(PATH, "rb") as f:
        codec = b.Codec(f.read(), P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(1)
    vocab = sorted(t.decode() for t in codec.ranks if t.isalpha() and t.isascii())
    texts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (66, 67, 68, 133, 700, 12_000)]
    texts += [x * n for x in ("a", "ab", "tion", "the", "-", " ") for n in (67, 1001)] + ["e" * 100_000, "ing" * 33_333]
    texts += ["".join(t[: r.randint(1, len(t))] for t in r.choices(vocab, k=n)) for n in (20, 40, 80, 1500) for _ in range(8)]
    got = [b._ids(x) for x in codec.encode(texts)]
    assert [x.tolist() for x in got] == [own.encode_ordinary(t) for t in texts]
    assert codec.decode(got) == [t.encode() for t in texts]


def test_integer_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id int, text string")
    assert sorted(map(str, ((r.doc_id, r.n_tokens) for r in b.digests(docs, PATH, P.PATTERN).collect()))) == ["(1, 1)", "(None, 0)"]
    assert {r.bytes for r in b.decode(b.encode(docs, PATH, P.PATTERN), PATH).collect()} == {b"a", b""}
    assert b.stage_bpe(spark, docs.where("false"), "").count() == 0

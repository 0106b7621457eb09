import random
import re

from manybody.llm import ngram_join as nj
from manybody.llm.ngram_join import jaccard_components


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k_ = min(k, len(w))
        sets[i] = {tuple(w[j : j + k_]) for j in range(len(w) - k_ + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(sets[i]), find(i)) for i in ids}


def corpus(seed=3, n=260):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, base = [], [[r.choice(vocab) for _ in range(r.choice([1, 2, 4, 9, 20, 60, 150, 400]))] for _ in range(25)]
    shared = [r.choice(vocab) for _ in range(70)]
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9]) * len(w) // 60 + r.choice([0, 0, 1])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w += shared
        rows.append((i, " ".join(w).upper() if r.random() < 0.1 else "  ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "x" * 5000)]


def test_brute_force(spark):
    for k, num, den in ((3, 90, 100), (5, 80, 100)):
        rows = corpus()
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()
        assert {tuple(x) for x in got} == brute(rows, k, num, den) and len(got) == len(rows)


def test_empty_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id long, text string, n int, key string, h1 string, comp int"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c", 1, "k", "h", 0), (1, "a b c", 1, "k", "h", 0), (1, "d e f", None, None, None, None), (2, "d e f", 1, "k", "h", 0), (None, "a b c", 1, "k", "h", 0)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, None)]


def links_by_brute_force(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        k_ = min(k, len(w))
        sets.append({tuple(w[j : j + k_]) for j in range(len(w) - k_ + 1)} if w else set())
    on = [i is not None and bool(s) for (i, _), s in zip(rows, sets)]
    return [sum(on[x] and on[y] and x != y and den * len(a & b) >= num * len(a | b) for y, b in enumerate(sets)) for x, a in enumerate(sets)]


def test_all_links_are_counted(spark, monkeypatch):
    """In groups of near copies, with exact copies, a repeated doc_id and components of several blocks."""
    rows = corpus(5, 150)
    r = random.Random(8)
    base = [f"v{i}" for i in range(300)]
    for i in range(60):
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(300)] = f"u{r.randrange(5)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(None, " ".join(base)), (2000, " ".join(base)), (2000, " ".join(base))]
    for spread in (256, 9):
        monkeypatch.setattr(nj, "SPREAD", spread)
        got = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
        assert sorted(((str(x.doc_id), x.n_links) for x in got)) == sorted((str(i), c) for (i, _), c in zip(rows, links_by_brute_force(rows, 3, 90, 100)))


def test_the_query_counts_links(spark, tmp_path):
    spark.createDataFrame([(i, "a b c d") for i in range(3)] + [(9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, nj.op10_ngram_jaccard_join(spark, str(tmp_path)).collect())) == [(0, 2, 2, 0), (1, 2, 2, 0), (2, 2, 2, 0), (9, 0, 0, 9)]


def test_links_whose_buckets_have_an_unlike_centre(spark):
    """The first two texts share only segments that the third, the centre of their buckets, has too."""
    texts = ["w2331 w258 w1044 w482 w2029 w1841 w1934 w2668 w1554", "w2331 w859 w1044 w482 w2029 w1841 w1934 w2668 w1554", "w2331 w482 w1554 w1596 w1772 w8 w937 w2421 w1300"]
    ids = [r.id for r in spark.range(3).selectExpr("id", "xxhash64(id) AS x").orderBy("x").collect()]
    rows = list(zip([*ids[1:], ids[0]], texts))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80, 100).collect()
    assert {tuple(x) for x in got} == brute(rows, 1, 80, 100) and len({x.component_id for x in got}) == 2


def test_repeats_of_which_one_is_a_copy(spark):
    """A doc_id with two texts, one of them a copy of another document: the other text's links stay."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(3, a), (5, a), (5, b), (9, b + " c"), (7, a + " c"), (7, "d e f"), (8, "d e f")]
    got = nj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {x.component_id for x in got} == {3}
    want = sorted((str(i), c) for (i, _), c in zip(rows, links_by_brute_force(rows, 3, 90, 100)))
    assert sorted((str(x.doc_id), x.n_links) for x in got) == want


def thue_morse(n, a, b):
    x = "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    return x, "".join(a if c == b else b for c in x)


def test_words_that_collide_in_polynomial_hashes(spark):
    rows = [(i * 10 + j, t) for i, n in enumerate((1024, 2048)) for j, t in enumerate(thue_morse(n, "a", "b"))]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, 1, i) for i, _ in rows)


def test_a_large_group_of_near_copies_below_and_above_the_threshold(spark, monkeypatch):
    """2,000 copies of which no two of the first half link, in one and in many blocks, hot keys included."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(2000):
        w = list(base)
        for j in r.sample(range(200), 9 if i < 1000 else 1):
            w[j] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for block, seen in ((2000, 16), (300, 2)):
        monkeypatch.setattr(nj, "BLOCK", block)
        monkeypatch.setattr(nj, "HOT_SEEN", seen)
        got = {tuple(x) for x in jaccard_components(docs).collect()}
        want = want or brute(rows, 5, 80, 100)
        assert got == want


def test_the_stage_keeps_different_texts_of_a_doc_id(spark):
    rows = [(1, "a b c", "x"), (1, "d e f", "y"), (1, "d e f", "a"), (2, "a b c", "z"), (3, None, None), (3, None, None)]
    got = nj.stage_ngram_join(spark, spark.createDataFrame(rows, "doc_id long, text string, n string"), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a b c", "x"), (1, "d e f", "a"), (3, None, None)]))

import random
import re

from manybody.llm import license_scan as ls
from pyspark.sql import functions as F


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    form = " " + " ".join(words) + " "
    found = []
    for r in ls.rules():
        for m in re.finditer(r["re"], form):
            s = form[: m.start()].count(" ") - 1
            found.append((s, s + m[0].count(" ") + 1, r["p"], r["label"], r["base"], r["id"]))
    kept = []
    for d in found:
        inside = [e for e in found if e[0] <= d[0] and e[1] >= d[1] and e is not d]
        beaten = any(e[2] < d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or (e[0], e[1]) == (d[0], d[1]) and e[5] < d[5]) for e in inside)
        if d[4] or not beaten:
            kept.append(d)
    base = []
    for phrase, label in ls.BASE.items():
        p = phrase.split()
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(kept), sorted(base)


TEXTS = [
    None, "", "  ", "no words here", "Licensed under the MIT License.", "under the mit license under the MIT license", "CC BY-NC CC-BY-NC 4.0 cc by nc",
    "Apache License, Version 2.0", "Licensed under the Apache License version 2", "SPDX-License-Identifier: GPL-3.0 and LGPL 2.1 licence", "placed in the public domain",
    "é under the mit license é", "under the mit licenses", "xunder the mit license", "Copyright (c) 2020 Some One. All rights reserved.", "licensed under the terms of the GNU General Public License v3 license",
    "(c) " * 50 + "under the MIT license " * 40 + "word " * 3000 + "Licensed under CC BY-NC 4.0.",
]


def test_brute_force(spark):
    r = random.Random(1)
    bits = [w for t in TEXTS if t for w in t.split()[:12]]
    texts = TEXTS + [" ".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in ls.scan(docs).collect():
        n, kept, base = brute(texts[row.doc_id])
        assert row.n_words == n, row
        assert sorted(tuple(x) for x in row.licenses) == kept, texts[row.doc_id]
        assert sorted((x.s, x.label) for x in row.licenses if x.base) == base


def test_rules_hold_their_keyword_and_a_root(spark):
    assert len(ls.rules()) > 250
    docs = spark.createDataFrame([(1, "under the mit license", "w")] * 2, "doc_id long, text string, n_words string")
    assert ls.scan(docs).select(F.sum("n_words")).first()[0] == 8
    assert ls.scan(docs.where("false")).count() == 0


def test_query_over_nulls(spark, tmp_path):
    spark.createDataFrame([(1, None), (None, "cc by nc"), (1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(x)[1:7] for x in ls.op3_license_scan(spark, str(tmp_path)).collect()}
    assert got == {(0, 0, None, None, "", ""), (3, 1, 0, 0, "cc-by-nc", "cc-by-nc"), (1, 0, None, None, "", "")}


def test_many_matches_in_one_text(spark):
    """A text that names a license 20,000 times is scanned in time that its length asks for."""
    n = 20_000
    docs = spark.createDataFrame([(1, "under the MIT license, " * n), (2, "x " * n + "cc by nc")], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.scan(docs).selectExpr("doc_id", "n_words", "size(filter(licenses, x -> x.base)) AS b", "licenses[0].s AS s", "licenses[size(licenses) - 1].e AS e").collect()}
    assert got[1][1:] == (4 * n, n, 0, 4 * n) and got[2].b == 1 and got[2].e == n + 3


def sampled(tree, r):
    """A random text that a parsed expression matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "NOT_LITERAL":
            out += r.choice("abc")
        elif name == "IN":
            kind, v = arg[0]
            chars = "abc" if str(kind) == "NEGATE" else [chr(x[1]) if str(x[0]) == "LITERAL" else chr(r.randint(*x[1])) for x in arg]
            out += r.choice(chars)
        elif name == "MAX_REPEAT" or name == "MIN_REPEAT":
            out += "".join(sampled(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 3))))
        elif name == "SUBPATTERN":
            out += sampled(arg[-1], r)
        elif name == "BRANCH":
            out += sampled(r.choice(arg[1]), r)
        elif name in ("ASSERT", "ASSERT_NOT", "AT"):
            pass
        else:
            raise ValueError(name)
    return out


def test_every_match_passes_the_prefilters():
    """Texts made from each expression hold one of its keywords and one of the roots."""
    import re._parser as parser

    r = random.Random(7)
    for rule in ls.rules():
        tree = parser.parse(rule["re"])
        for _ in range(40):
            text = f" {sampled(tree, r)} "
            if not re.search(rule["re"], text):
                continue  # an alternative that ends at a space of its own
            assert any(k in text for k in rule["kw"]), (rule, text)
            assert any(k in text for k in ls.ROOTS), (rule, text)


NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)": "mit",
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": "gpl-2-linux-syscall",
    "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2+",
    "GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "agpl-3+",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-3-clause",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Distributed under the Boost Software License, Version 1.0.": "boost-1",
    "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4",
    "This work is under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "The Software shall be used for Good, not Evil.": "json",
    "we walked along the river and spoke of the weather": "",
}


def test_notices_of_known_licenses(spark):
    docs = spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")
    got = {r.text: set(r.labels) for r in ls.scan(docs).selectExpr("text", "transform(licenses, x -> x.label) AS labels").collect()}
    for text, labels in NOTICES.items():
        assert set(filter(None, labels.split(","))) <= got[text] and bool(labels) == bool(got[text]), (text, got[text])

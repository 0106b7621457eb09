import random

from manybody.llm import warc_revisit as w
from pyspark.sql import functions as F

SCHEMA = "record_id long, kind string, url string, time long, etag string, modified string, digest string, headers map<string,string>, slice int, f string"


def test_against_brute_force_with_a_hot_url(spark):
    r = random.Random(5)
    urls = ["http://WWW.a.org/x/?utm_source=1#f"] * 5 + ["a.org:443/x", "https://b.org/?q=1&ref=2", "c.org/y?b=1", None]
    rows = []
    for i in range(700):
        kind = r.choice(["response", "response", "revisit", "request"])
        rows.append((i, kind, r.choice(urls), r.choice([None] + list(range(90))), r.choice([None, "1", "W/1", "2"]), r.choice([None, "d", "e"]), r.choice([None, "x", "y"]), r.choice([None, {"date": str(i), "server": str(i)}]), 1, "z"))
    df = spark.createDataFrame(rows, SCHEMA)
    canon = {x.record_id: x.u for x in df.select("record_id", w.canonical_url(F.col("url")).alias("u")).collect()}
    assert set(canon.values()) == {"a.org/x", "b.org?q=1", "c.org/y?b=1", None}
    got = {x.record_id: x for x in w.resolve(df).collect()}
    assert len(got) == sum(x[1] == "revisit" for x in rows)
    for x in rows:
        if x[1] != "revisit":
            continue
        c = [y for y in rows if y[1] == "response" and y[3] is not None and x[3] is not None and y[3] < x[3] and canon[y[0]] == canon[x[0]] is not None]
        f = max(c, key=lambda y: (y[3], y[0]), default=None)
        strip = lambda s: s and s.removeprefix("W/")
        want = "orphan" if not f else "unchecked" if x[4:7] == (None,) * 3 else "resolved" if (strip(x[4]) == strip(f[4]) if x[4] else x[5] == f[5] if x[5] else x[6] == f[6]) else "mismatch"
        headers = {**(f[7] or {}), **{k: v for k, v in (x[7] or {}).items() if k in w.PERMITTED}} if want == "resolved" else None
        assert (got[x[0]].found, got[x[0]].status, got[x[0]].headers) == (f and f[0], want, headers)


def test_empty_and_payloads(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert w.resolve(none).count() == 0
    df = spark.createDataFrame([(1, "response", "u", 1, "t", None, None, None, 0, ""), (2, "revisit", "u", 2, "t", None, None, None, 0, "")], SCHEMA)
    assert w.attach(w.resolve(df), spark.createDataFrame([(1, "body")], "record_id long, payload string")).first().payload == "body"


def test_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, replace(url, '/' || regexp_extract(url, '[0-9]+'), '/' || (page_id % 40)) AS url, html FROM '{d}/pages.parquet'")
    want = con.execute(w.ORACLE).fetchall()
    p = spark.read.parquet(f"{d}/pages.parquet")
    p = p.withColumn("url", F.expr("replace(url, '/' || regexp_extract(url, '[0-9]+', 0), '/' || (page_id % 40))"))
    r = w.resolve(w.records_of_pages(p))
    assert {(x.record_id // 2, x.url, x.found // 2 if x.found is not None else None, x.status) for x in r.collect()} == {x[:4] for x in want}

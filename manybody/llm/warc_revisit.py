"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit takes the latest earlier full response of the same canonical URL (an
as-of join), if its validators agree. The join is two window passes: within
(URL, time slice), then over the few slices of a URL; a URL that holds a third
of all records is thus spread over SLICES tasks. Payloads never enter a window:
the result names the response, and `attach` joins its payload by its unique id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SLICES = 64
#: The header fields that RFC 9110 (15.4.5) lets a 304 response update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name no page of their own.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a final slash, query without tracking parameters; no scheme, no fragment."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, "\\?(.*)$", 1), f"(^|&)({TRACKING})=[^&]*", ""), "^&", "")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with the response they stand for.

    records(record_id, kind, url, time, etag, modified, digest, headers): kind is
    'response' or 'revisit'; headers a map of lower-case names. Per revisit:
    record_id, url (canonical), found (record_id of the response), status, headers:
    'resolved' if the entity tag (weak comparison), or else the modification date,
    or else the digest agrees; 'mismatch' if it differs; 'unchecked' if the revisit
    carries none of them; 'orphan' without an earlier response or without url or
    time. Of responses at one time the largest record_id counts. headers are the
    response's, with the permitted fields of a resolved revisit; null if not resolved.
    Other kinds and other columns are ignored; repeated rows give repeated rows.
    """
    r = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "time", "etag", "modified", "digest", "headers").where("kind IN ('response', 'revisit')")
    bounds = r.where("time IS NOT NULL").approxQuantile("time", [i / SLICES for i in range(1, SLICES)], 0.005)
    cuts = ",".join(f"{c!r}D" for c in sorted(set(bounds)))
    r = r.withColumn("slice", F.expr(f"aggregate(array({cuts}), 0, (a, x) -> a + case when time > x then 1 else 0 end)") if cuts else F.lit(0))
    full = F.when((F.col("kind") == "response") & F.col("time").isNotNull(), F.struct("time", "record_id", "etag", "modified", "digest", F.map_entries("headers").alias("headers")))
    r = r.withColumn("full", full)
    known = r.where("url IS NOT NULL AND time IS NOT NULL")
    within = Window.partitionBy("url", "slice").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    local = known.withColumn("near", F.max("full").over(within)).where("kind = 'revisit'")
    ends = known.groupBy("url", "slice").agg(F.max("full").alias("last"))
    ends = ends.select(F.col("url").alias("u"), F.col("slice").alias("i"), F.max("last").over(Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("far"))
    both = local.drop("full").join(ends, (F.col("url") == F.col("u")) & (F.col("slice") == F.col("i")), "left").withColumn("f", F.coalesce("near", "far"))
    lost = r.where("kind = 'revisit' AND (url IS NULL OR time IS NULL)").withColumn("f", F.lit(None).cast(both.schema["f"].dataType))
    names = ["record_id", "url", "etag", "modified", "digest", "headers", "f"]
    both = both.select(*names).unionByName(lost.select(*names))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    agrees = F.when(F.col("etag").isNotNull(), F.coalesce(tag(F.col("etag")) == tag(F.col("f.etag")), F.lit(False)))
    agrees = agrees.when(F.col("modified").isNotNull(), F.coalesce(F.col("modified") == F.col("f.modified"), F.lit(False))).when(F.col("digest").isNotNull(), F.coalesce(F.col("digest") == F.col("f.digest"), F.lit(False)))
    status = F.when(F.col("f").isNull(), "orphan").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    permitted = F.array(*map(F.lit, PERMITTED))
    new = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.array_contains(permitted, k))
    old = F.map_filter(F.coalesce(F.map_from_entries("f.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(new, k))
    out = both.withColumn("status", status).withColumn("merged", F.when(F.col("status") == "resolved", F.map_concat(old, new)))
    return out.select("record_id", "url", F.col("f.record_id").alias("found"), "status", F.col("merged").alias("headers"))


def attach(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Resolved revisits with the payload (record_id, payload) of the response they stand for."""
    return resolved.where("status = 'resolved'").join(payloads.select(F.col("record_id").alias("found"), "payload"), "found", "left")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """The archive's records of a table of pages(page_id, url, html).

    Every page is a response at time 10 page_id and is asked for again at time
    10 page_id + 10007, when the server answers that nothing changed. By page_id the
    revisit has a weak tag, a foreign tag, a date only, a digest only, or nothing.
    """
    p = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest"))
    day = F.concat(F.lit("day "), (F.col("page_id") % 365).cast("string"))
    tag = F.substring("digest", 1, 16)
    case = F.pmod(F.col("page_id"), F.lit(8))
    kinds = F.explode(F.array(F.lit("response"), F.lit("revisit"))).alias("kind")
    p = p.select("page_id", "url", "digest", day.alias("day"), tag.alias("tag"), case.alias("case"), kinds)
    again = F.col("kind") == "revisit"
    etag = F.when(~again | (F.col("case") < 3), F.col("tag")).when(F.col("case") == 3, F.concat(F.lit("W/"), F.col("tag"))).when(F.col("case") == 4, F.lit("other"))
    modified = F.when(~again | F.col("case").isin(0, 1, 2, 3, 4, 5), F.col("day"))
    digest = F.when(~again | (F.col("case") != 7), F.col("digest"))
    headers = F.when(again, F.create_map(F.lit("date"), F.concat(F.lit("later "), "day"), F.lit("server"), F.lit("cache"), F.lit("vary"), F.lit("accept"))).otherwise(F.create_map(F.lit("date"), F.col("day"), F.lit("server"), F.lit("origin"), F.lit("content-type"), F.lit("text/html")))
    return p.select((F.col("page_id") * 2 + again.cast("long")).alias("record_id"), "kind", "url", (F.col("page_id") * 10 + F.when(again, 10007).otherwise(0)).alias("time"), etag.alias("etag"), modified.alias("modified"), digest.alias("digest"), headers.alias("headers"))


def op5_warc_revisit(spark, sf_dir: str) -> DataFrame:
    """Every page's revisit: page_id, url, found_page (page_id of the response), status, headers (name=value, sorted)."""
    r = resolve(records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return r.select(((F.col("record_id") - 1) / 2).cast("long").alias("page_id"), "url", (F.col("found") / 2).cast("long").alias("found_page"), "status", F.coalesce(lines, F.lit("")).alias("headers"))


ORACLE = f"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u, md5(coalesce(html, '')) AS digest,
         'day ' || (page_id % 365) AS day, ((page_id % 8) + 8) % 8 AS c
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(u, '\\?(.*)$', 1), '(^|&)({TRACKING})=[^&]*', '', 'g'), '^&', '') AS query,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '') ||
         regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS start
  FROM p
), r AS (
  SELECT page_id, digest, day, c, substr(digest, 1, 16) AS tag, page_id * 10 AS t, start || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url FROM q
), v AS (
  SELECT page_id, url, t + 10007 AS t, digest, day, c, CASE WHEN c < 4 THEN tag WHEN c = 4 THEN 'other' END AS tag FROM r
), j AS (
  SELECT v.*, f.page_id AS found, f.tag AS ftag, f.day AS fday, f.digest AS fdigest FROM v ASOF LEFT JOIN r f ON v.url = f.url AND v.t > f.t
), s AS (
  SELECT *, CASE WHEN found IS NULL THEN 'orphan' WHEN c = 7 THEN 'unchecked'
    WHEN (c < 5 AND tag = ftag) OR (c = 5 AND day = fday) OR (c = 6 AND digest = fdigest) THEN 'resolved' ELSE 'mismatch' END AS status
  FROM j
)
SELECT page_id, url, found AS found_page, status,
  CASE WHEN status = 'resolved' THEN 'content-type=text/html;date=later ' || day || ';server=origin;vary=accept' ELSE '' END AS headers
FROM s
"""

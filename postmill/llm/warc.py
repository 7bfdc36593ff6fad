"""Resolution of not-modified revisits in web archives.

A revisit record holds no body: it stands for the latest earlier full response of the same
canonical URL. An as-of join finds that response, the revisit's validators are checked against it,
and the headers that a 304 answer may update are merged into the stored ones.

The as-of join is two-level: time is cut into ``BUCKETS`` spans at quantiles of the records' times, the
last response of each (URL, span) is carried to later spans, and rows are ordered within (URL, span) only.
A URL with a third of all records is dealt over its spans, whatever stray times there are. Bodies never move; a resolved record names the response's id.

Defined results: a null url or time resolves nothing (orphan); a response of the same instant isn't
earlier; of several responses of one instant the one with the greatest id counts; equal revisits give
equal rows; an empty table gives an empty result; other columns than the named ones are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table

BUCKETS = 512
#: Headers that describe the stored body or the connection, so a 304 answer can't update them.
NOT_MERGED = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive", "proxy-authenticate", "te", "trailer", "upgrade", "set-cookie")
PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)$"


def canonical_url(url: Column) -> Column:
    """Host without www, port unless it is 80 or 443, path without a final slash, and the sorted query without tracking parameters; no fragment.

    As in web archives, a page's http and https addresses are one."""
    parts = PARTS
    host = F.regexp_replace(F.lower(F.regexp_extract(url, parts, 1)), r"^www\.", "")
    port = F.regexp_extract(url, parts, 2)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(F.regexp_extract(url, parts, 3), "/+$", "")
    args = F.filter(F.split(F.regexp_extract(url, parts, 4), "&"), lambda a: (a != "") & ~F.lower(F.substring_index(a, "=", 1)).rlike(TRACKING))
    query = F.array_join(F.array_sort(args), "&")
    return F.when(host != "", F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _validator(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(tag, "^W/", "")


def span_of(ts: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts a time has reached; cuts are counted in runs, so that few are compared."""
    if not cuts:
        return F.lit(0)
    long = math.isqrt(len(cuts)) + 1
    runs = [cuts[k : k + long] for k in range(0, len(cuts), long)]
    reached = lambda of: F.size(F.filter(of, lambda c: c <= ts))
    first = reached(F.lit([r[0] for r in runs]))
    own = F.get(F.array(*(F.lit(r) for r in runs)), first - 1)
    return F.when(first == 0, 0).otherwise((first - 1) * long + reached(own))


def resolve_revisits(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Records (id, url, ts, kind, etag, last_modified, headers) to a row for each revisit.

    ``kind`` is response or revisit. Returns id, url, ts, response_id, outcome and headers: outcome is
    resolved; mismatch (validators differ); unchecked (the revisit has none); or orphan (no earlier response).
    """
    named = records.select("id", "url", "ts", "kind", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("key")).where("kind IN ('response', 'revisit')")
    cuts = named.agg(F.percentile_approx("ts", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] if buckets > 1 else []
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull() & F.col("key").isNotNull(), F.struct("ts", "id", "etag", "last_modified", "headers"))
    placed = named.withColumn("span", span_of(F.col("ts"), sorted(set(cuts or [])))).withColumn("full", full)
    lasts = placed.groupBy("key", "span").agg(F.max_by("full", F.struct(F.col("full.ts"), F.col("full.id"))).alias("last"))
    carried = F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carries = lasts.select(F.col("key").alias("of_key"), F.col("span").alias("of_span"), carried.alias("carried")).where("carried IS NOT NULL")
    order = Window.partitionBy("key", "span").orderBy("ts", F.col("kind") == "response", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = placed.repartition("key", "span").withColumn("here", F.last("full", ignorenulls=True).over(order)).where("kind = 'revisit'")
    found = dealt.join(carries, (F.col("key") == F.col("of_key")) & (F.col("span") == F.col("of_span")), "left").withColumn("response", F.coalesce("here", "carried"))
    outcome = (
        F.when(F.col("response").isNull() | F.col("key").isNull() | F.col("ts").isNull(), "orphan")
        .when(F.col("etag").isNotNull(), F.when(_validator(F.col("etag")).eqNullSafe(_validator(F.col("response.etag"))), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull(), F.when(F.col("last_modified").eqNullSafe(F.col("response.last_modified")), "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    none = F.from_json(F.lit("{}"), "map<string,string>")
    update = F.map_filter(F.coalesce("headers", none), lambda k, _: ~F.lower(k).isin(*NOT_MERGED))
    updated = F.transform(F.map_keys(update), lambda k: F.lower(k))
    stored = F.map_filter(F.coalesce("response.headers", none), lambda k, _: ~F.array_contains(updated, F.lower(k)))
    resolved = found.withColumn("outcome", outcome)
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(stored, update)).otherwise(F.col("headers"))
    response_id = F.when(F.col("outcome").isin("resolved", "unchecked"), F.col("response.id"))
    return resolved.select("id", "url", "ts", response_id.alias("response_id"), "outcome", merged.alias("headers"))


SECTION = "^([^/]*//[^/?#]*/[^/?#]*).*$"


def page_records(pages: DataFrame) -> DataFrame:
    """Three records of each page, so that every outcome occurs: a revisit, the full response, and a later revisit.

    The id is three times the page's plus the record's place. Times are page_id * 10 and around it. Pages of even
    id stand for their host's section, ports and all, so that many responses share a canonical URL.
    """
    section = F.regexp_replace("url", SECTION, "$1")
    pages = pages.withColumn("url", F.when(F.col("page_id") % 2 == 0, section).when(F.col("page_id") % 10 == 1, F.regexp_replace("url", "^([^/]*//[^/?#:]*)", "$1:8080")).otherwise(F.col("url")))
    digest = F.md5(F.coalesce("html", F.lit("")))
    t = F.col("page_id") * 10
    head = lambda n: F.create_map(F.lit("date"), (t + n).cast("string"), F.lit("content-length"), F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("cache-control"), F.concat(F.lit("max-age="), F.lit(n)))
    none = F.lit(None)
    record = lambda n, kind, at, etag, modified: F.struct(
        (F.col("page_id") * 3 + n).alias("id"), (t + at).alias("ts"), F.lit(kind).alias("kind"), etag.cast("string").alias("etag"), modified.cast("bigint").alias("last_modified"), head(at).alias("headers")
    )
    third = F.pmod("page_id", F.lit(3))
    records = F.array(
        record(0, "revisit", -3, F.when(third == 0, digest), F.when(third == 1, t)),
        record(1, "response", 0, digest, t),
        record(2, "revisit", 5, F.when(third != 0, F.concat(F.lit("W/"), digest)), t),
    )
    return pages.select("url", F.inline(records))


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.select(F.col("id").alias("record_id"), "url", "ts", "response_id", "outcome", F.array_join(lines, ";").alias("headers"))


ORACLE_SQL = {
    "op8_revisits": rf"""
WITH u AS (SELECT page_id, html, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '{SECTION}', '\1') WHEN page_id % 10 = 1 THEN regexp_replace(url, '^([^/]*//[^/?#:]*)', '\1:8080') ELSE url END AS url FROM pages),
p AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n, page_id * 10 AS t,
    regexp_replace(lower(regexp_extract(url, '{PARTS}', 1)), '^www\.', '') AS host, regexp_replace(regexp_extract(url, '{PARTS}', 3), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '{PARTS}', 4), '&'), lambda a: a <> '' AND NOT regexp_matches(lower(string_split(a, '=')[1]), '{TRACKING}'))), '&') AS query, regexp_extract(url, '{PARTS}', 2) AS port FROM u),
k AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM p),
r AS (
  SELECT page_id * 3 AS id, url, key, t - 3 AS ts, -3 AS off, 'revisit' AS kind, CASE WHEN page_id % 3 = 0 THEN digest END AS etag, CASE WHEN page_id % 3 = 1 THEN t END AS lm, n, t FROM k UNION ALL
  SELECT page_id * 3 + 1, url, key, t, 0, 'response', digest, t, n, t FROM k UNION ALL
  SELECT page_id * 3 + 2, url, key, t + 5, 5, 'revisit', CASE WHEN page_id % 3 <> 0 THEN 'W/' || digest END, t, n, t FROM k),
f AS (SELECT id, key, ts, etag, lm, n FROM r WHERE kind = 'response'),
j AS (SELECT v.*, f.id AS fid, f.etag AS fetag, f.lm AS flm, f.n AS fn FROM (SELECT * FROM r WHERE kind = 'revisit') v ASOF LEFT JOIN f ON v.key = f.key AND v.ts > f.ts),
o AS (SELECT *, CASE WHEN fid IS NULL THEN 'orphan'
  WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = fetag THEN 'resolved' ELSE 'mismatch' END
  WHEN lm IS NOT NULL THEN CASE WHEN lm = flm THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS outcome FROM j)
SELECT id AS record_id, url, ts, CASE WHEN outcome IN ('resolved', 'unchecked') THEN fid END AS response_id, outcome,
  'cache-control=max-age=' || off || ';content-length=' || CASE WHEN outcome = 'resolved' THEN fn ELSE n END || ';date=' || ts AS headers FROM o"""
}
QUERIES = {"op8_revisits": op8_revisits}

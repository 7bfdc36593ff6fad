"""URL filters as a temporal list join.

Dated list entries (add, remove) become validity intervals: from an entry to the next one of the
same list, policy and pattern. Every capture is looked up under its host, the host's parent domains and its path's
prefixes, and an as-of join keeps entries that were active when the capture was fetched. An active
entry of an allow list wins over block lists.

No key is longer or deeper than the list's longest and deepest pattern, so long paths give few keys.

Lists are broadcast only up to ``MAX_BROADCAST_ROWS`` intervals, counted first; beyond it they join by
shuffle, where AQE splits hot patterns. A capture's keys lie in one task, so its matches are reduced
there before anything moves.

Defined results: a null url or one without a host matches nothing; a null fetch time matches
nothing; entries with a null pattern or date are ignored; of entries with equal dates, removals come
last; equal captures give equal rows; empty tables give empty results or no matches; the verdict's
columns replace columns of ``captures`` of the same name, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table

MAX_BROADCAST_ROWS = 200_000
ENTRIES = "list string, policy string, pattern string, action string, dated bigint"
START, STEP = 1_704_067_200, 3600
#: List entries for the query; dates in hours after START. Entries of ``page_entries`` come on top.
LIST = (
    ("spam", "block", "spam-farm.example.org", "add", 24), ("spam", "block", "Spam-Farm.example.org", "remove", 4000), ("spam", "block", "spam-farm.example.org", "add", 9000),
    ("pharmacy", "block", "cheap-pills.example.com", "add", 0), ("pharmacy", "block", "www.cheap-pills.example.com", "remove", 10),
    ("gambling", "block", "casino-win.example.com", "add", 100), ("gambling", "block", "casino-win.example.com", "add", 200), ("gambling", "block", "casino-win.example.com", "remove", 1500),
    ("review", "block", "example.net/de", "add", 50), ("review", "block", "blog.tionsh.example.net/en", "add", 12), ("review", "block", "blog.tionsh.example.net/en", "remove", 600),
    ("trusted", "allow", "tionsh.example.net/fr", "add", 0), ("trusted", "allow", "M.Example.com", "add", 0), ("trusted", "allow", "cheap-pills.example.com/es", "add", 300),
)
_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, policy, pattern, since, before): when each entry is active; ``before`` is null while it still is."""
    order = Window.partitionBy("list", "policy", "pattern").orderBy("dated", "action")  # add before remove
    host = F.lower(F.regexp_extract("pattern", "^[^/]*", 0))  # paths are told apart by case, as in lookup_keys
    entries = entries.withColumn("pattern", F.concat(host, F.regexp_extract("pattern", "(?s)^[^/]*(.*)", 1)))
    dated = entries.where("pattern IS NOT NULL AND dated IS NOT NULL").withColumn("before", F.lead("dated").over(order))
    active = dated.where((F.col("action") == "add") & (F.col("before").isNull() | (F.col("before") > F.col("dated"))))
    return active.select("list", "policy", "pattern", F.col("dated").alias("since"), "before")


def lookup_keys(url: Column, labels_most: int, depth: int, longest: int) -> Column:
    """The host and its parents, each alone and with every prefix of the path, by whole segments: those of at most
    ``labels_most`` labels, ``depth`` segments and ``longest`` characters."""
    host = F.lower(F.regexp_extract(url, _REST, 1))
    path = F.slice(F.split(F.regexp_replace(F.regexp_extract(url, _REST, 2), "^/+|/+$", ""), "/+"), 1, max(1, depth))
    labels = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - labels_most + 1)
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = lambda n: F.array_join(F.slice(path, F.lit(1), n), "/")
    short = lambda n: F.when(n == 0, "").otherwise(F.concat(F.lit("/"), segment(n)))
    prefixes = F.filter(F.transform(F.sequence(F.lit(0), F.least(F.size(path), F.lit(depth))), short), lambda p: F.length(p) <= longest)
    keys = F.flatten(F.transform(domains, lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))
    return F.when(host != "", F.array_distinct(F.filter(keys, lambda k: F.length(k) <= longest)))


def filter_captures(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched_at: str = "fetched_at", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``captures`` with n_active, blocked, lists and patterns of the entries active at the fetch."""
    new = ("n_active", "blocked", "lists", "patterns")
    rows = captures.drop(*new)
    lists = intervals(entries)
    dots = F.regexp_count(F.regexp_extract("pattern", "^[^/]*", 0), F.lit(r"\."))
    slashes = F.regexp_count("pattern", F.lit("/"))
    n, labels_most, depth, longest = lists.agg(F.count("*"), F.max(dots) + 1, F.max(slashes), F.max(F.length("pattern"))).first()
    if n <= max_broadcast_rows:
        lists = F.broadcast(lists)
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]
    keys = lookup_keys(F.col(url), labels_most or 0, depth or 0, longest or 0)
    keyed = rows.select(F.struct(*columns).alias("capture"), F.monotonically_increasing_id().alias("row"), keys.alias("keys"))
    keyed = keyed.select("capture", "row", F.explode_outer("keys").alias("key"))
    at = F.col(f"capture.{fetched_at}")
    active = (F.col("key") == F.col("pattern")) & (at >= F.col("since")) & (F.col("before").isNull() | (at < F.col("before")))
    met = keyed.join(lists, active, "left")
    per_row = met.groupBy("row").agg(
        F.first("capture").alias("capture"),
        F.count("pattern").alias("n_active"),
        (F.coalesce(F.bool_or(F.col("policy") == "block"), F.lit(False)) & ~F.coalesce(F.bool_or(F.col("policy") == "allow"), F.lit(False))).alias("blocked"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias("patterns"),
    )
    return per_row.select("capture.*", *new)


def page_entries(pages: DataFrame) -> DataFrame:
    """Entries that grow with the pages: of every tenth page, its host in capitals with the path's first segment, listed and taken off in turns."""
    pattern = F.concat(F.upper(F.regexp_extract("url", _REST, 1)), F.lit("/"), F.regexp_extract(F.regexp_extract("url", _REST, 2), "^/*([^/]*)", 1))
    action = F.when(F.col("page_id") % 20 == 0, "add").otherwise("remove")
    return pages.where("page_id % 10 = 0").select(F.lit("review").alias("list"), F.lit("block").alias("policy"), pattern.alias("pattern"), action.alias("action"), (START + F.col("page_id") * STEP).alias("dated"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, one fetched each hour after START in the order of their ids, against LIST and ``page_entries``."""
    pages = table(spark, sf_dir, "pages")
    entries = spark.createDataFrame([(*e[:4], START + e[4] * STEP) for e in LIST], ENTRIES).unionByName(page_entries(pages))
    captures = pages.select("page_id", "url", (START + F.col("page_id") * STEP).alias("fetched_at"))
    return filter_captures(captures, entries)


def _sql() -> str:
    values = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {START + e * STEP})" for a, b, c, d, e in LIST)
    return f"""
WITH l(list, policy, pattern, action, dated) AS (VALUES {values} UNION ALL
  SELECT 'review', 'block', upper(regexp_extract(url, '{_REST}', 1)) || '/' || regexp_extract(regexp_extract(url, '{_REST}', 2), '^/*([^/]*)', 1),
    CASE WHEN page_id % 20 = 0 THEN 'add' ELSE 'remove' END, {START} + page_id * {STEP} FROM pages WHERE page_id % 10 = 0),
e AS (SELECT list, policy, lower(regexp_extract(pattern, '^[^/]*')) || regexp_extract(pattern, '^[^/]*(.*)', 1) AS pattern, action, dated FROM l),
v AS (SELECT *, lead(dated) OVER (PARTITION BY list, policy, pattern ORDER BY dated, action) AS before FROM e),
i AS (SELECT * FROM v WHERE action = 'add' AND (before IS NULL OR before > dated)),
p AS (SELECT row_number() OVER () AS row, page_id, url, {START} + page_id * {STEP} AS fetched_at, lower(regexp_extract(url, '{_REST}', 1)) AS host,
    string_split_regex(regexp_replace(regexp_extract(url, '{_REST}', 2), '^/+|/+$', '', 'g'), '/+') AS path FROM pages),
d AS (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS k FROM p WHERE host <> ''),
x AS (SELECT *, unnest(range(0, len(path) + 1)) AS n, array_to_string(string_split(host, '.')[k:], '.') AS domain FROM d),
keys AS (SELECT DISTINCT row, fetched_at, domain || CASE WHEN n = 0 THEN '' ELSE '/' || array_to_string(path[1:n], '/') END AS key FROM x),
m AS (SELECT row, list, policy, pattern FROM keys JOIN i ON key = pattern AND fetched_at >= dated AND (before IS NULL OR fetched_at < before)),
g AS (SELECT row, count(*) AS n_active, bool_or(policy = 'block') AND NOT bool_or(policy = 'allow') AS blocked,
    string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns FROM m GROUP BY row)
SELECT page_id, url, fetched_at, coalesce(n_active, 0) AS n_active, coalesce(blocked, false) AS blocked, coalesce(lists, '') AS lists, coalesce(patterns, '') AS patterns
FROM p LEFT JOIN g USING (row)"""


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE_SQL = {"op5_url_filter": _sql()}

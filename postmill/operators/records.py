"""Rows of the message store: review issues, write-back, event ids, intervals of hits, quotas, headers and canonical forms.

All are DataFrame plans or column expressions over whole tables; events, orders and line items stand for
the store's rows as in ``relational``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.tables import table
from .ranges import part_of
from .relational import flags_of_event, needs_review


def review_issues(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (flags, fields: map<string, struct>) to one row for each flag that asks for a review, with the field it names."""
    issues = rows.select(*keys, "fields", F.explode("flags").alias("flag")).where(needs_review(F.array("flag")))
    name = F.when(F.contains("flag", F.lit(":")), F.split_part("flag", F.lit(":"), F.lit(2)))
    return issues.select(*keys, "flag", name.alias("field"), F.try_element_at("fields", name).alias("found"))


def written_back(children: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Children of parents that have a new result are replaced by the result's; all others stay."""
    return children.join(results.select(key).distinct(), key, "left_anti").unionByName(results.select(*children.columns))


def with_event_ids(events: DataFrame, last_id: int, order: list[str], shard: str) -> DataFrame:
    """Ids without gaps above ``last_id``, in the order of ``order``: counts of each shard first, then places within it.

    ``shard`` names a column that ascends with ``order`` (a part of its range, an offset's file), so no task sees all rows.
    """
    sizes = events.groupBy(shard).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(shard)) - F.col("__n")  # a row for each shard
    starts = sizes.select(shard, before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(shard).orderBy(*order))
    return events.withColumn("__own", own).join(starts, shard).withColumn("id", F.lit(last_id) + F.col("__before") + F.col("__own")).drop("__own", "__before")


def uncovered(hits: Column) -> Column:
    """Hits struct(first, after, ...) that no longer hit, and no earlier one of the same length, covers."""
    length = lambda h: h["after"] - h["first"]
    covers = lambda b, j, a, i: (j != i) & (b["first"] <= a["first"]) & (b["after"] >= a["after"]) & ((length(b) > length(a)) | ((length(b) == length(a)) & (j < i)))
    return F.filter(hits, lambda a, i: ~F.exists(F.transform(hits, lambda b, j: covers(b, j, a, i)), lambda x: x))


def read_datetime(raw: Column, day: Column) -> Column:
    """A day (date) and the time that the text names, 12-hour forms included, as a UTC timestamp; midnight where it names none."""
    part = lambda n: F.nullif(F.regexp_extract(raw, r"(?i)\b([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?\s*(am|pm)?", n), F.lit(""))
    hour, half = part(1).cast("int"), F.lower(part(4))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    valid = (hour < 24) & (part(2).cast("int") < 60) & (F.coalesce(part(3).cast("int"), F.lit(0)) < 60)
    seconds = F.when(valid, hour * 3600 + part(2).cast("int") * 60 + F.coalesce(part(3).cast("int"), F.lit(0))).otherwise(0)
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + F.coalesce(seconds, F.lit(0)))


def uid_page(items: DataFrame, cursor: int, limit: int, *, tail: bool = False) -> DataFrame:
    """The first ``limit`` items above a cursor, or with ``tail`` the last; ascending either way."""
    new = items.where(F.col("uid") > cursor)
    return new.orderBy(F.desc("uid")).limit(limit).orderBy("uid") if tail else new.orderBy("uid").limit(limit)


def received_header(helo: Column, ip: Column, host: str, queue_id: Column, tls: Column, to: Column) -> Column:
    """A trace header; the recipient is left out where it is null."""
    by = F.concat(F.lit(f"\tby {host} with "), F.when(tls, "ESMTPS").otherwise("ESMTP"), F.lit(" id "), queue_id)
    return F.concat(F.lit("Received: from "), helo, F.lit(" (["), ip, F.lit("])\r\n"), by, F.coalesce(F.concat(F.lit("\r\n\tfor <"), to, F.lit(">;")), F.lit(";")))


def trusted_link(link: Column, claimed: Column) -> Column:
    """A sender's link stays trusted only with a web scheme, whatever was claimed about it."""
    return F.coalesce(claimed & link.rlike(r"(?i)^https?://[^/\s]+"), F.lit(False))


def canonical_header(name: Column, value: Column) -> Column:
    """The relaxed form that signatures cover: lower-case name, one line, single blanks."""
    return F.concat(F.lower(F.trim(name)), F.lit(":"), F.regexp_replace(F.regexp_replace(F.replace(value, F.lit("\r\n"), F.lit("")), r"[ \t]+", " "), r"^ | $", ""), F.lit("\r\n"))


def canonical_body(body: Column, relaxed: bool) -> Column:
    """A body without empty lines at its end; relaxed, with single blanks and none at line ends. An empty body is one line end, or nothing if relaxed."""
    even = F.regexp_replace(F.regexp_replace(body, r"[ \t]+", " "), r" \r\n", "\r\n") if relaxed else body
    bare = F.regexp_replace(even, r"(\r\n)+\z", "")
    return F.when(bare == "", "" if relaxed else "\r\n").otherwise(F.concat(bare, F.lit("\r\n")))


def split_address(address: Column) -> Column:
    """struct(local, domain) at the last @ outside quotes; null for what is no address."""
    parts = r'^((?:"(?:[^"\\]|\\.)*"|[^"@])+)@([A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?|\[[^\]\s]+\])$'
    local, domain = F.regexp_extract(address, parts, 1), F.lower(F.regexp_extract(address, parts, 2))
    return F.when((local != "") & (F.length(local) <= 64) & (F.length(address) <= 320), F.struct(local.alias("local"), domain.alias("domain")))


def from_domain(header: Column) -> Column:
    """The domain of a From header: of the last address in angle brackets, else of the first address."""
    flat = F.trim(F.regexp_replace(header, r"\r?\n[ \t]+", " "))
    inner = F.nullif(F.regexp_extract(flat, r"<([^<>]*)>\s*$", 1), F.lit(""))
    return split_address(F.trim(F.coalesce(inner, F.regexp_extract(flat, "^([^,;]*)", 1))))["domain"]


def address_count(header: Column) -> Column:
    """Addresses of a header: commas outside quotes and angle brackets, and one; 0 for none."""
    bare = F.regexp_replace(F.regexp_replace(header, r'"(?:[^"\\]|\\.)*"', ""), r"<[^>]*>", "")
    return F.when(F.coalesce(F.trim(header), F.lit("")) == "", 0).otherwise(F.regexp_count(bare, F.lit(",")) + 1)


def plain_ip(ip: Column) -> Column:
    """Lower case; an IPv4 address in IPv6 form as IPv4; an IPv6 address in its shortest form."""
    low = F.lower(F.trim(F.coalesce(ip, F.lit(""))))
    four = F.regexp_extract(low, r"^::ffff:([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 1)

    def short(groups: Column) -> Column:
        """The first of the longest runs of two zeros or more becomes a double colon."""
        joined = F.array_join(F.transform(groups, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")
        runs = [rf"^(.*?)(?:^|:)(?:0:){{{n - 1}}}0(?:$|:)(.*)$" for n in range(8, 1, -1)]
        return F.coalesce(*(F.when(joined.rlike(p), F.regexp_replace(joined, p, "$1::$2")) for p in runs), joined)

    def whole(address: Column) -> Column:
        head, rest = F.split_part(address, F.lit("::"), F.lit(1)), F.split_part(address, F.lit("::"), F.lit(2))
        groups = lambda t: F.array_remove(F.split(t, ":"), "")
        gap = F.array_repeat(F.lit("0"), F.when(F.contains(address, F.lit("::")), 8 - F.size(groups(head)) - F.size(groups(rest))).otherwise(0).cast("int"))
        return let(F.concat(groups(head), gap, groups(rest)), lambda g: F.when(F.size(g) == 8, short(g)).otherwise(address))

    return F.when(four != "", four).when(low.rlike(r"^[0-9a-f:]+$") & F.contains(low, F.lit(":")), whole(low)).otherwise(low)


def reverse_name(ip: Column) -> Column:
    """The name under which DNS keeps an IPv4 address."""
    return F.when(ip.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.concat(F.array_join(F.reverse(F.split(ip, r"\.")), "."), F.lit(".in-addr.arpa")))


# Queries

def p04_review_rows(spark: SparkSession, d: str) -> DataFrame:
    fields = F.create_map(F.lit("total"), F.col("value"), F.col("event_type"), F.col("value") / 2)
    found = review_issues(table(spark, d, "events").select("event_id", flags_of_event().alias("flags"), fields.alias("fields")), ["event_id"])
    return found.select("event_id", "flag", "field", F.round("found", 6).alias("found"))


def j12_exists_in_json(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a word of their name, kept as a JSON array, that holds the text "an"."""
    said = F.to_json(F.split("p_name", " "))
    return table(spark, d, "part").where(F.exists(F.from_json(said, "array<string>"), lambda x: F.contains(F.lower(x), F.lit("an")))).select("p_partkey", "p_name")


def j17_uncovered(spark: SparkSession, d: str) -> DataFrame:
    hit = F.struct((F.col("l_linenumber") * 10).cast("long").alias("first"), (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("after"))
    hits = table(spark, d, "lineitem").select("l_orderkey", hit.alias("hit")).distinct().groupBy("l_orderkey").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return hits.select("l_orderkey", F.explode(uncovered(F.col("hits"))).alias("hit")).select("l_orderkey", "hit.first", "hit.after")


def t26_datetimes(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd"), F.lit("at"), F.date_format("ts", "h:mm:ss a"))
    return table(spark, d, "events").select("event_id", F.date_format(read_datetime(said, F.to_date("ts")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def r22_api_quota(spark: SparkSession, d: str) -> DataFrame:
    """What a call is answered: test keys always pass, others until the month's count is over the quota."""
    month = F.date_format("ts", "yyyy-MM")
    place = F.row_number().over(Window.partitionBy("user_id", month).orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", F.when((F.col("user_id") % 11 == 0) | (place <= 5), 200).otherwise(402).cast("long").alias("status"))


def k02_write_back(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.lit("old").alias("state"))
    results = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("l_partkey"), F.lit("new").alias("state"))
    return written_back(lines, results, "l_orderkey")


def k03_event_ids(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return with_event_ids(events.withColumn("part", part_of(events, "at")), 1000, ["ts", "event_id"], "part").select("event_id", "id")


def k14_received(spark: SparkSession, d: str) -> DataFrame:
    to = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), F.lit("@example.org")))
    ip = F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 250).cast("string"))
    return table(spark, d, "customer").select("c_custkey", received_header(F.col("c_name"), ip, "mx.example.org", F.col("c_custkey").cast("string"), F.col("c_custkey") % 3 == 0, to).alias("header"))


QUERIES = {f.__name__: f for f in (p04_review_rows, j12_exists_in_json, j17_uncovered, t26_datetimes, r22_api_quota, k02_write_back, k03_event_ids, k14_received)}
ORACLE_SQL = {
    "p04_review_rows": """WITH f AS (SELECT event_id, value, event_type, unnest(list_filter([CASE WHEN value < 20 THEN 'low_confidence:' || event_type END, CASE WHEN value > 80 THEN 'arithmetic_mismatch:total' END, CASE WHEN user_id % 10 = 0 THEN 'parse_failed' END], lambda x: x IS NOT NULL)) AS flag FROM events)
        SELECT event_id, flag, CASE WHEN contains(flag, ':') THEN split_part(flag, ':', 2) END AS field, round(CASE WHEN flag = 'arithmetic_mismatch:total' THEN value WHEN contains(flag, ':') THEN value / 2 END, 6) AS found FROM f""",
    "j12_exists_in_json": "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM unnest(string_split(p_name, ' ')) u(x) WHERE contains(lower(x), 'an'))",
    "j17_uncovered": """WITH h AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber * 10 AS BIGINT) AS first, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS after FROM lineitem)
        SELECT l_orderkey, first, after FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.l_orderkey = a.l_orderkey AND b.first <= a.first AND b.after >= a.after AND b.after - b.first > a.after - a.first)""",
    "t26_datetimes": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "r22_api_quota": "SELECT event_id, CAST(CASE WHEN user_id % 11 = 0 OR row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 5 THEN 200 ELSE 402 END AS BIGINT) AS status FROM events",
    "k02_write_back": """SELECT l_orderkey, l_partkey, 'old' AS state FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
        SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderstatus = 'F'""",
    "k03_event_ids": "SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS id FROM events",
    "k14_received": """SELECT c_custkey, 'Received: from ' || c_name || ' ([10.0.0.' || c_custkey % 250 || '])' || chr(13) || chr(10) || chr(9) || 'by mx.example.org with ' || CASE WHEN c_custkey % 3 = 0 THEN 'ESMTPS' ELSE 'ESMTP' END || ' id ' || c_custkey
        || CASE WHEN c_custkey % 2 = 0 THEN chr(13) || chr(10) || chr(9) || 'for <' || lower(c_mktsegment) || '@example.org>;' ELSE ';' END AS header FROM customer""",
}

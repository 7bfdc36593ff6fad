"""Filters, joins, aggregations, ordering and set operations over message-shaped tables.

Customers stand for mailboxes, nations for accounts, orders for messages, line items for
attachments, events for the event feed, and documents for bodies. Each operator is a plain
DataFrame plan: filters reach the scan, joins carry no hints, so that Spark's size statistics pick
broadcast or shuffle, and limits compile to TakeOrderedAndProject.

Money is summed in cents, so sums don't depend on the order of rows.
"""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .ranges import order_statistics

PAGE_MOST, PAGE_DEFAULT = 200, 25


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def page_limit(asked: object, default: int = PAGE_DEFAULT) -> int:
    """A page size between 1 and PAGE_MOST."""
    try:
        return max(1, min(PAGE_MOST, int(str(asked))))
    except ValueError:
        return default


def contains_literal(column: Column, needle: str) -> Column:
    """Case-insensitive containment of a literal, whatever wildcards it holds."""
    return F.contains(F.lower(column), F.lit(needle[:200].lower()))


def all_of(*predicates: Column | None) -> Column:
    """The conjunction of those predicates that are given; one builder serves counting and fetching."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def keyset_page(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


# Filters

def f01_tenant_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where((F.col("o_custkey") == 7) & (F.col("o_orderstatus") != "P")).select("o_orderkey", "o_orderstatus")


def f02_half_open_range(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, d, "orders").where((at >= F.lit("1995-01-01").cast("timestamp_ntz")) & (at < F.lit("1995-03-01").cast("timestamp_ntz"))).select("o_orderkey", "o_custkey")


def f03_literal_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(contains_literal(F.col("text"), "%%% ")).select("doc_id", "lang")


def f04_any_recipient(spark: SparkSession, d: str) -> DataFrame:
    recipients = F.split("p_name", " ")
    return table(spark, d, "part").where(F.exists(recipients, lambda x: contains_literal(x, "re"))).select("p_partkey", "p_name")


def f05_json_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.lower(F.get_json_object("props", "$.k")) == "42").select("event_id", "user_id")


def f06_keyset(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_id") < 500).select("event_id", "event_type")


def flags_of_event() -> Column:
    """Review flags derived of an event: a family with its field, or a whole flag."""
    return F.array_compact(
        F.array(
            F.when(F.col("value") < 20, F.concat(F.lit("low_confidence:"), F.col("event_type"))),
            F.when(F.col("value") > 80, F.lit("arithmetic_mismatch:total")),
            F.when(F.col("user_id") % 10 == 0, F.lit("parse_failed")),
            F.when(F.col("user_id") % 7 == 0, F.lit("newsletter")),
        )
    )


#: The flag families and whole flags that ask for a review.
REVIEW_FAMILIES = ("low_confidence", "type_error", "required_missing", "enum_violation", "rule_llm_disagreement", "arithmetic_mismatch")
REVIEW_FLAGS = ("parse_failed", "schema_missing", "spam_suspected")
_FLAGS_SQL = """list_filter([CASE WHEN value < 20 THEN 'low_confidence:' || event_type END, CASE WHEN value > 80 THEN 'arithmetic_mismatch:total' END,
  CASE WHEN user_id % 10 = 0 THEN 'parse_failed' END, CASE WHEN user_id % 7 = 0 THEN 'newsletter' END], lambda x: x IS NOT NULL)"""


def needs_review(flags: Column) -> Column:
    return F.exists(flags, lambda f: F.substring_index(f, ":", 1).isin(*REVIEW_FAMILIES) & F.contains(f, F.lit(":")) | f.isin(*REVIEW_FLAGS))


def f07_f12_needs_review(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(needs_review(flags_of_event())).select("event_id")


def f08_has_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.array_contains(flags_of_event(), "newsletter")).select("event_id", F.size(flags_of_event()).cast("long").alias("n_flags"))


def f09_dynamic_predicates(spark: SparkSession, d: str) -> DataFrame:
    wanted = all_of(F.col("o_totalprice") > 1000, None, F.col("o_orderpriority").startswith("1"), F.col("o_custkey").isin(1, 2, 3, 4, 5, 6))
    return table(spark, d, "orders").where(wanted).select("o_orderkey", "o_custkey")


def f10_calendar_days(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").where((day >= F.lit("1994-02-01").cast("date")) & (day <= F.lit("1994-02-05").cast("date"))).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def f11_any_candidate(spark: SparkSession, d: str) -> DataFrame:
    fields = F.array("c_name", "c_mktsegment", F.lit("postmaster"))
    return table(spark, d, "customer").where(F.exists(fields, lambda x: contains_literal(x, "BUILD"))).select("c_custkey")


def f13_auth_flags(spark: SparkSession, d: str) -> DataFrame:
    spf = F.get(F.array(*map(F.lit, ("pass", "fail", "none", "softfail", "temperror"))), (F.col("event_id") % 5).cast("int"))
    dkim = F.get(F.array(*map(F.lit, ("pass", "body_altered", "fail"))), (F.col("event_id") % 3).cast("int"))
    fine = ("pass", "none", "temperror", "permerror", "body_altered")
    flag = lambda name, c: F.when(~c.isin(*fine), F.concat(F.lit(f"auth_fail:{name}:"), c))
    flags = F.array_compact(F.array(flag("spf", spf), flag("dkim", dkim)))
    return table(spark, d, "events").select("event_id", F.array_join(flags, ",").alias("flags")).where("flags <> ''")


def f14_traffic_class(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "counted").when(F.get_json_object("props", "$.k").cast("int") % 4 == 0, "opted_out").when(F.col("user_id") < 20, "internal").otherwise("page")
    return table(spark, d, "events").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def f15_placeholder_null(spark: SparkSession, d: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ("N/A", "unknown", "--", "Not found", "keine Angabe", "12.50", "none today", "n a"))), (F.col("event_id") % 8).cast("int"))
    return table(spark, d, "events").select("event_id", without_placeholder(raw).alias("kept"))


#: Fixed value: the placeholders that stand for no value.
PLACEHOLDER = r"(?i)^(n/?a|none|null|unknown|not (?:found|provided|specified|available)|-{1,3}|keine? angabe)$"


def without_placeholder(value: Column) -> Column:
    return F.when(~F.trim(value).rlike(PLACEHOLDER), value)


def f17_retention_keep(spark: SparkSession, d: str) -> DataFrame:
    """A half-open range on the date itself for each plan, so that the bounds reach the scan."""
    now = datetime.date(1998, 8, 2)
    kept = [(F.col("o_custkey") % 3 == plan) & (F.col("o_orderdate") >= F.lit(str(now - datetime.timedelta(days))).cast("timestamp_ntz")) for plan, days in enumerate((30, 90, 365))]
    return table(spark, d, "orders").where(reduce(or_, kept)).select("o_orderkey", "o_custkey")


def f18_stranded(spark: SparkSession, d: str) -> DataFrame:
    """Between 15 minutes and 48 hours old, in whole seconds; bounds on the time itself reach the scan."""
    now = datetime.datetime(2024, 1, 10)
    age = F.unix_seconds(F.lit(str(now)).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    at = lambda seconds: F.lit(str(now - datetime.timedelta(seconds=seconds))).cast("timestamp_ntz")
    within = (F.col("ts") >= at(48 * 3600)) & (F.col("ts") < at(15 * 60 - 1))
    return table(spark, d, "events").where((F.col("event_type") == "click") & within).select("event_id", age.alias("age_s"))


def f21_review_split(spark: SparkSession, d: str) -> DataFrame:
    review = F.coalesce(needs_review(flags_of_event()), F.lit(False))
    return table(spark, d, "events").groupBy(F.when(review, "review").otherwise("clean").alias("branch")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


# Joins

def j01_message_mailbox(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


def j02_left_blob(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


def j03_ownership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_custkey")


def j04_feed_page(spark: SparkSession, d: str) -> DataFrame:
    feed = table(spark, d, "events").where("event_id > 100")
    named = feed.join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return keyset_page(named, [F.col("event_id").asc()], 50).select("event_id", "user_id", F.col("c_name").alias("mailbox"), F.col("n_name").alias("account"))


def j05_coalesced_right(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0")
    items = table(spark, d, "part").withColumn("key", F.col("p_partkey") % 100 + 1)
    return items.join(s, F.col("key") == F.col("s_suppkey"), "left").select("p_partkey", F.coalesce("s_name", "p_brand").alias("secret"))


def j06_routing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


def j08_review_queue(spark: SparkSession, d: str) -> DataFrame:
    queue = table(spark, d, "events").where(needs_review(flags_of_event())).join(table(spark, d, "customer"), F.col("user_id") == F.col("c_custkey"))
    return keyset_page(queue, [F.col("event_id").desc()], 50).select("event_id", "c_name")


def j09_semi(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def j10_not_in_guarded(spark: SparkSession, d: str) -> DataFrame:
    """NOT IN over a column with nulls: they are left out first, else no row would come back."""
    used = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("ref")).where("ref IS NOT NULL")
    return table(spark, d, "customer").join(used, F.col("c_custkey") == F.col("ref"), "left_anti").select("c_custkey")


def j11_not_exists(spark: SparkSession, d: str) -> DataFrame:
    late = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


def j13_membership(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where(F.col("n_regionkey").isin(1, 3)).select("n_nationkey", "n_name")


def j14_per_plan_delete(spark: SparkSession, d: str) -> DataFrame:
    plans = spark.createDataFrame([("AUTOMOBILE", 100), ("BUILDING", 400), ("FURNITURE", 900)], "plan string, days int")
    mail = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    now = F.lit("1998-08-02").cast("date")
    kept = mail.join(plans, F.col("c_mktsegment") == F.col("plan")).where(F.to_date("o_orderdate") >= F.date_sub(now, F.col("days")))
    return kept.groupBy("plan").agg(F.count("*").alias("kept"))


# Aggregations

def day() -> Column:
    return F.date_format("ts", "yyyy-MM-dd")


def a01_daily_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(day().alias("day")).agg(F.count("*").alias("views"), F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("visits")).orderBy("day")


def a02_totals_by_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("views"), F.sum(cents(F.col("value"))).alias("value_cents")).orderBy(F.desc("views"), "event_type")


def a03_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(day().alias("day")).agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


def a04_usage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.count("*").alias("stored"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("month"), F.count_if(needs_review(flags_of_event())).alias("review"), F.count_if(F.col("value").isNull()).alias("empty"))


def fold_top(counts: DataFrame, key: str, n: str, top: int, least: int) -> DataFrame:
    """The ``top`` keys with at least ``least``; all others, and rarer ones, fold into (other)."""
    enough = counts.where(F.col(n) >= least).orderBy(F.desc(n), key).limit(top).select(F.col(key).alias("kept_key"))  # each task keeps its own top
    label = F.when(F.col("kept_key").isNotNull(), F.col(key)).otherwise("(other)")
    return counts.join(enough, F.col(key) == F.col("kept_key"), "left").groupBy(label.alias(key)).agg(F.sum(n).alias(n))


def a05_fold_other(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("user", F.col("user_id").cast("string"))
    return fold_top(counts.select("user", "n"), "user", "n", 25, 3)


def a06_flag_histogram(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "events").select(F.explode(flags_of_event()).alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(12)


def a07_capped_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").agg(F.least(F.count("*"), F.lit(5000)).alias("n"))


def a08_too_old(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'click'").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("oldest"))


def a09_a10_rollup_merge(spark: SparkSession, d: str) -> DataFrame:
    """A stored rollup and a new batch, merged by key."""
    rolled = lambda rows: rows.groupBy(day().alias("day"), F.col("event_type").alias("path")).agg(F.count("*").alias("views"))
    events = table(spark, d, "events")
    return rolled(events.where("event_id <= 5000")).unionByName(rolled(events.where("event_id > 5000"))).groupBy("day", "path").agg(F.sum("views").alias("views"))


def a11_mean_confidence(spark: SparkSession, d: str) -> DataFrame:
    present = F.when(F.col("value") > 10, F.floor(F.col("value")).cast("long"))
    return table(spark, d, "events").groupBy("user_id").agg((F.floor((F.sum(present) * 200 + F.count(present)) / (F.count(present) * 2)) / 10000).alias("confidence"))


def a12_calibration(spark: SparkSession, d: str) -> DataFrame:
    confidence = F.least(F.lit(1.0), F.col("n_chars") / 4000)
    bucket = F.when(confidence >= 0.9, "0.9").when(confidence >= 0.7, "0.7").when(confidence >= 0.5, "0.5").otherwise("below")
    judged = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return judged.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("right"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("fp"))


def a13_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The values at three places of each group in order."""
    items = table(spark, d, "orders").select("o_orderpriority", cents(F.col("o_totalprice")).alias("c"))
    return order_statistics(items, ["o_orderpriority"], "c", {"p50": 50, "p95": 95, "p99": 99})


def a14_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.md5("text").alias("digest"), "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def a15_mode(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value; of ties the larger."""
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").count()
    return counts.groupBy("l_returnflag").agg(F.max_by("l_linenumber", F.struct("count", "l_linenumber")).alias("mode"))


def a16_first_of_key(spark: SparkSession, d: str) -> DataFrame:
    firsts = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("first"))
    return firsts.select("l_partkey", "l_returnflag", "first.l_orderkey", "first.l_linenumber")


def a17_distinct_in_order(spark: SparkSession, d: str) -> DataFrame:
    words = F.array_distinct(F.split("text", " "))
    return table(spark, d, "benchmark").select("item_id", F.array_join(words, " ").alias("words"))


def a18_a19_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose line items, in cents after discount and with tax, come within tolerance of the stated total."""
    line = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    sums = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(cents(line)).alias("sum_cents"))
    both = table(spark, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("total_cents", cents(F.col("o_totalprice")))
    fits = F.abs(F.col("sum_cents") - F.col("total_cents")) <= F.greatest(F.lit(2.0), F.abs(F.col("total_cents")) * 0.005)
    return both.select("o_orderkey", "sum_cents", "total_cents", fits.alias("reconciles"))


def a22_refund(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(0), F.col("p_size") - 10).cast("long").alias("used"))


# Order-dependent operators

def w02_anchor_run(spark: SparkSession, d: str) -> DataFrame:
    """The shortest run of two or more consecutive line items whose quantities sum to 50; the earliest of ties."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("long")).over(w).alias("upto"), F.col("l_quantity").cast("long").alias("q"), F.row_number().over(w).alias("at"))
    a, b = runs.alias("a"), runs.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.at") > F.col("a.at")) & (F.col("b.upto") - F.col("a.upto") + F.col("a.q") == 50))
    best = pairs.groupBy(F.col("a.l_orderkey").alias("l_orderkey")).agg(F.min(F.struct((F.col("b.at") - F.col("a.at") + 1).alias("n"), F.col("a.at").alias("start"))).alias("best"))
    return best.select("l_orderkey", "best.n", "best.start")


def w10_feed_order(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("place"), F.lag("role").over(w).alias("after_role"))


def l01_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), [F.desc("day"), F.desc("o_orderkey")], page_limit("25") + 1)


def l02_clamped_limit(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(table(spark, d, "part").select("p_partkey"), [F.asc("p_partkey")], page_limit(5000))


def l03_forward_feed(spark: SparkSession, d: str) -> DataFrame:
    page = keyset_page(table(spark, d, "events").where("event_id > 250").select("event_id", "event_type"), [F.asc("event_id")], 40)
    return page.withColumn("has_more", F.count("*").over(Window.partitionBy()) == 40)


def l04_due_row(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(table(spark, d, "events").where("event_type = 'purchase'").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("due")), [F.asc("due"), F.asc("event_id")], 1)


def l09_row_cap(spark: SparkSession, d: str) -> DataFrame:
    """A table's rows up to a cap, with the whole count and whether it was cut: the cap is the feature."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(lines, 1, 3), "\n").alias("rows"), F.size(lines).cast("long").alias("row_count"), (F.size(lines) > 3).alias("truncated"))


# Set operations

def u01_u02_flag_sets(spark: SparkSession, d: str) -> DataFrame:
    before, after = F.split("p_type", " "), F.split("p_name", " ")
    line = lambda c: F.array_join(F.array_sort(c), ",")
    return table(spark, d, "part").select("p_partkey", line(F.array_union(before, after)).alias("both"), line(F.array_except(after, before)).alias("added"), line(F.array_except(before, after)).alias("removed"))


def u03_result_diff(spark: SparkSession, d: str) -> DataFrame:
    """A full outer join of two result sets by key, with what changed."""
    old = table(spark, d, "customer").where("c_custkey % 7 <> 0").select("c_custkey", F.col("c_mktsegment").alias("old_value"))
    new = table(spark, d, "customer").where("c_custkey % 11 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("new_value"))
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed")
    return old.join(new, "c_custkey", "full_outer").withColumn("change", change).where("change IS NOT NULL")


def u04_table_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return a.unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))).dropDuplicates(["nation"])


def u06_bounded_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The last three distinct words in order of their last occurrence."""
    words = F.split(F.trim("text"), r"\s+")
    kept = F.filter(words, lambda w, i: ~F.array_contains(F.slice(words, i + 2, F.size(words)), w))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(kept, F.greatest(F.lit(1), F.size(kept) - 2), F.lit(3)), " ").alias("last_words"))


# Sinks and state transitions, as the rows they would store

def k01_idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    """One row for each non-null key, the first by id; rows without a key all stay."""
    key = F.when(F.col("doc_id") % 3 != 0, F.md5("text"))
    rows = table(spark, d, "documents").select("doc_id", "source", key.alias("key"))
    w = Window.partitionBy("source", "key").orderBy("doc_id")
    return rows.where("key IS NOT NULL").withColumn("no", F.row_number().over(w)).where("no = 1").drop("no").unionByName(rows.where("key IS NULL"))


def k04_blob_expiry(spark: SparkSession, d: str) -> DataFrame:
    expires = F.date_add(F.to_date("o_orderdate"), 90)
    return table(spark, d, "orders").withColumn("expires", expires).where(F.col("expires") > F.lit("1998-06-01").cast("date")).select("o_orderkey", F.date_format("expires", "yyyy-MM-dd").alias("expires"))


def k06_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A delivery of each message to every active endpoint of its account; an account has three at most."""
    accounts = F.explode(F.array(*(F.col("s_suppkey") + k for k in range(3)))).alias("account")
    endpoints = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("endpoint"), accounts)
    return table(spark, d, "orders").join(endpoints, F.col("o_custkey") == F.col("account")).select("o_orderkey", "endpoint")


#: Seconds to wait after each failed delivery.
RETRY_SECONDS = (30, 120, 600, 3600, 21600)
MAX_ATTEMPTS = 6


def delivery_state(attempt: Column, status: Column) -> tuple[Column, Column]:
    """The state after an attempt, and the seconds until the next."""
    retriable = (status >= 500) | status.isin(408, 429)
    state = F.when(status.between(200, 299), "delivered").when(~retriable, "failed").when(attempt >= MAX_ATTEMPTS, "exhausted").otherwise("retry")
    wait = F.get(F.array(*map(F.lit, RETRY_SECONDS)), (F.least(attempt, F.lit(len(RETRY_SECONDS))) - 1).cast("int"))
    return state, F.when(state == "retry", wait)


def k08_r10_attempt(spark: SparkSession, d: str) -> DataFrame:
    attempt = (F.col("event_id") % 7 + 1).cast("int")
    status = F.get(F.array(*map(F.lit, (200, 404, 408, 429, 500, 503))), (F.col("event_id") % 6).cast("int"))
    state, wait = delivery_state(attempt, status)
    return table(spark, d, "events").select("event_id", attempt.cast("long").alias("attempt"), state.alias("state"), wait.cast("long").alias("wait_s"))


#: Seconds between drains of a spool.
SPOOL_SECONDS = (0, 5, 15, 60, 300, 900, 3600, 21600)


def k10_spool_backoff(spark: SparkSession, d: str) -> DataFrame:
    tries = (F.col("event_id") % 30).cast("int")
    wait = F.get(F.array(*map(F.lit, SPOOL_SECONDS)), F.least(tries, F.lit(len(SPOOL_SECONDS) - 1)))
    return table(spark, d, "events").select("event_id", F.when(tries < 24, wait).cast("long").alias("wait_s"))


def k11_state_upsert(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("stored_name"), cents(F.col("c_acctbal")).alias("stored_cursor"))
    fresh = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("renamed")).alias("name"), F.col("c_custkey").alias("cursor"))
    return stored.join(fresh, "id", "full_outer").select("id", F.coalesce("name", "stored_name").alias("name"), F.coalesce("cursor", "stored_cursor").alias("cursor"))


def k13_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("mailbox"))).alias("payload"))


def r06_day_window(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def r07_r08_quota(spark: SparkSession, d: str) -> DataFrame:
    """Accepted while the month's count is within quota, in the order of time and id."""
    month = F.date_format("ts", "yyyy-MM")
    w = Window.partitionBy("user_id", month).orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", month.alias("month"), (F.row_number().over(w) <= 5).alias("accepted"))


def r12_circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """The longest run of failures of each user; broken at five."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    failed = F.col("value") < 60
    runs = table(spark, d, "events").withColumn("failed", failed).withColumn("island", F.sum(F.when(~failed, 1).otherwise(0)).over(w))
    longest = runs.groupBy("user_id", "island").agg(F.count_if("failed").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))
    return longest.withColumn("disabled", F.col("longest") >= 5)


def r13_late_policy(spark: SparkSession, d: str) -> DataFrame:
    age = F.unix_seconds(F.lit("2024-01-20 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    action = F.when(age > 48 * 3600, "too_old").when(F.col("event_id") % 6 > 3, "abandon").when(age > 15 * 60, "replay").otherwise("wait")
    return table(spark, d, "events").groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def r14_ttl(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.to_date("o_orderdate") >= F.add_months(F.lit("1998-08-02").cast("date"), -13)).agg(F.count("*").alias("kept"))


def r17_backoff(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.lit(60000.0), 500 * F.pow(F.lit(2.0), n - 1)).cast("long").alias("delay_ms")).distinct()


def r19_latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The schema in force of each mailbox: its greatest version."""
    versions = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("schema"))
    return versions.groupBy("o_custkey").agg(F.max("version").alias("version"), F.max_by("schema", "version").alias("schema"))


def r20_first_conversion(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moved = table(spark, d, "events").withColumn("was", F.lag("event_type").over(w)).where("event_type = 'purchase' AND (was IS NULL OR was <> 'purchase')")
    first = moved.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.select("user_id", "first.event_id", F.date_format("first.ts", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


def j07_credentials(spark: SparkSession, d: str) -> DataFrame:
    """Keys and sessions that are still good, each with its account."""
    accounts = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("account"))
    keys = table(spark, d, "supplier").where("s_acctbal > 0").select(F.lit("key").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("of"))
    sessions = table(spark, d, "customer").where("c_acctbal > 0").select(F.lit("session").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("of"))
    return keys.unionByName(sessions).join(accounts, F.col("of") == F.col("n_nationkey")).select("kind", "id", "account")


def j15_identified(spark: SparkSession, d: str) -> DataFrame:
    """Listed items with what their headers say; an item without headers stays as it is."""
    headers = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("sender"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("subject"))
    items = table(spark, d, "orders").join(headers, F.col("o_custkey") == F.col("uid"), "left")
    met = F.col("uid").isNotNull()
    return items.select("o_orderkey", F.when(met, F.col("sender")).otherwise("unknown").alias("sender"), F.when(met, F.col("subject")).otherwise(F.col("o_orderpriority")).alias("subject"))


def a21_lag(spark: SparkSession, d: str) -> DataFrame:
    """Lag between a user's deliveries: samples, mean in whole milliseconds (null without samples) and most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    lags = table(spark, d, "events").select("user_id", F.floor((micros - F.lag(micros).over(w)) / 1000).alias("lag"))
    return lags.groupBy("user_id").agg(F.count("lag").alias("samples"), F.floor(F.sum("lag") / F.count("lag") + 0.5).cast("long").alias("mean_ms"), F.max("lag").cast("long").alias("most_ms"))


def p10_attachment_summary(spark: SparkSession, d: str) -> DataFrame:
    """What is shown of an attachment: no bytes, and a default for what is missing."""
    named = F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("part-"), F.col("l_partkey").cast("string"), F.lit(".pdf")))
    inline = F.coalesce(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag") == "R"), F.lit(False))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", named.alias("filename"), F.lower("l_linestatus").alias("content_type"), F.col("l_quantity").cast("long").alias("size"), inline.alias("inline"))


def p17_public_mailbox(spark: SparkSession, d: str) -> DataFrame:
    """A mailbox as its owner sees it: addresses are built, secrets stay out, and the first endpoint stands for the old single one."""
    hooks = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("webhook_url"), F.count("*").alias("webhooks"), F.count_if(F.col("s_acctbal") > 0).alias("active"))
    slug = F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))
    rows = table(spark, d, "customer").join(hooks, F.col("c_nationkey") == F.col("s_nationkey"), "left")
    shown = F.concat(F.lit("m"), F.col("c_custkey").cast("string"), F.lit("@in.example.org"))
    return rows.select("c_custkey", shown.alias("address"), F.concat(slug, F.lit("@in.example.org")).alias("alias"), "webhook_url", F.coalesce("webhooks", F.lit(0)).alias("webhooks"), F.coalesce("active", F.lit(0)).alias("active"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3].rstrip("0123456789") in ("f", "j", "a", "w", "l", "u", "k", "r", "p") and n[1:3].isdigit()}

_CENTS = lambda x: f"CAST(round({x} * 100) AS BIGINT)"
_REVIEW = "len(list_filter(flags, lambda f: (string_split(f, ':')[1] IN ({}) AND contains(f, ':')) OR f IN ({}))) > 0".format(", ".join(f"'{x}'" for x in REVIEW_FAMILIES), ", ".join(f"'{x}'" for x in REVIEW_FLAGS))
_EVENTS = f"(SELECT *, {_FLAGS_SQL} AS flags FROM events)"
_AGE = lambda now, t: f"CAST(epoch(TIMESTAMP '{now}') AS BIGINT) - CAST(floor(epoch({t})) AS BIGINT)"
ORACLE_SQL = {
    "f01_tenant_filter": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderstatus <> 'P'",
    "f02_half_open_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-03-01'",
    "f03_literal_contains": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), '%%% ')",
    "f04_any_recipient": "SELECT p_partkey, p_name FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 're'))) > 0",
    "f05_json_tag": "SELECT event_id, user_id FROM events WHERE lower(json_extract_string(props, '$.k')) = '42'",
    "f06_keyset": "SELECT event_id, event_type FROM events WHERE event_id < 500",
    "f07_f12_needs_review": f"SELECT event_id FROM {_EVENTS} WHERE {_REVIEW}",
    "f08_has_flag": f"SELECT event_id, CAST(len(flags) AS BIGINT) AS n_flags FROM {_EVENTS} WHERE list_contains(flags, 'newsletter')",
    "f09_dynamic_predicates": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000 AND o_orderpriority LIKE '1%' AND o_custkey IN (1, 2, 3, 4, 5, 6)",
    "f10_calendar_days": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-02-01' AND DATE '1994-02-05'",
    "f11_any_candidate": "SELECT c_custkey FROM customer WHERE contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')",
    "f13_auth_flags": """SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 1 THEN 'auth_fail:spf:fail' WHEN event_id % 5 = 3 THEN 'auth_fail:spf:softfail' END, CASE WHEN event_id % 3 = 2 THEN 'auth_fail:dkim:fail' END) AS flags
        FROM events WHERE event_id % 5 IN (1, 3) OR event_id % 3 = 2""",
    "f14_traffic_class": """SELECT CASE WHEN event_type = 'purchase' THEN 'counted' WHEN CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0 THEN 'opted_out' WHEN user_id < 20 THEN 'internal' ELSE 'page' END AS class, count(*) AS n FROM events GROUP BY 1""",
    "f15_placeholder_null": f"""SELECT event_id, CASE WHEN NOT regexp_matches(trim(raw), '{PLACEHOLDER}') THEN raw END AS kept
        FROM (SELECT event_id, ['N/A', 'unknown', '--', 'Not found', 'keine Angabe', '12.50', 'none today', 'n a'][event_id % 8 + 1] AS raw FROM events)""",
    "f17_retention_keep": "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - CAST([30, 90, 365][o_custkey % 3 + 1] AS INT)",
    "f18_stranded": f"SELECT event_id, age_s FROM (SELECT event_id, event_type, {_AGE('2024-01-10', 'ts')} AS age_s FROM events) WHERE event_type = 'click' AND age_s BETWEEN 900 AND 172800",
    "f21_review_split": f"SELECT CASE WHEN {_REVIEW} THEN 'review' ELSE 'clean' END AS branch, count(*) AS n, min(event_id) AS first_id FROM {_EVENTS} GROUP BY 1",
    "j01_message_mailbox": "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
    "j02_left_blob": "SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "j03_ownership": "SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "j04_feed_page": "SELECT event_id, user_id, c_name AS mailbox, n_name AS account FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE event_id > 100 ORDER BY event_id LIMIT 50",
    "j05_coalesced_right": "SELECT p_partkey, coalesce(s_name, p_brand) AS secret FROM part LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON p_partkey % 100 + 1 = s_suppkey",
    "j06_routing": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "j08_review_queue": f"SELECT event_id, c_name FROM {_EVENTS} JOIN customer ON user_id = c_custkey WHERE {_REVIEW} ORDER BY event_id DESC LIMIT 50",
    "j09_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "j10_not_in_guarded": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)",
    "j11_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "j13_membership": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "j14_per_plan_delete": """SELECT plan, count(*) AS kept FROM orders JOIN customer ON o_custkey = c_custkey JOIN (VALUES ('AUTOMOBILE', 100), ('BUILDING', 400), ('FURNITURE', 900)) p(plan, days) ON c_mktsegment = plan
        WHERE CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - days GROUP BY plan""",
    "a01_daily_totals": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS views, count(*) FILTER (event_type = 'view') AS visits FROM events GROUP BY 1",
    "a02_totals_by_page": f"SELECT event_type, count(*) AS views, CAST(sum({_CENTS('value')}) AS BIGINT) AS value_cents FROM events GROUP BY 1",
    "a03_conditional_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1",
    "a04_usage": f"SELECT count(*) AS stored, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS month, count(*) FILTER ({_REVIEW}) AS review, count(*) FILTER (value IS NULL) AS empty FROM {_EVENTS}",
    "a05_fold_other": """WITH c AS (SELECT CAST(user_id AS VARCHAR) AS user, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT user FROM c WHERE n >= 3 ORDER BY n DESC, user LIMIT 25)
        SELECT CASE WHEN user IN (SELECT user FROM k) THEN user ELSE '(other)' END AS user, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "a06_flag_histogram": f"SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM {_EVENTS}) GROUP BY flag ORDER BY n DESC, flag LIMIT 12",
    "a07_capped_count": "SELECT least(count(*), 5000) AS n FROM orders WHERE o_orderstatus = 'F'",
    "a08_too_old": "SELECT count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest FROM events WHERE event_type = 'click'",
    "a09_a10_rollup_merge": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS path, count(*) AS views FROM events GROUP BY 1, 2",
    "a11_mean_confidence": "SELECT user_id, ((sum(v) * 200 + count(v)) // nullif(count(v) * 2, 0)) / 10000 AS confidence FROM (SELECT user_id, CASE WHEN value > 10 THEN CAST(floor(value) AS BIGINT) END AS v FROM events) GROUP BY user_id",
    "a12_calibration": """SELECT CASE WHEN c >= 0.9 THEN '0.9' WHEN c >= 0.7 THEN '0.7' WHEN c >= 0.5 THEN '0.5' ELSE 'below' END AS bucket, count(*) AS n, count(*) FILTER (quality = 1) AS "right", count(*) FILTER (quality = 1 AND toxic = 1) AS fp
        FROM (SELECT least(1.0, n_chars / 4000) AS c, quality, toxic FROM documents JOIN labels USING (doc_id)) GROUP BY 1""",
    "a13_percentiles": f"""WITH s AS (SELECT o_orderpriority, list_sort(list({_CENTS('o_totalprice')})) AS l FROM orders GROUP BY 1)
        SELECT o_orderpriority, l[least(len(l), CAST(floor(len(l) * 50 / 100) AS BIGINT) + 1)] AS p50, l[least(len(l), CAST(floor(len(l) * 95 / 100) AS BIGINT) + 1)] AS p95, l[least(len(l), CAST(floor(len(l) * 99 / 100) AS BIGINT) + 1)] AS p99 FROM s""",
    "a14_duplicates": "SELECT md5(text) AS digest, lang, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "a15_mode": "SELECT l_returnflag, l_linenumber AS mode FROM (SELECT l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linenumber DESC) AS no FROM lineitem GROUP BY 1, 2) WHERE no = 1",
    "a16_first_of_key": "SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS no FROM lineitem) WHERE no = 1",
    "a17_distinct_in_order": """SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)""",
    "a18_a19_reconcile": f"""SELECT o_orderkey, sum_cents, {_CENTS('o_totalprice')} AS total_cents, abs(sum_cents - {_CENTS('o_totalprice')}) <= greatest(2.0, abs({_CENTS('o_totalprice')}) * 0.005) AS reconciles
        FROM orders JOIN (SELECT l_orderkey, CAST(sum({_CENTS('l_extendedprice * (1 - l_discount) * (1 + l_tax)')}) AS BIGINT) AS sum_cents FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "a22_refund": "SELECT p_partkey, CAST(greatest(0, p_size - 10) AS BIGINT) AS used FROM part",
    "w02_anchor_run": """WITH r AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER w AS at_, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS upto FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)),
        p AS (SELECT a.l_orderkey, b.at_ - a.at_ + 1 AS n, a.at_ AS start FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.at_ > a.at_ AND b.upto - a.upto + a.q = 50)
        SELECT l_orderkey, n, start FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, start) AS no FROM p) WHERE no = 1""",
    "w10_feed_order": "SELECT conv_id, turn, row_number() OVER w AS place, lag(role) OVER w AS after_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "l01_keyset_page": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY 2 DESC, 1 DESC LIMIT 26",
    "l02_clamped_limit": "SELECT p_partkey FROM part ORDER BY 1 LIMIT 200",
    "l03_forward_feed": "SELECT event_id, event_type, true AS has_more FROM events WHERE event_id > 250 ORDER BY 1 LIMIT 40",
    "l04_due_row": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS due FROM events WHERE event_type = 'purchase' ORDER BY 2, 1 LIMIT 1",
    "l09_row_cap": "SELECT doc_id, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS rows, CAST(len(string_split(text, chr(10))) AS BIGINT) AS row_count, len(string_split(text, chr(10))) > 3 AS truncated FROM documents",
    "u01_u02_flag_sets": """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(b, a))), ',') AS both, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS added,
        array_to_string(list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))), ',') AS removed FROM (SELECT p_partkey, string_split(p_type, ' ') AS b, string_split(p_name, ' ') AS a FROM part)""",
    "u03_result_diff": """WITH o AS (SELECT c_custkey, c_mktsegment AS old_value FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS new_value FROM customer WHERE c_custkey % 11 <> 0)
        SELECT c_custkey, old_value, new_value, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (c_custkey) WHERE old_value IS DISTINCT FROM new_value""",
    "u04_table_union": "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
    "u06_bounded_distinct": r"""WITH w AS (SELECT item_id, regexp_split_to_array(trim(text), '\s+') AS w FROM benchmark), k AS (SELECT item_id, list_filter(w, lambda x, i: NOT list_contains(w[i + 1 :], x)) AS k FROM w)
        SELECT item_id, array_to_string(k[greatest(1, len(k) - 2) : ], ' ') AS last_words FROM k""",
    "k01_idempotent_insert": """WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS key FROM documents)
        SELECT doc_id, source, key FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY doc_id) AS no FROM r WHERE key IS NOT NULL) WHERE no = 1 UNION ALL SELECT * FROM r WHERE key IS NULL""",
    "k04_blob_expiry": "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 90, '%Y-%m-%d') AS expires FROM orders WHERE CAST(o_orderdate AS DATE) + 90 > DATE '1998-06-01'",
    "k06_fan_out": "SELECT o_orderkey, s_suppkey AS endpoint FROM orders JOIN supplier ON o_custkey BETWEEN s_suppkey AND s_suppkey + 2 WHERE s_acctbal > 0",
    "k08_r10_attempt": """WITH e AS (SELECT event_id, event_id % 7 + 1 AS attempt, [200, 404, 408, 429, 500, 503][event_id % 6 + 1] AS status FROM events),
        s AS (SELECT *, CASE WHEN status = 200 THEN 'delivered' WHEN status = 404 THEN 'failed' WHEN attempt >= 6 THEN 'exhausted' ELSE 'retry' END AS state FROM e)
        SELECT event_id, attempt, state, CAST(CASE WHEN state = 'retry' THEN [30, 120, 600, 3600, 21600][attempt] END AS BIGINT) AS wait_s FROM s""",
    "k10_spool_backoff": "SELECT event_id, CAST(CASE WHEN event_id % 30 < 24 THEN [0, 5, 15, 60, 300, 900, 3600, 21600][least(event_id % 30, 7) + 1] END AS BIGINT) AS wait_s FROM events",
    "k11_state_upsert": f"""WITH s AS (SELECT c_custkey AS id, c_name AS sn, {_CENTS('c_acctbal')} AS sc FROM customer WHERE c_custkey % 4 <> 0), f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'renamed' END AS n, c_custkey AS c FROM customer WHERE c_custkey % 3 = 0)
        SELECT id, coalesce(n, sn) AS name, coalesce(c, sc) AS cursor FROM s FULL JOIN f USING (id)""",
    "k13_payload": """SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '","mailbox":"' || c_name || '"}' AS payload FROM orders JOIN customer ON o_custkey = c_custkey""",
    "r06_day_window": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1",
    "r07_r08_quota": "SELECT event_id, strftime(ts, '%Y-%m') AS month, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 5 AS accepted FROM events",
    "r12_circuit_breaker": """WITH r AS (SELECT user_id, value < 60 AS failed, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
        g AS (SELECT user_id, island, count(*) FILTER (failed) AS n FROM r GROUP BY 1, 2) SELECT user_id, max(n) AS longest, max(n) >= 5 AS disabled FROM g GROUP BY 1""",
    "r13_late_policy": f"""WITH e AS (SELECT event_id, {_AGE('2024-01-20', 'ts')} AS age FROM events)
        SELECT CASE WHEN age > 172800 THEN 'too_old' WHEN event_id % 6 > 3 THEN 'abandon' WHEN age > 900 THEN 'replay' ELSE 'wait' END AS action, count(*) AS n FROM e GROUP BY 1""",
    "r14_ttl": "SELECT count(*) AS kept FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-07-02'",
    "r17_backoff": "SELECT DISTINCT l_orderkey, l_linenumber, CAST(least(60000, 500 * pow(2, l_linenumber - 1)) AS BIGINT) AS delay_ms FROM lineitem",
    "r19_latest_version": "SELECT o_custkey, max(o_orderkey) AS version, max_by(o_orderpriority, o_orderkey) AS schema FROM orders GROUP BY 1",
    "j07_credentials": """SELECT 'key' AS kind, s_suppkey AS id, n_name AS account FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0
        UNION ALL SELECT 'session', c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0""",
    "j15_identified": """SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE c_name END AS sender, CASE WHEN c_custkey IS NULL THEN o_orderpriority WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS subject
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""",
    "a21_lag": """WITH l AS (SELECT user_id, CAST(floor((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000) AS BIGINT) AS lag FROM events)
        SELECT user_id, count(lag) AS samples, CAST(floor(sum(lag) / count(lag) + 0.5) AS BIGINT) AS mean_ms, max(lag) AS most_ms FROM l GROUP BY 1""",
    "p10_attachment_summary": """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN 'part-' || l_partkey || '.pdf' END AS filename, lower(l_linestatus) AS content_type, CAST(l_quantity AS BIGINT) AS size,
        l_linenumber % 3 <> 0 AND l_returnflag = 'R' AS inline FROM lineitem""",
    "p17_public_mailbox": """WITH h AS (SELECT s_nationkey, min_by(s_name, s_suppkey) AS webhook_url, count(*) AS webhooks, count(*) FILTER (s_acctbal > 0) AS active FROM supplier GROUP BY 1)
        SELECT c_custkey, 'm' || c_custkey || '@in.example.org' AS address, lower(replace(c_name, '#', '-')) || '@in.example.org' AS alias, webhook_url, coalesce(webhooks, 0) AS webhooks, coalesce(active, 0) AS active
        FROM customer LEFT JOIN h ON c_nationkey = s_nationkey""",
    "r20_first_conversion": """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
        SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM e WHERE event_type = 'purchase' AND (was IS NULL OR was <> 'purchase')) WHERE no = 1""",
}

"""Registered domains by public-suffix rules.

A rule is exact (``co.uk``), a wildcard (``*.ck``: any name right under it) or an exception to one (``!www.ck``). The rules are a
table, read from a list in the usual format; the suffixes of each distinct domain are exploded and joined with it, and the longest
that a rule names decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import HOST, let
from ..sources.tables import table

#: Second-level words that are public suffixes under country codes, for use without a table of rules.
SECOND_LEVEL = "ac co com edu gob gov govt ltd me ne net or org plc sch".split()


def parsed_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """(kind, suffix) of the lines of a list; comments and blank lines aside."""
    text = F.lower(F.trim(F.col(line)))
    rows = lines.select(F.split(text, r"\s+")[0].alias("rule")).where("rule <> '' AND rule NOT LIKE '//%'")
    kind = F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard").otherwise("exact")
    return rows.select(kind.alias("kind"), F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("suffix")).distinct()


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return parsed_rules(spark.read.text(path))


def plain_domain(domain: Column) -> Column:
    return F.regexp_replace(F.lower(domain), r"\.$", "")


def with_org_domain(rows: DataFrame, rules: DataFrame, domain: str, out: str = "org_domain") -> DataFrame:
    """``rows`` with the registered domain: a label below the longest public suffix, an exception itself, else the last two labels.

    A domain of one label is its own; a null or empty one has none."""
    each = rows.select(plain_domain(F.col(domain)).alias("__name")).where("__name <> ''").distinct()
    labels = F.split("__name", r"\.")
    cut = each.select("__name", F.size(labels).alias("__n"), F.posexplode(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).alias("__i", "__own"))
    above = F.regexp_extract("__own", r"^[^.]*\.(.+)$", 1)
    named = cut.select("__name", "__i", F.inline(F.array(F.struct(F.lit("exception").alias("kind"), F.col("__own").alias("suffix")), F.struct(F.lit("exact").alias("kind"), F.col("__own").alias("suffix")), F.struct(F.lit("wildcard").alias("kind"), above.alias("suffix")))))
    hits = named.where("suffix <> ''").join(rules.select("kind", "suffix").distinct(), ["kind", "suffix"])
    best = hits.groupBy("__name").agg(F.min(F.struct("__i", (F.col("kind") != "exception").alias("suffix"))).alias("best"))
    first = F.when(F.col("best").isNull(), F.size(labels) - 2).when(F.col("best.suffix"), F.col("best.__i") - 1).otherwise(F.col("best.__i"))
    kept = F.array_join(F.slice(labels, F.greatest(first, F.lit(0)) + 1, F.size(labels)), ".")
    found = each.join(best, "__name", "left").select(F.col("__name"), F.when(F.size(labels) <= 1, F.col("__name")).otherwise(kept).alias("__org"))
    return rows.drop(out).join(found, plain_domain(F.col(domain)) == F.col("__name"), "left").withColumn(out, F.col("__org")).drop("__name", "__org")


def org_domain(domain: Column) -> Column:
    """The registered domain without a table of rules: two labels, or three below a usual second-level word of a country."""

    def of(labels: Column) -> Column:
        last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
        public = (F.size(labels) >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, F.size(labels) - 2).isin(SECOND_LEVEL)
        return F.when(public, last(3)).otherwise(last(2))

    return let(F.split(plain_domain(domain), r"\."), of)


# Queries

#: Rules for the hosts of the query.
RULES = ("com", "org", "example", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp")
ENDINGS = (".co.uk", ".uk", ".shop.ck", ".www.ck", ".x.kobe.jp", ".city.kobe.jp", ".unlisted", "")


def j19_org_domain(spark: SparkSession, d: str) -> DataFrame:
    """Registered domains of hosts, under their own and other endings, by rules."""
    rules = parsed_rules(spark.createDataFrame([(r,) for r in RULES], "value string"))
    ending = F.get(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS)).cast("int"))
    hosts = table(spark, d, "pages").select("page_id", F.concat(F.lower(F.regexp_extract("url", HOST, 1)), ending).alias("host"))
    return with_org_domain(hosts, rules, "host", "org").select("page_id", "org")


QUERIES = {"j19_org_domain": j19_org_domain}
ORACLE_SQL = {
    "j19_org_domain": f"""WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '{HOST}', 1)) || [{', '.join(f"'{e}'" for e in ENDINGS)}][page_id % {len(ENDINGS)} + 1], '.') AS l, page_id % {len(ENDINGS)} AS k FROM pages),
        n AS (SELECT page_id, l, CASE k WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 3 ELSE 2 END AS n FROM h)
        SELECT page_id, array_to_string(l[greatest(1, len(l) - n + 1) :], '.') AS org FROM n""",
}

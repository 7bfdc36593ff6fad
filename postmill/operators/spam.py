"""The part of the spam score that envelope and headers give, as rules with points.

Headers are a map from lower-case names to values (unfolded, in the order of the message). Every rule is a
condition over the row, so scoring is a projection. The body's rules are in ``functions.text``, those of
authentication in ``authentication``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, spam_score
from ..sources.tables import table
from .suffixes import org_domain

#: Points of the rules over envelope and headers.
POINTS = {
    "no-tls": 0.5, "helo-is-bare-ip": 0.6, "helo-not-fqdn": 0.8, "helo-generic": 1.0, "no-message-id": 1.0, "malformed-message-id": 0.4, "no-date": 0.6, "unparseable-date": 0.4, "date-skew>30d": 0.5,
    "no-from": 1.5, "multiple-from-headers": 1.5, "multiple-subject-headers": 1.0, "empty-subject": 0.3, "shouting-subject": 0.6, "exclamation-storm": 0.4, "mixed-script-subject": 0.5, "fake-reply-subject": 0.5,
    "envelope/header from mismatch": 0.7, "display-name-spoofs-address": 1.2, "high-priority": 0.2, "precedence-bulk": 0.3, "upstream-x-spam-flag": 2.5, "no-received-chain": 0.5, "bcc-header-present": 0.4, "undisclosed-recipients": 0.5, "html-only": 0.3,
}
MOST_SKEW_DAYS = 30
BARE_HELO, GENERIC_HELO = r"^\[?\d{1,3}(\.\d{1,3}){3}\]?$", r"^(localhost|localdomain|friend|user|pc|desktop)\b"


def header_spam(headers: Column, helo: Column, tls: Column, mail_from: Column, dmarc: Column, now: Column) -> Column:
    """array<struct<rule, points>> of the rules that hold, in the order of ``POINTS``.

    A null map has no headers; an unknown greeting, transport or sender charges nothing."""
    values = lambda name: F.coalesce(F.try_element_at(headers, F.lit(name)), F.array().cast("array<string>"))
    first = lambda name: F.coalesce(F.get(values(name), F.lit(0)), F.lit(""))
    lowered = lambda name: F.lower(first(name))

    def rules(x: Column) -> Column:
        subject, sender, greeting = x["subject"], x["sender"], x["helo"]
        inner = F.regexp_extract(sender, "<([^>]+)>", 1)
        address = F.lower(F.trim(F.when(inner != "", inner).otherwise(sender)))
        shown = F.lower(F.trim(F.regexp_replace(F.regexp_replace(sender, "<[^>]*>", ""), "[\"']", "")))
        letters = F.regexp_replace(subject, "[^A-Za-z]", "")
        domain = lambda a: org_domain(F.substring_index(a, "@", -1))
        sent = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(x["date"], r"^[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)$", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
        bare, dotless = greeting.rlike(BARE_HELO), ~F.contains(greeting, F.lit("."))
        holds = {
            "no-tls": ~tls, "helo-is-bare-ip": bare, "helo-not-fqdn": (greeting != "") & ~bare & dotless, "helo-generic": ~bare & ~dotless & greeting.rlike(GENERIC_HELO),
            "no-message-id": x["id"] == "", "malformed-message-id": (x["id"] != "") & ~x["id"].rlike("^<[^>]+@[^>]+>$"),
            "no-date": x["date"] == "", "unparseable-date": (x["date"] != "") & sent.isNull(), "date-skew>30d": F.abs(F.unix_millis(now) - F.unix_millis(sent)) > MOST_SKEW_DAYS * 86_400_000,
            "no-from": sender == "", "multiple-from-headers": F.size(values("from")) > 1, "multiple-subject-headers": F.size(values("subject")) > 1,
            "empty-subject": F.trim(subject) == "", "shouting-subject": (F.length(letters) >= 8) & (letters == F.upper(letters)), "exclamation-storm": F.regexp_count(subject, F.lit("!")) >= 3,
            "mixed-script-subject": subject.rlike("[Ѐ-ӿ]") & subject.rlike("[A-Za-z]"), "fake-reply-subject": F.lower(subject).rlike("^(re|fwd?):") & (first("in-reply-to") == "") & (first("references") == ""),
            "envelope/header from mismatch": (mail_from != "") & F.contains(address, F.lit("@")) & (domain(F.lower(mail_from)) != domain(address)) & (F.coalesce(dmarc, F.lit("")) != "pass"),
            "display-name-spoofs-address": F.contains(shown, F.lit("@")) & (inner != "") & ~F.contains(shown, address),
            "high-priority": (first("x-priority") == "1") | (lowered("importance") == "high"), "precedence-bulk": lowered("precedence").rlike("bulk|junk"), "upstream-x-spam-flag": lowered("x-spam-flag") == "yes",
            "no-received-chain": first("received") == "", "bcc-header-present": first("bcc") != "", "undisclosed-recipients": lowered("to") == "undisclosed-recipients:;", "html-only": lowered("content-type").startswith("text/html"),
        }
        return F.transform(F.filter(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(p).alias("points"), F.coalesce(holds[r], F.lit(False)).alias("on")) for r, p in POINTS.items())), lambda r: r["on"]), lambda r: F.struct(r["rule"].alias("rule"), r["points"].alias("points")))

    return let(F.struct(first("subject").alias("subject"), first("from").alias("sender"), first("date").alias("date"), first("message-id").alias("id"), F.lower(F.coalesce(helo, F.lit(""))).alias("helo")), rules)


# Queries

def v07_header_rules(spark: SparkSession, d: str) -> DataFrame:
    """Mails of all customers, whose envelopes and headers meet the rules in turn."""
    k = F.col("c_custkey")
    turn = lambda *values: F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k % len(values)).cast("int"))
    one = lambda *values: turn(*(F.lit(None).cast("array<string>") if v is None else F.array(*map(F.lit, v)) for v in values))
    headers = F.create_map(
        F.lit("message-id"), one(None, ["<a@b.c>"], ["a@b.c"], ["<a@b.c>"]),
        F.lit("date"), one(None, ["Sat, 2 Mar 2024 10:00:00 +0100"], ["1 Jan 2024 00:00:00 +0000"], ["some day"], ["Mon, 4 Mar 2024 08:00:00 -0500 (EST)"]),
        F.lit("from"), one(['"billing@bank.example" <x@evil.example>'], ["A <a@mail.example.org>"], None, ["a@example.org"], ["a@example.org", "b@example.org"], ['"a@example.org" <a@example.org>'], ["no address"]),
        F.lit("subject"), one(["RE: STATEMENT OF ACCOUNT"], ["Wow!!! Счёт"], [""], ["Hello there"], None, ["One", "Two"], ["Fwd: news"], ["SHORT"]),
        F.lit("x-priority"), one(["1"], None, ["3"]), F.lit("precedence"), one(None, ["Bulk"], ["list"]), F.lit("x-spam-flag"), one(None, None, None, ["YES"], ["no"]), F.lit("received"), one(["from a by b"], None),
        F.lit("bcc"), one(None, ["x@y.z"], None), F.lit("to"), one(["a@b.c"], ["Undisclosed-recipients:;"], None), F.lit("content-type"), one(["text/plain"], ["text/html; charset=utf-8"], None),
    )
    helo = turn("[10.0.0.1]", "mailhost", "localhost.localdomain", "mx.example.org", F.lit(None).cast("string"))
    found = header_spam(headers, helo, turn(True, False, F.lit(None).cast("boolean")), turn("bounce@Lists.example.org", F.lit(None).cast("string")), turn("none", "pass", "fail"), F.lit("2024-03-05T00:00:00Z").cast("timestamp"))
    rows = table(spark, d, "customer").select("c_custkey", found.alias("found"))
    return rows.select("c_custkey", spam_score(F.col("found")).alias("score"), F.array_join(F.transform("found", lambda r: r["rule"]), ",").alias("reasons"))


QUERIES = {"v07_header_rules": v07_header_rules}

#: Which turns of the sample meet a rule, worked out by hand.
_MET = {
    "no-tls": "k % 3 = 1", "helo-is-bare-ip": "k % 5 = 0", "helo-not-fqdn": "k % 5 = 1", "helo-generic": "k % 5 = 2", "no-message-id": "k % 4 = 0", "malformed-message-id": "k % 4 = 2",
    "no-date": "k % 5 = 0", "unparseable-date": "k % 5 = 3", "date-skew>30d": "k % 5 = 2", "no-from": "k % 7 = 2", "multiple-from-headers": "k % 7 = 4", "multiple-subject-headers": "k % 8 = 5", "empty-subject": "k % 8 IN (2, 4)",
    "shouting-subject": "k % 8 = 0", "exclamation-storm": "k % 8 = 1", "mixed-script-subject": "k % 8 = 1", "fake-reply-subject": "k % 8 IN (0, 6)", "envelope/header from mismatch": "k % 7 = 0 AND k % 2 = 0 AND k % 3 <> 1",
    "display-name-spoofs-address": "k % 7 = 0", "high-priority": "k % 3 = 0", "precedence-bulk": "k % 3 = 1", "upstream-x-spam-flag": "k % 5 = 3", "no-received-chain": "k % 2 = 1", "bcc-header-present": "k % 3 = 1", "undisclosed-recipients": "k % 3 = 1", "html-only": "k % 3 = 1",
}
ORACLE_SQL = {
    "v07_header_rules": f"""WITH c AS (SELECT c_custkey, c_custkey AS k FROM customer),
        r AS (SELECT c_custkey, list_filter([{', '.join(f"{{'rule': '{r}', 'points': CAST({p} AS DOUBLE), 'met': {_MET[r]}}}" for r, p in POINTS.items())}], lambda x: x.met) AS l FROM c)
        SELECT c_custkey, round(least(10.0, coalesce(list_sum(list_transform(l, lambda x: x.points)), 0)), 2) AS score, array_to_string(list_transform(l, lambda x: x.rule), ',') AS reasons FROM r""",
}

"""Rows of the store and canonical forms."""

import ipaddress

from pyspark.sql import functions as F

from postmill.operators import records as R


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "v string").select(of(F.col("v"))).first()[0]


def test_canonical_forms(spark):
    assert one(spark, " a \t b\r\n\tc ", lambda v: R.canonical_header(F.lit(" SubJect "), v)) == "subject:a b c\r\n"
    for body, simple, relaxed in (("", "\r\n", ""), ("\r\n\r\n", "\r\n", ""), ("a  b \r\n\r\n", "a  b \r\n", "a b\r\n"), ("x", "x\r\n", "x\r\n")):
        assert (one(spark, body, lambda v: R.canonical_body(v, False)), one(spark, body, lambda v: R.canonical_body(v, True))) == (simple, relaxed)


def test_addresses(spark):
    assert tuple(one(spark, '"a@b"@Example.org', R.split_address)) == ('"a@b"', "example.org")
    for bad in ("", "a", "@b", "a@", "a b@-x", None, "x" * 65 + "@b.c"):
        assert one(spark, bad, R.split_address) is None
    assert one(spark, '"Doe, J" <j@Mail.example.org>', R.from_domain) == "mail.example.org"
    assert [one(spark, h, R.address_count) for h in ('"Doe, J" <j@x.y>', "a@b.c, d@e.f", "", None)] == [1, 2, 0, 0]


def test_ip_forms(spark):
    for ip in ("2001:0db8:0000:0000:0001:0000:0000:0001", "2001:db8::1", "::1", "::", "fe80:0:0:1::", "1:2:3:4:5:6:7:8", "1:0:2:0:0:3:0:0"):
        assert one(spark, ip, R.plain_ip) == str(ipaddress.ip_address(ip)), ip
    assert [one(spark, v, R.plain_ip) for v in ("::FFFF:1.2.3.4", " 1.2.3.4 ", None, "fe80::1%eth0")] == ["1.2.3.4", "1.2.3.4", "", "fe80::1%eth0"]
    assert one(spark, "1.2.3.4", R.reverse_name) == "4.3.2.1.in-addr.arpa"


def test_times_links_pages(spark):
    at = lambda t: str(one(spark, t, lambda v: F.date_format(R.read_datetime(v, F.lit("2024-02-03").cast("date")), "HH:mm:ss")))
    assert [at(t) for t in ("12:05 am", "12:05 pm", "1:02:03 PM", "23:59", "25:00", "none")] == ["00:05:00", "12:05:00", "13:02:03", "23:59:00", "00:00:00", "00:00:00"]
    assert [one(spark, u, lambda v: R.trusted_link(v, F.lit(True))) for u in ("https://a.b/c", "javascript:alert(1)", None)] == [True, False, False]
    items = spark.range(10).withColumnRenamed("id", "uid")
    assert [r[0] for r in R.uid_page(items, 3, 2).collect()] == [4, 5] and [r[0] for r in R.uid_page(items, 3, 2, tail=True).collect()] == [8, 9]

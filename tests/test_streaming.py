import ipaddress
import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postmill.operators import authentication as auth
from postmill.operators import suffixes
from postmill.sources import mailbox
from postmill.streaming import sinks, stateful

DNS = [
    ("x.org", "TXT", ["v=spf1 ip4:10.0.0.0/8 include:y.org a:h.org mx -all", "other"]), ("y.org", "TXT", ["v=spf1 ip6:2001:db8::/32 ip4:192.0.2.7 ~all"]), ("h.org", "A", ["203.0.113.5"]), ("x.org", "MX", ["m.x.org"]), ("m.x.org", "A", ["198.51.100.9"]),
    ("r.org", "TXT", ["v=spf1 redirect=x.org"]), ("two.org", "TXT", ["v=spf1 -all", "v=spf1 +all"]), ("loop.org", "TXT", ["v=spf1 include:loop.org -all"]), ("_dmarc.x.org", "TXT", ["v=DMARC1; p=reject; sp=quarantine; adkim=s"]),
]


def test_spf_and_dmarc(spark):
    dns = spark.createDataFrame(DNS, "name string, type string, answers array<string>")
    cases = [("10.1.2.3", "x.org", "pass"), ("192.0.2.7", "x.org", "pass"), ("2001:db8::1", "x.org", "pass"), ("203.0.113.5", "X.org", "pass"), ("198.51.100.9", "r.org", "pass"), ("8.8.8.8", "x.org", "fail"), ("8.8.8.8", "y.org", "softfail"), ("8.8.8.8", "none.org", "none"), ("8.8.8.8", "two.org", "permerror"), ("8.8.8.8", "loop.org", "permerror"), (None, "x.org", "none")]
    mail = spark.createDataFrame([(i, a, d) for i, (a, d, _) in enumerate(cases)], "id int, remote_ip string, mail_from_domain string")
    got = {r["id"]: r["spf"] for r in auth.with_spf(mail, dns).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    chain = [(f"c{i}.org", "TXT", [f"v=spf1 include:c{i + 1}.org -all"]) for i in range(11)] + [("c11.org", "TXT", ["v=spf1 ip4:192.0.2.0/24 -all"])]
    far = auth.with_spf(spark.createDataFrame([(0, "192.0.2.1", "c0.org"), (1, "192.0.2.1", "C1.org"), (2, "9.9.9.9", "c1.org")], mail.schema), spark.createDataFrame(chain, dns.schema))
    assert [r["spf"] for r in far.orderBy("id").collect()] == ["permerror", "pass", "fail"]  # eleven lookups, ten, ten

    mail = spark.createDataFrame([(1, "x.org", "pass", "m.x.org", "none", None), (2, "s.x.org", "fail", "x.org", "pass", "x.org"), (3, "s.x.org", "fail", "x.org", "pass", "s.x.org"), (4, "z.net", "pass", "z.net", "none", None)], "id int, from_domain string, spf string, spf_domain string, dkim string, dkim_domain string")
    rows = {r["id"]: r for r in auth.with_dmarc(mail, dns).withColumn("points", auth.auth_points()).collect()}
    assert [rows[i]["dmarc"] for i in (1, 2, 3, 4)] == ["pass", "fail", "pass", "none"] and rows[2]["dmarc_policy"] == "quarantine"
    assert rows[2]["points"] == 2.0 - 0.5 + 2.0


def test_cidr(spark):
    df = spark.createDataFrame([("10.1.2.3", "10.0.0.0/8", True), ("11.1.2.3", "10.0.0.0/8", False), ("1.2.3.4", "1.2.3.4", True), ("1.2.3.5", "1.2.3.4", False), ("9.9.9.9", "0.0.0.0/0", True)], "ip string, net string, want boolean")
    assert df.where(~auth.in_cidr(F.col("ip"), F.col("net")).eqNullSafe(F.col("want"))).count() == 0
    ips = ["2001:db8::1", "2001:DB8:8000::1", "::", "::1", "::ffff:10.1.2.3", "10.1.2.3", "10.1.2.255", "fe80:0:0:1::", "1:2:3:4:5:6:7:8"]
    nets = ["2001:db8::/33", "2001:db8::/32", "::/0", "::1", "10.1.2.0/24", "10.1.2.3/32", "0.0.0.0/0", "fe80::/10", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:0/125"]
    plain = lambda a: getattr(a, "ipv4_mapped", None) or a
    cases = [(a, n, plain(ipaddress.ip_address(a)) in ipaddress.ip_network(n)) for a in ips for n in nets] + [(a, "::/0", None) for a in ("1.2.3", "1.2.3.4.", "1.2.3.256", "1::2::3", "1:2:3", "x", "", None)]
    got = spark.createDataFrame(cases, df.schema).withColumn("got", auth.in_cidr(F.col("ip"), F.col("net"))).collect()
    assert [tuple(r)[:3] for r in got if r["got"] != r["want"]] == []


def test_first_deliveries_keep_rows_without_a_key(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, "a", t), (1, "a", t + timedelta(1)), (1, None, t), (1, None, t), (2, "a", t)]
    feed = spark.createDataFrame(rows, "box int, mid string, ts timestamp")
    once, missing = stateful.first_deliveries(feed, ["box", "mid"])
    assert once.count() == 2 and missing.count() == 2
    stored = feed.limit(1)
    assert stateful.unseen(feed, stored, ["box", "mid"]).count() == 3
    day = stateful.daily_rollup(feed, ["box"])
    assert sorted((str(r["day"]), r["box"], r["n"]) for r in stateful.merged_rollup(day, day, ["box"]).collect()) == [("2024-01-01", 1, 6), ("2024-01-01", 2, 2), ("2024-01-02", 1, 2)]


def test_limits(spark):
    _, passed = stateful.token_bucket(None, [0.0] * 45 + [1.0] * 6)
    assert passed == [True] * 40 + [False] * 5 + [True] * 4 + [False] * 2
    _, passed = stateful.fixed_window(None, [0, 1, 2, 3600 * 3, 3600 * 3 + 1], most=2, hours=2)
    assert passed == [True, True, False, True, True]
    assert [stateful.item_action(*x) for x in ((0, 1, True, False, None), (0, 1 << 30, False, False, None), (0, 1, False, False, None), (3, 1, False, False, "net"), (1, 1, False, False, "net"))] == ["skip", "too_large", "deliver", "poison", "retry"]
    t = datetime(2024, 1, 1)
    feed = spark.createDataFrame([(k, t) for k in (1, 2) for _ in range(42)], "key int, ts timestamp")
    assert stateful.limited(feed, "key", stateful.token_bucket).where("passed").count() == 80


def test_mailbox_stream(spark, tmp_path):
    mailbox.register(spark)
    box, t = tmp_path / "box", datetime(2024, 1, 1)
    box.mkdir()
    item = lambda uid, mid, minutes=0: json.dumps({"uid": uid, "message_id": mid, "received_at": (t + timedelta(minutes=minutes)).isoformat(), "body": "b"})
    (box / "validity-1.jsonl").write_text("\n".join(item(u, f"m{u}") for u in (3, 1, 2)) + "\n")

    def drain(name):
        feed = spark.readStream.format("mailbox").option("path", str(box)).option("limit", "2").load()
        once, _ = stateful.first_deliveries(feed, ["message_id"], "received_at")
        q = once.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        yield [r["uid"] for r in spark.table(name).orderBy("uid").collect()]
        with (box / "validity-1.jsonl").open("a") as f:
            f.write(item(4, "m4") + "\n" + item(5, "m2", 1) + "\n")
        q.processAllAvailable()
        yield [r["uid"] for r in spark.table(name).orderBy("uid").collect()]
        (box / "validity-2.jsonl").write_text(item(1, "m1", 2) + "\n" + item(2, "m9", 2) + "\n")
        q.processAllAvailable()
        yield sorted(r["message_id"] for r in spark.table(name).collect())
        q.stop()

    first, second, third = drain("feed")
    assert first == [1, 2, 3] and second == [1, 2, 3, 4] and third == ["m1", "m2", "m3", "m4", "m9"]


def test_limits_of_a_table_are_cut_at_pauses(spark):
    rng, t = random.Random(3), datetime(2024, 1, 1)
    rows = [(k, t + timedelta(seconds=rng.randrange(9) * 4000 + rng.random() * 8)) for k in (1, 2) for _ in range(600)]
    feed = spark.createDataFrame(rows, "key int, ts timestamp")
    got = sorted((r["key"], r["at"], r["passed"]) for r in stateful.limited(feed, "key", stateful.token_bucket).collect())
    want = []
    for k in (1, 2):
        times = sorted(x for key, x in rows if key == k)
        want += list(zip([k] * 600, times, stateful.token_bucket(None, [x.timestamp() for x in times])[1], strict=True))
    assert got == sorted(want) and any(not x[2] for x in got)


def test_limited_stream_forgets_idle_keys(spark, tmp_path):
    t, at, log = datetime(2024, 1, 1), str(tmp_path / "in"), str(tmp_path / "log")
    put = lambda rows: spark.createDataFrame(rows, "key int, ts timestamp").coalesce(1).write.mode("append").parquet(at)
    put([(1, t)] * 45)
    feed = spark.readStream.schema("key int, ts timestamp").parquet(at)
    q = stateful.limited(feed, "key", stateful.token_bucket).writeStream.format("memory").queryName("limited").option("checkpointLocation", log).outputMode("append").start()
    known = lambda: sorted(r["key"]["key"] for r in spark.read.format("statestore").option("stateVarName", "kept").load(log).collect())
    try:
        q.processAllAvailable()
        put([(1, t + timedelta(seconds=1))] * 6 + [(2, t + timedelta(seconds=1))])
        q.processAllAvailable()
        assert spark.table("limited").where("key = 1 AND passed").count() == 44  # 40, and 4 refilled
        assert known() == [1, 2]
        put([(2, t + timedelta(minutes=40)), (3, t + timedelta(minutes=59))])
        q.processAllAvailable()
        assert known() == [1, 2, 3]
        put([(3, t + timedelta(minutes=90))])
        q.processAllAvailable()
        put([(3, t + timedelta(minutes=91))])
        q.processAllAvailable()
        assert known() == [2, 3]  # 1 has been idle for more than an hour
    finally:
        q.stop()


def test_sinks_take_a_batch_twice(spark, tmp_path):
    box = sinks.Table(str(tmp_path / "box"), StructType.fromDDL("id string, n int"), ["id"], ["n"])
    batch = lambda rows: spark.createDataFrame(rows, "id string, n int")
    first, second = batch([("a", 1), ("a", 2), ("b", 1), (None, 7), (None, 7)]), batch([("b", 5), ("c", 5)])
    state = lambda: sorted((r["id"] or "", r["n"]) for r in box.current(spark).collect())
    box.insert_new(first, 0)
    box.insert_new(second, 1)
    want = [("", 7), ("", 7), ("a", 1), ("b", 1), ("c", 5)]
    assert state() == want
    for rows, n in ((second, 1), (first, 0), (second, 1)):  # as after a crash before the commit, even out of order
        box.insert_new(rows, n)
        assert state() == want
    seen = sinks.Table(str(tmp_path / "seen"), StructType.fromDDL("id string, cursor int, note string"), ["id"])
    rows = lambda *r: spark.createDataFrame(r, "id string, cursor int, note string")
    steps = [rows(("x", 1, "one"), ("y", 1, None)), rows(("x", 2, None), (None, 9, "lost")), rows(("y", None, "late"))]
    for _ in range(2):
        for n, step in enumerate(steps):
            seen.merge(step, n, kept=("cursor", "note"))
        assert sorted(tuple(r)[:3] for r in seen.current(spark).collect()) == [("x", 2, "one"), ("y", 1, "late")]
    small = seen.compacted(spark, str(tmp_path / "small"), 2)
    assert small.history(spark).count() == 3 and sorted(tuple(r)[:3] for r in small.current(spark).collect()) == [("x", 2, "one"), ("y", 1, "late")]


def test_write_back_replaces_a_message_and_its_attachments(spark, tmp_path):
    out = sinks.WriteBack(sinks.Table(str(tmp_path / "m"), StructType.fromDDL("id int, status string"), ["id"]), sinks.Table(str(tmp_path / "a"), StructType.fromDDL("id int, name string"), ["id"]))
    feed, log = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "id int, status string, attachments array<struct<name:string>>"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)

    def now():
        messages, attachments = out.current(spark)
        return sorted((r["id"], r["status"]) for r in messages.collect()), sorted((r["id"], r["name"]) for r in attachments.collect())

    def run():
        q = spark.readStream.schema(schema).parquet(feed).writeStream.foreachBatch(out).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()

    put([(1, "parsed", [("a",), ("b",)]), (2, "parsed", [])])
    run()
    put([(1, "again", [("c",)])])
    run()
    want = ([(1, "again"), (2, "parsed")], [(1, "c")])
    assert now() == want
    out(spark.createDataFrame([(1, "again", [("c",)])], schema), 1)
    assert now() == want
    out.attachments.replace_rows(spark.createDataFrame([(1, "torn")], "id int, name string"), 2)  # a batch that died half-way
    assert now() == want


def test_spf_macros_and_names(spark):
    dns = [
        ("m.org", "TXT", ["v=spf1 exists:%{ir}.%{v}.%{d2}.x -all"]), ("4.3.2.1.in-addr.m.org.x", "A", ["127.0.0.2"]), ("l.org", "TXT", ["v=spf1 exists:%{L}.%{o}.ok exists:%{l1r-}.%{h}.ok2 -all"]), ("a-b%2Bc.l.org.ok", "A", ["127.0.0.2"]),
        ("a.helo.ok2", "A", ["127.0.0.3"]), ("p.org", "TXT", ["v=spf1 ptr -all"]), ("4.3.2.1.in-addr.arpa", "PTR", ["mail.p.org.", "other.net"]), ("mail.p.org", "A", ["1.2.3.4"]), ("9.3.2.1.in-addr.arpa", "PTR", ["mail.p.org"]),
        ("bad.org", "TXT", ["v=spf1 exists:%{x}.y -all"]), ("zero.org", "TXT", ["v=spf1 exists:%{d0}.y -all"]), ("six.org", "TXT", ["v=spf1 a:h6.org//64 exists:%{i}.six -all"]), ("h6.org", "AAAA", ["2001:db8::1"]),
        (".".join("20010db9" + "0" * 23 + "7") + ".six", "A", ["127.0.0.2"]), ("esc.org", "TXT", ["v=spf1 exists:%%.%-.%{d}.z -all"]), ("%.%20.esc.org.z", "A", ["127.0.0.2"]), ("two.org", "TXT", ["v=spf1 redirect=m.org redirect=p.org"]), ("junk.org", "TXT", ["v=spf1 foo:bar -all"]),
    ]
    cases = [
        ("1.2.3.4", "m.org", None, None, "pass"), ("1.2.3.5", "m.org", None, None, "fail"), ("1.2.3.4", "l.org", "a-b+c@l.org", None, "pass"), ("1.2.3.4", "l.org", "a-b@l.org", "helo", "pass"), ("1.2.3.4", "l.org", None, "helo", "fail"), ("1.2.3.4", "p.org", None, None, "pass"),
        ("1.2.3.9", "p.org", None, None, "fail"), ("1.2.3.4", "bad.org", None, None, "permerror"), ("1.2.3.4", "zero.org", None, None, "permerror"), ("2001:db8::77", "six.org", None, None, "pass"), ("2001:db9::7", "SIX.org", None, None, "pass"), ("2001:db9::8", "six.org", None, None, "fail"),
        ("1.2.3.4", "esc.org", None, None, "pass"), ("1.2.3.4", "two.org", None, None, "permerror"), ("1.2.3.4", "junk.org", None, None, "permerror"), (None, "m.org", None, None, "none"), ("1.2.3.4", None, None, None, "none"), ("not an ip", "m.org", None, None, "permerror"),
    ]
    mail = spark.createDataFrame([(n, *c[:4], "x") for n, c in enumerate(cases)] + [(99, *cases[0][:4], "y")], "id int, remote_ip string, mail_from_domain string, mail_from string, helo string, name string")
    got = {r["id"]: r for r in auth.with_spf(mail, spark.createDataFrame(dns, "name string, type string, answers array<string>"), sender="mail_from", helo="helo").collect()}
    assert [(c[0], c[1], got[n]["spf"]) for n, c in enumerate(cases) if got[n]["spf"] != c[4]] == [] and got[99]["spf"] == "pass" and got[99]["name"] == "y"
    ips = ["1.2.3.4", "2001:db8::1", "::ffff:9.8.7.6", "x", None]
    names = [r["n"] for r in spark.createDataFrame([(i, a) for i, a in enumerate(ips)], "i int, a string").select("i", auth.reverse_name(F.col("a")).alias("n")).orderBy("i").collect()]
    assert names == ["4.3.2.1.in-addr.arpa", ipaddress.ip_address("2001:db8::1").reverse_pointer, "6.7.8.9.in-addr.arpa", None, None]


def test_registered_domains(spark):
    rules = suffixes.parsed_rules(spark.createDataFrame([("// list",), ("",), ("com",), ("uk",), ("co.uk  // more",), ("*.ck",), ("!www.ck",), ("jp",), ("*.kobe.jp",), ("!city.kobe.jp",)], "value string"))
    cases = [("a.b.example.com", "example.com"), ("X.co.uk.", "x.co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("a.b.ck", "a.b.ck"), ("x.a.b.ck", "a.b.ck"), ("a.www.ck", "www.ck"), ("a.city.kobe.jp", "city.kobe.jp"), ("a.b.c.kobe.jp", "b.c.kobe.jp"), ("a.b.unknown", "b.unknown"), ("localhost", "localhost"), ("", None), (None, None)]
    df = spark.createDataFrame([(n, c[0], "q") for n, c in enumerate(cases)] + [(50, "a.b.example.com", "r")], "n int, host string, suffix string")
    got = {r["n"]: r for r in suffixes.with_org_domain(df, rules, "host").collect()}
    assert [got[n]["org_domain"] for n in range(len(cases))] == [c[1] for c in cases] and got[50]["org_domain"] == "example.com" and got[50]["suffix"] == "r"
    plain = spark.createDataFrame([("a.b.com", "b.com"), ("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("x.com.au", "x.com.au"), ("a.x.de", "x.de")], "h string, want string")
    assert plain.where(suffixes.org_domain(F.col("h")) != F.col("want")).count() == 0

import base64
import hashlib
import hmac
import json

from pyspark.sql import functions as F

from postmill.sources import attachments, webhooks


def test_adapters_give_one_shape(spark):
    raw = "Subject: x\n\nhi é\n"
    rows = [
        (1, "worker", {"x-envelope-from": "a@b.c", "x-envelope-to": "d@e.f, g@h.i"}, raw, {}), (2, "form", {}, None, {"sender": "a@b.c", "recipient": "d@e.f", "body-mime": raw}),
        (3, "enveloped", {}, json.dumps({"envelope": {"from": "a@b.c", "to": ["d@e.f"]}, "raw_mime_base64": base64.b64encode(raw.encode()).decode()}), {}),
        (4, "enveloped", {}, json.dumps({"envelope": {"to": "d@e.f"}}), {}), (5, "other", {}, raw, {}), (6, None, None, None, None),
    ]
    got = {r["id"]: r for r in webhooks.normalised(spark.createDataFrame(rows, "id int, adapter string, headers map<string,string>, body string, fields map<string,string>")).collect()}
    for k in (1, 2, 3):
        assert bytes(got[k]["raw"]).decode() == raw.replace("\n", "\r\n") and got[k]["from"] == "a@b.c" and got[k]["to"][0] == "d@e.f" and got[k]["error"] is None
    assert got[1]["to"] == ["d@e.f", "g@h.i"]
    assert [got[k]["error"] for k in (4, 5, 6)] == ["no message", "unknown adapter", "unknown adapter"]


def test_signed_forms(spark):
    sign = lambda t: hmac.new(b"k", t.encode() + b"tok", hashlib.sha256).hexdigest()
    rows = [({"timestamp": t, "token": "tok", "signature": s},) for t, s in (("1000", sign("1000")), ("1000", "0"), ("10", sign("10")), ("x", sign("x")))] + [({},)]
    df = spark.createDataFrame(rows, "fields map<string,string>")
    assert [r[0] for r in df.select(webhooks.signature_error("k", F.timestamp_seconds(F.lit(1100)))).collect()] == [None, "bad signature", "stale timestamp", "stale timestamp", "missing signature"]


def test_hidden_html_is_left_out():
    page = b"<title>t</title><div style='display: none'>pre<p>header</p></div><p>Seen <img src=x alt=logo><img width=1 alt=pixel><span hidden>no</span>text</p><script>x</script><ul><li>one</ul>"
    assert attachments.read_html(page)[0] == "Seen logotext\n- one"

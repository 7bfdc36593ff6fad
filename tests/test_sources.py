import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from postmill.sources import attachments, mime

RAW = b"""From mbox line\r
Message-ID: <m1@x.org>\r
Date: Tue, 02 Jan 2024 10:00:00 +0200\r
From: =?utf-8?q?Ren=C3=A9?= <Rene@Shop.DE>\r
To: a@b.org, "Two, T" <t@b.org>\r
Subject: =?iso-8859-1?q?Gr=FC=DFe?= =?iso-8859-1?q?_da?=\r
Authentication-Results: mx; spf=pass smtp.mailfrom=x; dkim=FAIL\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary=b\r
\r
--b\r
Content-Type: multipart/alternative; boundary=c\r
\r
--c\r
Content-Type: text/plain; charset=iso-8859-1\r
Content-Transfer-Encoding: quoted-printable\r
\r
Gr=FC=DFe =\r
weiter\r
--c\r
Content-Type: text/html\r
\r
<p>Hi</p>\r
--c--\r
--b\r
Content-Type: text/csv\r
Content-Disposition: attachment; filename*=utf-8''t%C3%A4.csv\r
Content-Transfer-Encoding: base64\r
\r
YTtiCjE7MgozOzQK\r
"""


def test_message(spark):
    df = spark.createDataFrame([("k", RAW), ("none", None), ("junk", b"\x00\xff no header")], "path string, content binary")
    rows = {r["path"]: r for r in mime.parse_messages(df).collect()}
    r = rows["k"]
    assert (r["message_id"], r["subject"], r["date"]) == ("<m1@x.org>", "Grüße da", datetime(2024, 1, 2, 8))
    assert r["from"].asDict() == {"name": "René", "email": "Rene@shop.de"} and [x["email"] for x in r["to"]] == ["a@b.org", "t@b.org"]
    assert r["text"].replace("\r\n", "") == "Grüße weiter" and "<p>Hi</p>" in r["html"]
    a = r["attachments"][0]
    assert a["filename"] == "tä.csv" and bytes(a["content"]) == b"a;b\n1;2\n3;4\n" and a["id"].startswith("att_") and len(a["id"]) == 26
    assert rows["none"]["attachments"] == [] and rows["junk"]["error"] is None
    parsed, failed = mime.quarantine(mime.parse_messages(df))
    assert parsed.count() == 3 and failed.count() == 0
    assert df.select(mime.sniff_message_id(df["content"])).first()[0] == "<m1@x.org>"
    auth = mime.parse_messages(df).where("path = 'k'").select(mime.read_auth(F.col("raw_headers")).alias("a")).first()["a"]
    assert (auth["spf"], auth["dkim"], auth["dmarc"]) == ("pass", "fail", None)


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_attachments(spark):
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    xlsx = zipped({"xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    docx = zipped({"word/document.xml": "<d><p><t>Hello</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>a</t></p></tc></tr><tr><tc><p><t>1</t></p></tc><tc><p><t>2</t></p></tc></tr></tbl></d>"})
    rows = [
        (1, b'a;b\n1;"x\ny"\n', "t.csv", None), (2, xlsx, "s.xlsx", None), (3, docx, "d.docx", None), (4, b"<html><table><tr><th>k<th>v<tr><td>1<td>2</table>", None, "text/html"),
        (5, b"| a | b |\n|---|---|\n| 1 | 2 |\n", "n.txt", "text/plain"), (6, b"%PDF-1.4", "x.pdf", None), (7, b"PK\x03\x04broken", "x.xlsx", None), (8, None, None, None), (9, b"\x00\x01", "x.bin", None),
    ]
    df = spark.createDataFrame(rows, "id int, content binary, filename string, content_type string")
    got = {r["id"]: r for r in attachments.extract_attachments(df).collect()}
    assert [got[i]["kind"] for i in range(1, 10)] == ["csv", "xlsx", "docx", "html", "text", "pdf", "xlsx", "empty", "binary"]
    assert got[1]["tables"][0]["rows"] == [["1", "x\ny"]]
    assert got[2]["tables"][0]["headers"] == ["name", "col2", "n"] and got[2]["tables"][0]["rows"] == [["5", None, "TRUE"]]
    assert got[3]["tables"][0]["headers"] == ["a", "a_2"] and "Hello" in got[3]["text"]
    assert got[4]["tables"][0]["rows"] == [["1", "2"]] and got[5]["tables"][0]["rows"] == [["1", "2"]]
    assert got[7]["warnings"] and got[6]["warnings"] == ["no_reader:pdf"]
    records = attachments.table_rows(attachments.extract_attachments(df), "id").where("id = 2").first()
    assert records["record"] == {"name": "5", "col2": None, "n": "TRUE"}

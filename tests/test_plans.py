import duckdb
import pytest
from compare import canonical
from pyspark.sql import functions as F

from postmill.operators import lines
from postmill.plans import schema


def test_schema_checks():
    assert [f.type for f in schema.normalise({"total": "number", "who": "email"})] == ["number", "email"]
    for bad in ({}, {"a b": "string"}, {"a": "money"}, [{"name": "e", "type": "enum"}], [{"name": "a"}, {"name": "a"}], [{"name": "o", "type": "object", "fields": [{"name": "p", "type": "object", "fields": [{"name": "q", "type": "object"}]}]}]):
        with pytest.raises(schema.SchemaError):
            schema.normalise(bad)


def test_typed_fields(spark):
    fields = schema.normalise(
        [{"name": n, "type": t} for n, t in dict(s="string", n="number", i="integer", b="boolean", d="date", m="email", u="url", p="phone", c="currency").items()]
        + [{"name": "e", "type": "enum", "options": ["Paid", "Open"], "required": True}, {"name": "a", "type": "array", "items": {"type": "number"}}, {"name": "o", "type": "object", "fields": [{"name": "x", "type": "integer"}]}]
    )
    good = dict(s=" a\n b ", n="1.234,50", i="2.6", b="Ja", d="02.01.2024", m="<A@B.Org>", u="www.x.org/a", p="0049 (30) 1234567", c="EUR 1.234,50", e="it is open", a="1; x; 2", o='{"x": "7"}')
    bad = dict(s="N/A", n="words", i=None, b="perhaps", d="31.02.2024", m="none@", u="ftp://x", p="12", c="free", e="shut", a="", o="{")
    rows = schema.typed(spark.createDataFrame([(1, good), (2, bad)], "id int, raw map<string,string>"), fields).orderBy("id").collect()
    f = rows[0]["fields"]
    assert (f["s"], f["n"], f["i"], f["b"], str(f["d"]), f["m"], f["u"], f["p"]) == ("a b", 1234.5, 3, True, "2024-01-02", "A@b.org", "https://www.x.org/a", "+49301234567")
    assert (f["c"]["amount"], f["c"]["currency"], f["e"], f["a"], f["o"]["x"]) == (1234.5, "EUR", "Open", [1.0, 2.0], 7) and rows[0]["flags"] == []
    assert all(v is None for k, v in rows[1]["fields"].asDict().items() if k != "o")
    assert set(rows[1]["flags"]) >= {"type_error:n", "type_error:b", "type_error:d", "type_error:m", "type_error:u", "type_error:p", "type_error:c", "enum_violation:e"}


def test_labels_diff_and_versions(spark):
    df = spark.createDataFrame([("Invoice No: R-1\nTotal  12,00 EUR\nDue\n 1.2.2024",)], "t string")
    got = df.select(*(schema.label_search(F.col("t"), [x]) for x in ("Invoice", "Total", "Due", "Tax"))).first()
    assert tuple(got) == ("R-1", "12,00 EUR", "1.2.2024", None)
    ddl = "id int, field string, value string, confidence double, source string"
    before = spark.createDataFrame([(1, "a", "x", 0.9, "rule"), (1, "b", "y", 0.9, "rule"), (1, "c", "z", 0.900, "rule")], ddl)
    after = spark.createDataFrame([(1, "a", "x2", 0.9, "rule"), (1, "d", "y", 0.9, "rule"), (1, "c", "z", 0.904, "rule")], ddl)
    assert sorted((r["field"], r["change"]) for r in schema.field_diff(before, after, ["id"]).collect()) == [("a", "changed"), ("b", "removed"), ("d", "added")]
    versions = spark.createDataFrame([(1, 1, "s1"), (1, 2, "s2"), (2, 1, "t")], "mailbox_id int, version int, schema string")
    again = versions.union(schema.rolled_back(versions, 1, 1))
    assert sorted(tuple(r) for r in schema.versions_in_force(again).collect()) == [(1, 3, "s1"), (2, 1, "t")]


def test_lines_blocks_and_columns(spark):
    runs = [(1, 1, x, y + j, 40.0, 10.0, t) for y, cells in ((0.0, ("Item", "Qty")), (20.0, ("Pen", "2")), (40.0, ("Ink", "5")), (300.0, ("Total",))) for j, (x, t) in enumerate(zip((0.0, 100.0), cells))]
    df = spark.createDataFrame(runs, "doc int, page int, x double, y double, w double, h double, text string")
    found = lines.runs_to_lines(df, ["doc", "page"])
    assert [r["text"] for r in found.orderBy("line").collect()] == ["Item Qty", "Pen 2", "Ink 5", "Total"]
    blocks = lines.lines_to_blocks(found, ["doc", "page"])
    assert blocks.count() == 3 and blocks.select("block").distinct().count() == 1
    gaps = [(r["x0"], r["x1"]) for r in lines.corridors(blocks, ["doc", "page", "block"]).collect()]
    assert gaps == [(41, 99)]
    columns = spark.createDataFrame([(1, "left", 0.0, 50.0), (1, "right", 90.0, 150.0)], "doc int, c string, c0 double, c1 double")
    segments = spark.createDataFrame([(1, 95.0, 120.0, "a"), (1, 60.0, 65.0, "b")], "doc int, x double, x1 double, text string")
    assert {r["text"]: r["c"] for r in lines.column_of(segments, columns, ["doc"]).collect()} == {"a": "right", "b": "left"}


def test_quotes_and_signatures(spark):
    texts = ["Hi\n> old", "Hello\n-- \nme", "> only quoted", "Fine.\nKind regards\nX", "Best regards"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", lines.stripped_text(F.col("t"))).orderBy("i").collect()] == ["Hi", "Hello", "> only quoted", "Fine.", "Best regards"]


def test_greetings_within_a_message(spark):
    long = "x" * 91
    texts = ["Hi\nBest.\nall of it\nBest regards,\nX", f"Hi\nThanks!\n{long}", "Hi\nCheers" + "\na" * 9, "Hi\r\nthere\r\n-- \r\nme", "Hi\r\nthere\r\n> old", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[1] for r in df.select("i", lines.stripped_text(F.col("t"))).orderBy("i").collect()] == ["Hi\nBest.\nall of it", texts[1], texts[2], "Hi\r\nthere", "Hi\r\nthere", None]


def test_stripped_query_equals_sql_on_odd_texts(spark, tmp_path):
    texts = ["A.\nBest.\nB.", "A.\nBest.", "Best.\nBest.\nBest.", "A.\nThanks!\n", "A.\r\nB.\r\n", "", "  ", "\n", " A ", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    rows = lines.t10_t12_stripped(spark, str(tmp_path)).toPandas()
    assert canonical(rows) == canonical(con.sql(lines.ORACLE_SQL["t10_t12_stripped"]).df())


def test_schema_of_a_form():
    rows = [{"name": " total ", "type": "currency", "required": True}, {"name": "state", "type": "enum", "enumOptions": "open, closed,"}, {"name": "tags", "type": "array", "itemType": "integer"}, {"name": "place", "type": "object", "nestedFields": '[{"name": "street", "type": "string"}]'}, {"name": "note"}]
    total, state, tags, place, note = schema.from_form(rows)
    assert (total.name, total.type, total.required, state.options, tags.items.type, place.fields[0].name, note.type) == ("total", "currency", True, ("open", "closed"), "integer", "street", "string")
    for bad in ({"type": "string"}, {"name": "x", "type": "enum"}, {"name": "x", "type": "object", "nestedFields": "{}"}, {"name": "x", "type": "object"}):
        with pytest.raises(schema.SchemaError):
            schema.from_form([bad])


def test_values_after_labels_by_type(spark):
    said = ["Total: EUR 1.234,50 (net)", "Tax (19%): 4.00", "Tax: 19%\nTax 4,20", "Paid August 21, 2026", "Mail me@x.org now", "Total\n  $5.00", "Total   (31.50)", "Total value"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(said)], "n int, t string")
    of = lambda label, kind: [r["x"] for r in df.select("n", schema.label_search(F.col("t"), [label], kind).alias("x")).orderBy("n").collect()]
    assert of("total", "number") == ["EUR 1.234,50", None, None, None, None, "$5.00", "(31.50)", None]
    assert of("tax", "number")[2] == "4,20" and of("paid", "date")[3] == "August 21, 2026" and of("mail", "email")[4] == "me@x.org" and of("total", "string")[7] is None

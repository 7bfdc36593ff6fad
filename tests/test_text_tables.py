"""Tables in plain text."""

from pyspark.sql import functions as F

from postmill.operators import text_tables as X


def found(spark, texts, of=X.text_tables):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    out = {n: [] for n in range(len(texts))}
    for r in sorted(of(rows, "n").collect(), key=lambda r: (r["n"], r["line"])):
        out[r["n"]].append((r["line"], r["kind"], r["headers"], [list(x) for x in r["rows"]]))
    return [out[n] for n in out]


ALIGNED = "Item              Qty   Unit price   Amount\nBlue Widget         3       $9.00      $27.00\nRed Gadget          1       $4.50       $4.50"


def test_aligned_columns(spark):
    many = "\n".join(["Product          Count   Sum"] + [f"thing {i:<10} {i:>6}   {i}.00" for i in range(30)] + ["a very long name of a thing 7   9.00"])
    tabbed = "Name\t\tTotal\nfirst\t\t12.00\nsecond\t\t13.00\n"
    texts = [
        ALIGNED, "Dear all,\n\n" + ALIGNED + "\n\nBye", "Hello there,\n\nThis is a paragraph  with a gap.\nAnother line here.\nAnd a third.", "Heading  over it\n" + ALIGNED, "1  2  3\n4  5  6\n7  8  9", many, tabbed,
        "> Item      Amount\n> one       1.00\n> two       2.00", None, "",
    ]
    got = found(spark, texts)
    want = (["Item", "Qty", "Unit price", "Amount"], [["Blue Widget", "3", "$9.00", "$27.00"], ["Red Gadget", "1", "$4.50", "$4.50"]])
    assert got[0] == [(0, "aligned", *want)] and got[1] == [(2, "aligned", *want)]
    assert got[2] == got[4] == got[7] == got[8] == got[9] == []
    assert [t[2:] for t in got[3]] == [want] and got[3][0][0] in (0, 1)
    assert got[5][0][2] == ["Product", "Count", "Sum"] and len(got[5][0][3]) == 31 and got[5][0][3][0] == ["thing 0", "0", "0.00"]
    assert got[6] == [(0, "aligned", ["Name", "Total"], [["first", "12.00"], ["second", "13.00"]])]


def test_pipes(spark):
    texts = ["| Product | Qty | Price |\n|---|---|---|\n| Kaffee | 2 | 8,00 EUR |\n| Tee | 1 | 3,50 EUR |", "|1|2|\n|3|4|\n|5|", "only | one line | here", "a | b", "|x|y|\n|1|2|\ntext\n|p|q|r|\n|7|8|9|"]
    got = found(spark, texts)
    assert got[0] == [(0, "pipe", ["Product", "Qty", "Price"], [["Kaffee", "2", "8,00 EUR"], ["Tee", "1", "3,50 EUR"]])]
    assert got[1] == [(0, "pipe", ["col1", "col2"], [["1", "2"], ["3", "4"], ["5", ""]])]
    assert got[2] == got[3] == []
    assert got[4] == [(0, "pipe", ["x", "y"], [["1", "2"]]), (3, "pipe", ["p", "q", "r"], [["7", "8", "9"]])]


def test_quoted_tables_join_the_others_once(spark):
    quoted = "\n".join("> " + x for x in ALIGNED.split("\n"))
    other = quoted.replace("Blue", "Pink")
    rows = spark.createDataFrame([(0, ALIGNED + "\n\nbefore:\n" + quoted + "\n\n> " + "\n> > ".join([""] + other.replace("> ", "").split("\n"))), (1, quoted), (2, None)], "n int, text string")
    got = X.tables_with_quoted(rows, "n").select("n", "quoted", F.get(F.get("rows", F.lit(0)), F.lit(0)).alias("first")).collect()
    assert sorted(tuple(r) for r in got) == [(0, False, "Blue Widget"), (0, True, "Pink Widget"), (1, True, "Blue Widget")]


def test_a_long_cell_between_columns_is_whole(spark):
    """Before, what followed a blank beyond a column's border was in no cell."""
    line = lambda name, n: f"{name:<20}{n:>5}{'1.00':>10}"
    lines = [f"{'Item':<20}{'Qty':>5}{'Amount':>10}"] + [line(f"Part {n:04} A", n) for n in range(12)]
    (left,), (right,) = found(spark, ["\n".join(lines[:5] + [line(name, 35)] + lines[6:]) for name in ("Part 16792 N", "Part 0009 A       x")])
    assert left[2] == ["Item", "Qty", "Amount"] and left[3][4] == ["Part 16792 N", "35", "1.00"] and left[3][5] == ["Part 0005 A", "5", "1.00"] and len(left[3]) == 12
    assert right[3][4] == ["Part 0009 A", "x    35", "1.00"] and len(right[3]) == 12

"""Tables from positioned lines."""

import pytest

from postmill.operators import page_tables as X

LINE = "doc int, page int, line int, y double, h double, segments array<struct<x:double,x1:double,text:string>>"


def tables(spark, pages):
    """Pages as lists of (y, segments)."""
    rows = [(0, p, n, float(y), 10.0, [(float(a), float(b), t) for a, b, t in segments]) for p, lines in enumerate(pages) for n, (y, segments) in enumerate(lines)]
    found = X.page_tables(spark.createDataFrame(rows, LINE), ["doc", "page"]).orderBy("page", "index").collect()
    return [(r["page"], r["index"], list(r["headers"]), [list(x) for x in r["rows"]], [tuple(t) for t in r["totals"]]) for r in found]


def grid(y, *cells):
    at = [(40, 200), (250, 300), (400, 460), (500, 560)]
    return (y, [(*at[k], c) for k, c in enumerate(cells) if c])


HEAD = grid(50, "Description", "Qty", "Price", "Amount")


def test_wrapped_cells_and_totals_of_the_block(spark):
    page = [(10, [(40, 560, "A bill")]), HEAD, grid(70, "Widget", "3", "9.00", "27.00"), (82, [(40, 120, "with a long name")]), grid(94, "Gadget", "1", "4.50", "4.50"), grid(120, "", "", "Subtotal", "31.50"), grid(132, "", "", "odd line", "2"), grid(144, "", "", "Total:", "$33.50 USD")]
    assert tables(spark, [page]) == [(0, 0, ["Description", "Qty", "Price", "Amount"], [["Widget with a long name", "3", "9.00", "27.00"], ["Gadget", "1", "4.50", "4.50"]], [("Subtotal", "31.50"), ("Total", "$33.50 USD")])]


def test_totals_after_a_gap_join_the_table_above(spark):
    rows = [HEAD, grid(62, "Widget", "3", "9.00", "27.00"), grid(74, "Gadget", "1", "4.50", "4.50")]
    near = lambda y, right: [(y, [(205, 240, "Total"), (right - 40, right, "31.50")]), (y + 12, [(205, 240, "VAT 19%"), (right - 40, right, "5.00")])]
    joined, far, off = tables(spark, [rows + [(90, [(0, 30, "note")])] + near(150, 561), rows + near(400, 561), rows + near(150, 700)])
    assert joined[4] == [("Total", "31.50"), ("VAT 19%", "5.00")] and far[4] == off[4] == [] and joined[3] == far[3] == off[3]


def test_blocks_are_told_apart_and_judged(spark):
    two = [HEAD, grid(62, "a", "1", "2.00", "2.00"), (74, [(600, 620, "x"), (700, 720, "y")]), (86, [(600, 620, "z"), (700, 720, "w")])]  # an address pair is no table
    numbers = [(0, [(10, 30, "Rent"), (100, 130, "900")]), (12, [(10, 30, "Heat"), (100, 130, "80")]), (24, [(10, 30, "Water"), (100, 130, "20")])]
    lone = [(0, [(0, 5, "a"), (50, 60, "b")]), (12, [(0, 5, "a")])]
    got = tables(spark, [two, numbers, lone])
    assert [(t[0], t[2], t[3]) for t in got] == [(0, HEAD[1] and ["Description", "Qty", "Price", "Amount"], [["a", "1", "2.00", "2.00"]]), (1, ["col1", "col2"], [["Rent", "900"], ["Heat", "80"], ["Water", "20"]])]


def test_a_title_across_many_rows_closes_no_column(spark):
    page = [HEAD, *(grid(62 + 12 * n, f"item {n}", str(n), "1.00", f"{n}.00") for n in range(12))]
    page.insert(5, (page[4][0] + 6, [(40, 330, "a note that runs on and on"), (400, 460, "x")]))
    (found,) = tables(spark, [page])
    assert len(found[2]) == 4 and len(found[3]) == 13


@pytest.mark.parametrize("lines", [[], [(0, [])], [(0, [(0, 1, "a"), (9, 12, "b")])]])
def test_pages_without_tables(spark, lines):
    assert tables(spark, [lines]) == []


def test_columns_cost_edges_not_places(spark):
    """Before, each place of a page was looked at, which such a width doesn't allow."""
    far = 2_000_000_000
    page = [(y, [(0, 30, a), (far - 40, far, b)]) for y, a, b in ((0, "Item", "Amount"), (12, "one", "1.00"), (24, "two", "2.00"))]
    assert tables(spark, [page]) == [(0, 0, ["Item", "Amount"], [["one", "1.00"], ["two", "2.00"]], [])]


def test_lines_are_dealt_out_once(spark):
    rows = spark.createDataFrame([], LINE)
    plan = X.page_tables(rows, ["doc", "page"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_page_is_worked_on_by_arrays(spark):
    """Before, windows sorted the lines several times, and each block was one expression of nested lambdas."""
    plan = X.page_tables(spark.createDataFrame([], LINE), ["doc", "page"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("ArrowEvalPython") == 1
    n = 3_000
    page = [(12 * i, [(0, 90 + i % 7 / 8, f"part {i}"), (400 - i * 0.08, 460, f"{i}.00")]) for i in range(n)]
    assert tables(spark, [page]) == [(0, 0, ["col1", "col2"], [[f"part {i}", f"{i}.00"] for i in range(n)], [])]


def test_segments_without_a_place_stop_nothing(spark):
    """What has no left edge covers nothing and stands in a column all the same."""
    rows = [(0, 0, n, y, 10.0, segments) for n, (y, segments) in enumerate([(0.0, [(0.0, 30.0, "Item"), (100.0, 140.0, "Amount")]), (12.0, [(0.0, 30.0, "one"), (None, 140.0, "1.00")]), (24.0, [(0.0, 30.0, "two"), (100.0, 140.0, None)]), (None, [(0.0, 30.0, "three"), (100.0, 140.0, "3.00")])])]
    (found,) = X.page_tables(spark.createDataFrame(rows, LINE), ["doc", "page"]).collect()
    assert found["index"] == 0 and list(found["headers"]) == ["Item", "Amount"] and [list(r) for r in found["rows"]] == [["one", "1.00"], ["two", ""], ["three", "3.00"]]

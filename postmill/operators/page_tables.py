"""From positioned lines of a page to its tables, as one plan.

Lines of two segments or more are seeds. Seeds whose segments line up are a block; what lies between its seeds belongs to it.
How many lines cover a place tells a block's columns, each segment goes to the column it overlaps most, and a line that fills the
first column alone goes on with the row above. Totals at the bottom come off, and a block of nothing else joins the table above
it. Lines are dealt out and grouped by page once, so a page is a row; batches of pages are worked on in tasks by arrays of all
their lines, segments, columns and cells: one expression of nested lambdas took some eight times as long.

Defined results: a page without two seeds that line up has no tables; lines without segments are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import _ship  # noqa: F401
from ..sources.tables import table
from .grids import qualifies

#: Two edges this near are in line; a gap of so many heights ends a block; from so many lines on, so large a share may cross a gap, which is this wide.
NEAR, APART, TOTALS_NEAR = 2.5, 8.0, 8.0
CROSSED_FROM, CROSSED = 8, 0.12
GAP, GAP_HEIGHTS = 3.0, 0.6
#: Labels of totals in English, German, French, Spanish, Italian and Dutch; a rate may follow.
TOTALS = (
    "sub[- ]?total|total|grand total|amount due|amount paid|balance(?: due)?|due|tax|vat|gst|hst|sales tax|shipping|freight|handling|discount|rounding|net(?: total| amount)?|gross|subtotal",
    "zwischensumme|summe|gesamt(?:betrag|summe)?|nettobetrag|bruttobetrag|mwst\\.?|ust\\.?|umsatzsteuer|rechnungsbetrag|zu zahlen(?:der betrag)?|endbetrag|versand(?:kosten)?|rabatt|steuer",
    "sous[- ]total|montant(?: du| total| à payer)?|tva|remise|frais de port", "importe(?: total)?|iva|total a pagar", "totale|imponibile|sconto", "totaal|btw|te betalen",
)
TOTALS_LABEL = re.compile(rf"(?ai)^(?:{'|'.join(TOTALS)})(?![0-9A-Za-z_])[\s:.]*(?:\(?\s*[0-9.,]{{1,7}}\s*%\s*\)?)?[\s:.]*[\x85\u2028\u2029]?\Z")
ENDING = re.compile(r"(?a)[\s:.]+$")
TABLES = "array<struct<headers:array<string>,rows:array<array<string>>,totals:array<struct<label:string,value:string>>>>"


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive groups begins, and where the last one ends."""
    return np.concatenate(([0], np.cumsum(sizes)))


def _within(sizes: np.ndarray) -> np.ndarray:
    """The place of each element in its group."""
    return np.arange(sizes.sum()) - np.repeat(_starts(sizes)[:-1], sizes)


def _first_of(flags: np.ndarray) -> np.ndarray:
    """The place of the latest true value up to each element; flags begin with one."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def columns_of(block: np.ndarray, line: np.ndarray, x: np.ndarray, x1: np.ndarray, seeds: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, c0, c1) of all columns, in order: stretches between the gaps that almost no line of a block's seeds covers.

    ``block``, ``line``, ``x`` and ``x1`` are of the seeds' segments, in order; ``seeds`` and ``height`` are of blocks. What covers a place
    only changes at an edge of a segment, so lines are counted at edges. A segment without edges covers nothing."""
    known = ~(np.isnan(x) | np.isnan(x1))
    block, line, a, b = block[known], line[known], np.floor(x[known]).astype(np.int64), np.ceil(x1[known]).astype(np.int64) + 1
    n = len(seeds)
    lo, hi = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(lo, block, a)
    np.maximum.at(hi, block, b)
    # A line counts once where its segments overlap: each covers what those before it have left.
    order = np.lexsort((a, line))
    block, line, a, b = block[order], line[order], a[order], b[order]
    base = b.min(initial=0)
    above = line * (b.max(initial=0) - base + 1)
    reached = np.maximum.accumulate(b - base + above) - above + base
    covered = np.where(np.diff(line, prepend=-1) == 0, np.concatenate(([0], reached[:-1])), a) if len(a) else a
    begin = np.maximum(a, covered)
    end = np.maximum(b, begin)
    a_too, b_too = a != begin, b != end
    of, at = np.concatenate((block, block, block[a_too], block[b_too])), np.concatenate((begin, end, a[a_too], b[b_too]))
    step = np.repeat([1, -1, 0], [len(a), len(a), len(at) - 2 * len(a)])
    order = np.lexsort((at, of))
    of, at, step = of[order], at[order], step[order]
    new = (np.diff(of, prepend=-1) != 0) | (np.diff(at, prepend=0) != 0)
    edge = np.flatnonzero(new)
    count = np.cumsum(step)[np.append(edge[1:], len(at)) - 1] if len(at) else step
    of, at = of[edge], at[edge]
    inside = (at >= lo[of]) & (at < hi[of])
    of, at, count = of[inside], at[inside], count[inside]
    allowed = np.where(seeds >= CROSSED_FROM, np.floor(seeds * CROSSED), 0)
    on = count > allowed[of]
    # Runs of edges that are covered or not; a run that isn't, and is wide or at the side, parts columns.
    turn = (np.diff(of, prepend=-1) != 0) | (np.diff(on.astype(np.int8), prepend=0) != 0)
    of, start, on = of[turn], at[turn], on[turn]
    end = np.where(np.append(of[1:], -1) == of, np.append(start[1:], 0), hi[of])
    gap = ~on & ((end - start >= np.maximum(GAP, height * GAP_HEIGHTS)[of]) | (end == hi[of]) | (start == lo[of]))
    # A column begins at the block's left edge and after each gap, and ends before the next one.
    some = np.flatnonzero(hi - lo > 1)
    of, start, end = of[gap], start[gap], end[gap]
    lefts, left_of = np.concatenate((lo[some], end)), np.concatenate((some, of))
    rights, right_of = np.concatenate((start, hi[some])), np.concatenate((of, some))
    order = np.lexsort((lefts, left_of))
    c0, of, c1 = lefts[order], left_of[order], rights[np.lexsort((rights, right_of))] - 1
    good = (c1 > c0) & (hi - lo > 1)[of]
    return of[good], c0[good], c1[good]


def columns_at(x: np.ndarray, x1: np.ndarray, first: np.ndarray, size: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """The column of each segment, of ``size`` ones from ``first`` on: that of the largest overlap, else of the nearest centre; the first of ties."""

    def best(which: np.ndarray, worth: Callable) -> np.ndarray:
        sizes = size[which]
        k = _within(sizes)
        at = np.repeat(first[which], sizes) + k
        value, begins = worth(np.repeat(x[which], sizes), np.repeat(x1[which], sizes), c0[at], c1[at]), _starts(sizes)[:-1]
        top = np.maximum.reduceat(value, begins)
        return np.minimum.reduceat(np.where(value == np.repeat(top, sizes), k, len(c0)), begins), top

    if not len(x):
        return np.zeros(0, np.int64)
    found, over = best(np.arange(len(x)), lambda s, t, a, b: np.fmin(b, t) - np.fmax(a, s))
    none = np.flatnonzero(over <= 0)
    if len(none):
        found[none] = best(none, lambda s, t, a, b: -np.nan_to_num(np.abs((a + b) / 2 - (s + t) / 2)))[0]
    return found


def lined_up(x: np.ndarray, x1: np.ndarray, segment: np.ndarray, size: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For pairs of lines: two segments or more of ``one``, and all but one of the shorter line's, overlap one of ``other`` or share an edge with it. A line has ``size`` segments from ``segment`` on."""
    n = size[one]
    s, pair = np.repeat(segment[one], n) + _within(n), np.repeat(np.arange(len(one)), n)
    m = size[other][pair]
    t, source = np.repeat(segment[other][pair], m) + _within(m), np.repeat(np.arange(len(s)), m)
    s = s[source]
    meets = (np.fmin(x1[s], x1[t]) > np.fmax(x[s], x[t])) | (np.abs(x[s] - x[t]) <= NEAR) | (np.abs(x1[s] - x1[t]) <= NEAR)
    met = np.zeros(len(pair), bool)
    met[source[meets]] = True
    hits = np.bincount(pair[met], minlength=len(one))
    return (hits >= 2) & (hits >= np.minimum(size[one], size[other]) - 1)


def heights(h: np.ndarray, page: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The middle height of each page's lines; 10 where there is none."""
    known = np.bincount(page[~np.isnan(h)], minlength=len(sizes))
    at = _starts(sizes)[:-1] + known // 2
    middle = np.full(len(sizes), np.nan)
    middle[known > 0] = h[np.lexsort((h, page))][at[known > 0]]
    return np.where(np.isnan(middle) | (middle == 0), 10.0, middle)


def tables_of(lines: pa.Array) -> pa.Array:
    """array<struct(headers, rows, totals)> of each page's lines (line, y, h, segments) in order. A batch of pages is handled at once, by arrays of all their lines, segments, columns and cells."""
    flat, pages = lines.flatten(), len(lines)
    sizes = np.diff(lines.offsets.to_numpy())
    page = np.repeat(np.arange(pages), sizes)
    height = heights(_numbers(flat.field("h")), page, sizes)
    segments = flat.field("segments")
    size = np.where(segments.is_valid().to_numpy(zero_copy_only=False), np.diff(segments.offsets.to_numpy()), 0)
    segments, some = segments.flatten(), size > 0
    y, page, size = _numbers(flat.field("y"))[some], page[some], size[some]
    x, x1, seed = _numbers(segments.field("x")), _numbers(segments.field("x1")), size >= 2

    # A block begins with a seed that is far from the seed before it, or not in line with it.
    at = np.flatnonzero(seed)
    one, other = at[:-1], at[1:]
    same = page[one] == page[other]
    one, other = one[same], other[same]
    follows = np.zeros(len(page), bool)
    follows[other] = ~(y[other] - y[one] > APART * height[page[other]]) & lined_up(x, x1, _starts(size), size, one, other)
    block = np.cumsum((np.diff(page, prepend=-1) != 0) | (seed & ~follows)) - 1
    of_page = page[np.flatnonzero(np.diff(block, prepend=-1))]
    return _gathered(block_tables(block, y, seed, size, x, x1, segments.field("text"), height[of_page]), of_page, height, pages)


def _gathered(found: pa.StructArray, of_page: np.ndarray, height: np.ndarray, pages: int) -> pa.Array:
    """The tables of pages from those of blocks: a block of nothing but totals joins the table above it. Once one has been refused, that table isn't the last one any more."""
    place = {name: found.field(name).to_numpy(zero_copy_only=False) for name in ("block", "y0", "y1", "right")}
    rows, totals = found.field("rows"), found.field("totals")
    n_rows, n_totals = np.diff(rows.offsets.to_numpy()), np.diff(totals.offsets.to_numpy())
    page, no, only = of_page[place["block"]], np.arange(len(found)), (n_rows == 0) & (n_totals > 0)
    host = np.maximum.accumulate(np.where(only, -1, no))
    has = (host >= 0) & (page[host] == page) if len(no) else only
    h = height[page]
    near = (place["y0"] - place["y1"][host] <= TOTALS_NEAR * h) & (np.abs(place["right"] - place["right"][host]) <= np.maximum(12.0, 2 * h))
    bad = np.cumsum(only & ~(has & (n_rows[host] > 0) & near))
    kept = has & (~only | (bad == bad[host]))
    tables = np.flatnonzero(~only)
    of_table = np.bincount(host[kept], weights=n_totals[kept], minlength=len(no))[tables].astype(np.int64)
    every = _listed(totals.flatten().filter(pa.array(np.repeat(kept, n_totals))), of_table)
    at = pa.array(tables)
    parts = pa.StructArray.from_arrays([found.field("headers").take(at), rows.take(at), every], ["headers", "rows", "totals"])
    return _listed(parts, np.bincount(page[tables], minlength=pages))


def block_tables(block: np.ndarray, y: np.ndarray, seed: np.ndarray, size: np.ndarray, x: np.ndarray, x1: np.ndarray, texts: pa.Array, height: np.ndarray) -> pa.StructArray:
    """struct(block, y0, y1, right, headers, rows, totals) of blocks, without those of no two seeds, columns or rows. ``block``, ``y``, ``seed`` and ``size`` are of lines, ``x``, ``x1`` and ``texts`` of their segments."""
    n, line = len(height), np.repeat(np.arange(len(block)), size)

    # Blocks with two seeds and two columns; of their lines those down to the last seed.
    seeds = np.bincount(block[seed], minlength=n)
    last = np.full(n, -1)
    np.maximum.at(last, block[seed], np.flatnonzero(seed))
    of = seed[line]
    col_of, c0, c1 = columns_of(block[line[of]], line[of], x[of], x1[of], seeds, height)
    width = np.bincount(col_of, minlength=n)
    col_first, good = _starts(width)[:-1], (seeds >= 2) & (width >= 2)
    taken = good[block] & (np.arange(len(block)) <= last[block])
    which = np.flatnonzero(taken[line] & texts.is_valid().to_numpy(zero_copy_only=False))
    b = block[line[which]]
    at = columns_at(x[which], x1[which], col_first[b], width[b], c0, c1)

    # Cells of each line: what stands in a column, joined.
    cell_first = _starts(np.where(taken, width[block], 0))
    cell = cell_first[line[which]] + at
    order = np.argsort(cell, kind="stable")
    cells = _joined(texts.take(pa.array(which[order])), np.bincount(cell, minlength=cell_first[-1]))

    # Lines with text are rows; one that fills its first cell alone goes on with the row above.
    row_line = np.flatnonzero(taken)
    row_width = width[block[row_line]]
    filled = pc.not_equal(cells, "").to_numpy(zero_copy_only=False)
    some = np.add.reduceat(filled, cell_first[:-1][row_line], dtype=np.int64) if len(row_line) else np.zeros(0, np.int64)
    row_line, row_width, some = row_line[some > 0], row_width[some > 0], some[some > 0]
    row_block, head = block[row_line], cell_first[:-1][row_line]
    own = (np.diff(row_block, prepend=-1) != 0) | seed[row_line] | (some != 1) | ~filled[head]
    group = np.cumsum(own) - 1
    firsts = pc.utf8_trim(_joined(cells.take(pa.array(head)), np.bincount(group, minlength=own.sum())), characters=" ")
    row_block, row_width, head = row_block[own], row_width[own], head[own]
    per_block = np.bincount(row_block, minlength=n)
    good &= per_block >= 2
    keep = good[row_block]
    firsts = firsts.filter(pa.array(keep))
    row_block, row_width, head, per_block = row_block[keep], row_width[keep], head[keep], np.where(good, per_block, 0)

    # The grid: cells of rows, the first ones trimmed.
    k, begin = _within(row_width), _starts(row_width)[:-1]
    source = np.repeat(head, row_width) + k + len(firsts)
    source[begin] = np.arange(len(firsts))
    grid = pa.concat_arrays([firsts, cells]).take(pa.array(source))
    return _shaped(grid, k, row_width, row_block, per_block, good, y, block, seed, np.where(width > 0, np.concatenate((c1, [0]))[np.minimum(col_first + width - 1, len(c1))], 0))


def _shaped(grid: pa.Array, k: np.ndarray, row_width: np.ndarray, row_block: np.ndarray, per_block: np.ndarray, good: np.ndarray, y: np.ndarray, block: np.ndarray, seed: np.ndarray, right: np.ndarray) -> pa.Array:
    """Tables of grids: names in the first row, if it counts nothing and others do; totals and what stands between two of them off the bottom."""
    rows, begin, n = len(row_width), _starts(row_width), len(good)
    row = np.repeat(np.arange(rows), row_width)
    filled, digit = pc.not_equal(grid, "").to_numpy(zero_copy_only=False), pc.match_substring_regex(grid, "[0-9]").to_numpy(zero_copy_only=False)
    number = digit & ~pc.match_substring_regex(grid, r"\p{L}").to_numpy(zero_copy_only=False)
    some, numbers = np.bincount(row[filled], minlength=rows), np.bincount(row[number], minlength=rows)
    top = _starts(per_block)[:-1][good]  # of each table its first row
    rest = np.bincount(row_block, weights=numbers, minlength=n)[good]
    named = (some[top] >= 2) & (numbers[top] == 0) & (rest > 0)
    is_head = np.zeros(rows, bool)
    is_head[top[named]] = True

    # A total: at most three cells, of which the first that is no number is a label, and another has a digit.
    label = np.full(rows, -1)
    words = np.flatnonzero(filled & ~number)[::-1]
    label[row[words]] = words
    value = np.full(rows, -1)
    counted = np.flatnonzero(filled & digit & (label[row] != np.arange(len(row))))
    value[row[counted]] = counted
    told = np.flatnonzero((label >= 0) & (value >= 0) & (some <= 3) & ~((label == begin[:-1]) & (some > 2)) & ~is_head)
    names = grid.take(pa.array(label[told])).dictionary_encode()
    known = [v.as_py() for v in names.dictionary]
    is_total = np.array([bool(TOTALS_LABEL.search(v.strip(" "))) for v in known], bool)[names.indices.to_numpy()] if known else np.zeros(0, bool)
    total = np.zeros(rows, bool)
    total[told[is_total]] = True

    # Of rows that are no total, the last one after another such, or at the bottom, stays with all above it.
    lowest = np.zeros(rows, bool)
    lowest[_starts(per_block)[1:][good] - 1] = True
    before = np.concatenate(([False], total[:-1]))
    before[top] = False
    before &= ~np.concatenate(([False], is_head[:-1]))
    cut = np.zeros(n, np.int64)
    stays = np.flatnonzero(~total & ~is_head & (~before | lowest))
    np.maximum.at(cut, row_block[stays], stays + 1)
    ends = np.repeat(_starts(per_block)[1:], 1)
    stack = np.flatnonzero(total)
    stack = stack[stack >= cut[row_block[stack]]]
    np.minimum.at(ends, row_block[stack], stack)

    body = ~is_head & (np.arange(rows) < ends[row_block])
    foot = np.flatnonzero(total & (np.arange(rows) >= ends[row_block]))
    width = row_width[top]
    col = _within(width)
    plain = pa.array([f"col{i + 1}" for i in range(width.max(initial=0))], pa.string()).take(pa.array(col))
    head = grid.take(pa.array(np.repeat(begin[:-1][top], width) + col))
    headers = pc.if_else(pa.array(np.repeat(named, width) & pc.not_equal(head, "").to_numpy(zero_copy_only=False)), head, plain)
    in_body = _listed(_listed(grid.filter(pa.array(body[row])), row_width[body]), np.bincount(row_block[body], minlength=n)[good])
    labels = pa.array([ENDING.sub("", v) for v in known], pa.string()).take(names.indices.filter(pa.array(np.isin(told, foot))))
    totals = _listed(pa.StructArray.from_arrays([labels, grid.take(pa.array(value[foot]))], ["label", "value"]), np.bincount(row_block[foot], minlength=n)[good])
    first_seed, last_seed = np.zeros(n), np.zeros(n)
    at = np.flatnonzero(seed)
    last_seed[block[at]] = y[at]
    first_seed[block[at[::-1]]] = y[at[::-1]]
    found = [pa.array(np.flatnonzero(good)), pa.array(first_seed[good]), pa.array(last_seed[good]), pa.array(right[good]), _listed(headers, width), in_body, totals]
    return pa.StructArray.from_arrays(found, ["block", "y0", "y1", "right", "headers", "rows", "totals"])


def _numbers(values: pa.Array) -> np.ndarray:
    """Doubles; what is null isn't a number."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(_starts(sizes), pa.int32()), values)


def _joined(texts: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pc.binary_join(_listed(texts, sizes), " ")


def page_tables(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (line, y, h, segments: array<struct<x, x1, text>>) to rows (keys, index, headers, rows, totals), a row for each table."""
    pages = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "y", "h", "segments"))).alias("lines"))
    told = pages.select(*keys, F.arrow_udf(tables_of, TABLES)("lines").alias("tables"))
    good = F.filter("tables", lambda t: qualifies(t["headers"], t["rows"]))
    return told.select(*keys, F.posexplode(good).alias("index", "t")).select(*keys, "index", "t.headers", "t.rows", "t.totals")


# Queries

def _printed(spark: SparkSession, d: str) -> DataFrame:
    """Orders as printed bills: a title, a head, a line for each item with the right edges of numbers in line, a wrapped name on some, and totals below."""
    seg = lambda x, x1, text: F.struct(F.lit(x).cast("double").alias("x"), F.lit(x1).cast("double").alias("x1"), text.alias("text"))
    right = lambda edge, text: F.struct((F.lit(edge) - 5.0 * F.length(text)).alias("x"), F.lit(float(edge)).alias("x1"), text.alias("text"))
    line = lambda no, *segments: F.struct(no.cast("int").alias("line"), F.array(*segments).alias("segments"))
    item = ("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, since bills are few bytes and much work: else parts are merged by their bytes
    bill = Window.partitionBy("l_orderkey")
    items = table(spark, d, "lineitem").select("l_orderkey", *item).repartition(parts, "l_orderkey")
    items = items.withColumns({"no": F.row_number().over(bill.orderBy(*item)) - 1, "n": F.count("*").over(bill), "total": F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).over(bill)})

    name, no = F.concat(F.lit("Part "), F.col("l_partkey").cast("string")), F.col("no") * 2
    own = line(no + 3, seg(40, 150, name), right(300, F.col("l_quantity").cast("int").cast("string")), right(420, F.format_string("%.2f", "l_extendedprice")))
    wrapped = line(no + 4, seg(45, 120, F.concat(F.lit("in "), F.col("l_returnflag"))))
    above = F.array(line(F.lit(0), seg(40, 400, F.lit("A bill of many words"))), line(F.lit(2), seg(40, 70, F.lit("Item")), seg(280, 300, F.lit("Qty")), seg(380, 420, F.lit("Amount"))))
    sums = lambda k, label, text: line(F.col("n") * 2 + k, seg(240, 300, F.lit(label)), right(420, text))
    below = F.array(sums(4, "VAT 19%:", F.lit("1.00")), sums(5, "Total", F.format_string("%.2f", F.col("total").cast("double"))))
    none = F.slice(above, 1, 0)
    some = lambda when, lines: F.when(when, lines).otherwise(none)
    wraps = F.coalesce(F.col("l_partkey") % 2 == 0, F.lit(False))
    every = items.select("l_orderkey", F.inline(F.concat(some(F.col("no") == 0, above), F.array(own), some(wraps, F.array(wrapped)), some(F.col("no") == F.col("n") - 1, below))))
    return every.withColumns({"y": F.col("line") * 12.0, "h": F.lit(10.0)})


def w11_page_tables(spark: SparkSession, d: str) -> DataFrame:
    """The cells of the tables in printed bills, and the last of their totals."""
    found = page_tables(_printed(spark, d), ["l_orderkey"])
    last = F.element_at("totals", -1)
    rows = found.select("l_orderkey", "index", F.array_join("headers", "|").alias("headers"), F.concat_ws(" ", last["label"], last["value"]).alias("total"), F.posexplode("rows").alias("no", "cells"))
    return rows.select("l_orderkey", "index", "headers", "total", (F.col("no") + 1).cast("long").alias("no"), F.array_join("cells", "|").alias("cells"))


QUERIES = {"w11_page_tables": w11_page_tables}
ORACLE_SQL = {
    "w11_page_tables": """SELECT l_orderkey, 0 AS index, 'Item|Qty|Amount' AS headers, 'Total ' || format('{:.2f}', CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) OVER (PARTITION BY l_orderkey) AS DOUBLE)) AS total,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag) AS no,
        concat_ws('|', 'Part ' || l_partkey || CASE WHEN l_partkey % 2 = 0 THEN ' in ' || l_returnflag ELSE '' END, CAST(l_quantity AS INT), format('{:.2f}', l_extendedprice)) AS cells FROM lineitem""",
}

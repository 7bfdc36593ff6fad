"""Tables in plain text: pipes, and columns aligned by blanks, in the text and in what it quotes.

Lines that could belong to a table become runs by gaps and islands, and only these are carried on. Within a run the
blank columns of a block of lines are one string, a character for each column, whose stretches of two blanks or more part the
cells; from a dozen lines on a column may be filled on a few. A run's blocks are tried from its first line on, so headings
above a table don't hide it. Windows are over one text, blocks over at most ``BLOCK`` lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import let
from ..sources.tables import table

BLOCK, LEAST = 201, 3  # lines of a block; a header and two rows
SLACK_FROM, SLACK = 12, 0.08  #: Fixed values: from so many lines on, so large a share may fill a blank column.
REACH = 5  # how far a cell goes on beyond its border to the end of a word
#: Words of which one in the first row makes it a header.
HEADER_WORDS = (
    "item artikel beschreibung description qty menge quantity amount betrag price preis total summe date datum unit sku product name no\\.? number nr tax vat mwst subtotal rate hours status position"
).split()
ALIGNED = r"^(?!\s*[>|]).*\s{2,}\S"
ROW = "array<string>"
TABLE = f"struct<kind:string,headers:{ROW},rows:array<{ROW}>>"


def header_like(first: Column, rest: Column) -> Column:
    """Two cells or more are filled, with words of up to 40 characters and no numbers, and one is a usual name or half the rows below hold digits."""
    filled = F.filter(first, lambda c: c != "")
    bad = lambda c: c.rlike(r"^\W*[0-9.,]+\W*$") | ~c.rlike("[A-Za-z]") | (F.length(c) > 40)
    usual = F.exists(filled, lambda c: c.rlike(f"(?i)(?:{'|'.join(HEADER_WORDS)})"))
    digits = F.size(F.filter(rest, lambda r: F.exists(r, lambda c: c.rlike("[0-9]"))))
    return (F.size(filled) >= 2) & ~F.exists(filled, bad) & (usual | ((F.size(rest) > 0) & (2 * digits >= F.size(rest))))


def blank_columns(lines: Column) -> Column:
    """A character for each column of equally long lines: a blank where the first line and all but a few others are blank."""
    n = F.size(lines)
    slack = F.when(n >= SLACK_FROM, F.greatest(F.lit(1), F.floor(n * SLACK).cast("int"))).otherwise(0)
    first = F.get(lines, F.lit(0))
    filled = lambda c: F.size(F.filter(lines, lambda x: F.substring(x, c, F.lit(1)) != " "))
    mark = lambda c: F.when(F.substring(first, c, F.lit(1)) != " ", "x").when(filled(c) <= slack, " ").otherwise("x")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(first)), mark), "")


def cells_of(line: Column, columns: Column, filled: Column) -> Column:
    """The line cut at the columns' borders; a border within a word moves to the word's end, up to ``REACH`` places.

    Where a few lines may fill the blanks between columns (``filled``), what else stands there goes to the nearer cell, the left one of ties."""
    word = lambda at: F.substring(line, at, F.lit(1)) != " "
    back = lambda lo: F.when(word(lo + 1), F.least(F.lit(REACH), F.length(F.regexp_extract(F.substring(line, F.lit(1), lo), "[^ ]*$", 0)))).otherwise(0)
    on = lambda hi: F.when(word(hi), F.least(F.lit(REACH), F.length(F.regexp_extract(F.substring(line, hi + 1, F.length(line)), "^[^ ]*", 0)))).otherwise(0)
    trimmed = lambda lo, hi: F.trim(F.regexp_replace(F.substring(line, lo + 1, hi - lo), r"^\s+|\s+$", ""))

    def between(hi: Column, lo: Column) -> Column:
        """struct(left, right): how many places of those between two columns belong to the cell on the left and on the right."""
        at, to = hi + on(hi), F.when(lo < F.length(line), lo - back(lo)).otherwise(lo)

        def dealt(p: Column) -> Column:
            rest = F.substring(line, p["at"] + 1, F.greatest(p["to"] - p["at"], F.lit(0)))
            left = (F.length(rest) - F.length(F.ltrim(rest)) <= F.length(rest) - F.length(F.rtrim(rest))) | (lo >= F.length(line))
            some = F.trim(rest) != ""
            return F.struct(F.when(some & left, p["to"]).otherwise(p["at"]).alias("left"), F.when(some & ~left, p["at"]).otherwise(p["to"]).alias("right"))

        return let(F.struct(at.alias("at"), to.alias("to")), dealt)

    def with_gaps(gaps: Column) -> Column:
        return F.transform(columns, lambda c, i: trimmed(F.coalesce(F.get(gaps, i - 1)["right"], c["lo"]), F.get(gaps, i)["left"]))

    gaps = F.transform(columns, lambda c, i: between(c["hi"], F.coalesce(F.get(columns, i + 1)["lo"], F.length(line))))
    return F.when(filled, let(gaps, with_gaps)).otherwise(F.transform(columns, lambda c: trimmed(c["lo"], c["hi"])))


def aligned_table(lines: Column) -> Column:
    """The table that a block of lines is; null if it is none."""

    def of_columns(padded: Column, columns: Column) -> Column:
        rows = F.filter(F.transform(padded, lambda x: cells_of(x, columns, F.size(padded) >= SLACK_FROM)), lambda r: F.exists(r, lambda c: c != ""))

        def judged(rs: Column) -> Column:
            rest = F.slice(rs, F.lit(2), F.greatest(F.size(rs), F.lit(1)))
            full = F.size(F.filter(rest, lambda r: F.size(F.filter(r, lambda c: c != "")) >= 2))
            good = (F.size(rs) >= LEAST) & (full >= F.size(rest) * 0.6) & header_like(F.get(rs, F.lit(0)), rest)
            return F.when(good, F.struct(F.lit("aligned").alias("kind"), F.get(rs, F.lit(0)).alias("headers"), rest.alias("rows")))

        return F.when(F.size(columns) >= 2, let(rows, judged))

    def parted(padded: Column, mask: Column) -> Column:
        gaps = F.filter(S.spans(mask, " {2,}"), lambda g: g["start"] > 0)
        starts = F.concat(F.array(F.lit(0)), F.transform(gaps, lambda g: g["end"]))
        ends = F.concat(F.transform(gaps, lambda g: g["start"]), F.array(F.length(mask)))
        columns = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))), lambda c: c["hi"] > c["lo"])
        return let(columns, lambda cs: of_columns(padded, cs))

    width = F.array_max(F.transform(lines, lambda x: F.length(x)))
    padded = F.transform(lines, lambda x: F.rpad(x, width, F.lit(" ")))
    return F.when(F.size(lines) >= LEAST, let(padded, lambda p: let(blank_columns(p), lambda mask: parted(p, mask))))


def aligned_tables(lines: Column) -> Column:
    """The tables of a run of lines: at each line that is in none yet, a block is tried; a table's lines are passed over."""
    state = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<struct<at:int,found:{TABLE}>>").alias("tables"))

    def step(s: Column, i: Column) -> Column:
        block = F.slice(lines, i + 1, F.lit(BLOCK))
        known = lambda t: F.struct((i + F.size(block)).alias("next"), F.concat(s["tables"], F.array(F.struct(i.alias("at"), t.alias("found")))).alias("tables"))
        return F.when(s["next"] > i, s).otherwise(let(aligned_table(block), lambda t: F.when(t.isNotNull(), known(t)).otherwise(s)))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(lines) - LEAST, F.lit(0))), state, step, lambda s: s["tables"])


def pipe_table(lines: Column) -> Column:
    """The table that a block of lines with pipes is; null if it is none. Rows get the commonest width, the larger of ties."""
    rule = lambda x: x.rlike(r"^[\s|:+-]+$") & F.contains(x, F.lit("-")) & F.contains(x, F.lit("|"))
    trimmed = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    cut = lambda x: F.transform(F.split(F.regexp_replace(F.regexp_replace(trimmed(x), r"^\|", ""), r"\|$", ""), r"\|", -1), trimmed)

    def shaped(cells: Column) -> Column:
        widths = F.transform(cells, lambda r: F.size(r))
        count = lambda w: F.size(F.filter(widths, lambda v: v == w))
        width = F.array_max(F.transform(F.array_distinct(widths), lambda w: F.struct(count(w).alias("n"), w.alias("w"))))["w"]
        even = lambda r, w: F.slice(F.concat(r, F.array_repeat(F.lit(""), w)), F.lit(1), w)

        def headed(rows: Column, w: Column) -> Column:
            first, rest = F.get(rows, F.lit(0)), F.slice(rows, F.lit(2), F.size(rows))
            named = F.exists(lines, rule) | header_like(first, rest)
            plain = F.transform(first, lambda _, k: F.concat(F.lit("col"), (k + 1).cast("string")))
            return F.struct(F.lit("pipe").alias("kind"), F.when(named, first).otherwise(plain).alias("headers"), F.when(named, rest).otherwise(rows).alias("rows"))

        return let(width, lambda w: F.when(w >= 2, let(F.transform(cells, lambda r: even(r, w)), lambda rows: headed(rows, w))))

    return F.when(F.size(lines) >= 2, let(F.transform(F.filter(lines, lambda x: ~rule(x)), cut), lambda c: F.when(F.size(c) >= 2, shaped(c))))


def text_tables(texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Rows (id, line, kind, headers, rows) of the tables in texts, by the line they begin at, from 0."""
    lines = texts.select(F.col(id_col), F.posexplode(F.split(text, "\n")).alias("line", "said"))
    piped = F.col("said").rlike(r"\|(?s:.)*\|") & F.col("said").rlike(r"[^|\s]")
    rule = F.col("said").rlike(r"^[\s|:+-]*-[\s|:+-]*$") & F.contains("said", F.lit("|"))
    wide = F.replace(F.col("said"), F.lit("\t"), F.lit("    "))
    aligned = wide.rlike(ALIGNED) & (F.length(F.rtrim(wide)) >= 8)
    kind = F.when(piped | rule, "pipe").when(aligned, "aligned")
    some = lines.select(id_col, "line", F.when(kind == "pipe", F.col("said")).otherwise(wide).alias("said"), kind.alias("kind")).where("kind IS NOT NULL")
    # Lines of one kind without a gap have one difference of place and rank.
    rank = F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("line"))
    runs = some.withColumn("run", F.col("line") - rank).groupBy(id_col, "kind", "run").agg(F.min("line").alias("first"), F.sort_array(F.collect_list(F.struct("line", "said"))).alias("block"))
    block = F.transform("block", lambda x: x["said"])
    pipes = runs.where("kind = 'pipe'").select(id_col, F.col("first").alias("line"), pipe_table(block).alias("found")).where("found IS NOT NULL")
    spaced = runs.where(f"kind = 'aligned' AND size(block) >= {LEAST}").select(id_col, "first", F.inline(aligned_tables(block)))
    both = pipes.unionByName(spaced.select(id_col, (F.col("first") + F.col("at")).alias("line"), "found"))
    return both.select(id_col, "line", "found.*").where("size(headers) >= 2 AND size(rows) > 0")


def tables_with_quoted(texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """``text_tables`` and ``quoted``: tables of the text, and those that only show once marks of quoting are taken off, each headers and rows once."""
    bare = F.regexp_replace(F.col(text), r"(?m)^[^\S\n]*(?:>[^\S\n]?)+", "")
    found = text_tables(texts.select(id_col, text), id_col, text).withColumn("quoted", F.lit(False))
    behind = text_tables(texts.where(F.col(text).rlike(r"(?m)^\s*>")).select(id_col, bare.alias(text)), id_col, text).withColumn("quoted", F.lit(True))
    key = F.struct("headers", "rows")
    nth = F.row_number().over(Window.partitionBy(id_col, F.xxhash64(key), key).orderBy("quoted", "line"))
    return found.unionByName(behind).withColumn("nth", nth).where("nth = 1 OR NOT quoted").drop("nth")


# Queries

def _bills(spark: SparkSession, d: str) -> DataFrame:
    """Orders as plain-text bills: aligned, with pipes, or quoted from an earlier mail."""
    price = F.format_string("%.2f", "l_extendedprice")
    name = F.concat_ws(" ", F.lit("Part"), F.col("l_partkey").cast("string"), F.col("l_returnflag"))
    spaced = F.concat(F.rpad(name, 26, " "), F.lpad(F.col("l_quantity").cast("int").cast("string"), 4, " "), F.lit("   "), F.lpad(price, 14, " "))
    piped = F.concat(F.lit("| "), F.concat_ws(" | ", name, F.col("l_quantity").cast("int").cast("string"), price), F.lit(" |"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", spaced.alias("spaced"), piped.alias("piped")))).alias("lines"))
    of = lambda c: F.transform("lines", lambda x: x[c])
    head = F.concat(F.rpad(F.lit("Item"), 26, " "), F.lit(" Qty"), F.lit("   "), F.lpad(F.lit("Amount"), 14, " "))
    aligned = F.array_join(F.concat(F.array(F.lit("Your bill:"), F.lit(""), head), of("spaced"), F.array(F.lit(""), F.lit("Thank you  very much."))), "\n")
    pipes = F.array_join(F.concat(F.array(F.lit("See:"), F.lit("| Item | Qty | Amount |"), F.lit("|---|---|---|")), of("piped")), "\n")
    quoted = F.array_join(F.concat(F.array(F.lit("As I wrote:")), F.transform(F.concat(F.array(head), of("spaced")), lambda x: F.concat(F.lit("> "), x))), "\n")
    return lines.select("l_orderkey", F.size("lines").alias("n"), F.when(F.col("l_orderkey") % 3 == 0, aligned).when(F.col("l_orderkey") % 3 == 1, pipes).otherwise(quoted).alias("text"))


def t09_u04_text_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the tables in bills, in text and in what it quotes."""
    found = tables_with_quoted(_bills(spark, d), "l_orderkey")
    rows = found.select("l_orderkey", "kind", "quoted", F.array_join("headers", "|").alias("headers"), F.posexplode("rows").alias("no", "cells"))
    return rows.select("l_orderkey", "kind", "quoted", "headers", (F.col("no") + 1).cast("long").alias("no"), F.array_join("cells", "|").alias("cells"))


QUERIES = {f.__name__: f for f in (t09_u04_text_tables,)}
ORACLE_SQL = {
    "t09_u04_text_tables": """SELECT l_orderkey, ['aligned', 'pipe', 'aligned'][l_orderkey % 3 + 1] AS kind, l_orderkey % 3 = 2 AS quoted, 'Item|Qty|Amount' AS headers,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, rpad('Part ' || l_partkey || ' ' || l_returnflag, 26, ' ') || lpad(CAST(CAST(l_quantity AS INT) AS VARCHAR), 4, ' ') || lpad(format('{:.2f}', l_extendedprice), 14, ' ')) AS no, concat_ws('|', 'Part ' || l_partkey || ' ' || l_returnflag, CAST(l_quantity AS INT), format('{:.2f}', l_extendedprice)) AS cells
        FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE l_orderkey % 3 = 1 OR n >= 2""",
}

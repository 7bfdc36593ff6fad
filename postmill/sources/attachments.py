"""Attachments to text and tables of one shape.

The kind comes from the first bytes, the declared type and the name, as a column expression. Readers
are small maps over rows by kind with the standard library: delimited text, spreadsheets and word
documents (zip with XML inside), HTML and plain text. A broken attachment gives a warning, never an
error. PDF text needs a library that isn't here; its rows say so.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import _ship  # noqa: F401
from .mime import decode_text

MAX_ROWS, MAX_COLUMNS, MAX_MEMBERS, MAX_MEMBER = 2000, 256, 4096, 64 << 20
TABLE = "struct<source:string,index:int,headers:array<string>,rows:array<array<string>>,row_count:bigint,truncated:boolean>"
RESULT = f"kind string, text string, tables array<{TABLE}>, warnings array<string>"


def sniff(content: Column, filename: Column, content_type: Column) -> Column:
    """pdf, xlsx, docx, zip, image, html, csv, message, text or binary."""
    head = lambda *magic: content.startswith(F.unhex(F.lit("".join(magic))))
    ext, declared = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([A-Za-z0-9]+)$", 1)), F.lower(F.coalesce(content_type, F.lit("")))
    first = F.lower(F.decode(F.substring(content, 1, 400), "ISO-8859-1"))
    return (
        F.when(content.isNull() | (F.length(content) == 0), "empty")
        .when(head("25504446"), "pdf")
        .when(head("504B0304"), F.when(ext.isin("xlsx", "docx"), ext).when(F.contains(declared, F.lit("spreadsheet")), "xlsx").when(F.contains(declared, F.lit("wordprocessing")), "docx").otherwise("zip"))
        .when(head("89504E47") | head("FFD8FF") | head("47494638"), "image")
        .when(first.rlike(r"^\s*(<!doctype html|<html)") | (declared == "text/html"), "html")
        .when((declared == "text/csv") | ext.isin("csv", "tsv"), "csv")
        .when((declared == "message/rfc822") | (ext == "eml"), "message")
        .when(declared.startswith("text/") | ~first.rlike("[\\x00-\\x08]"), "text")
        .otherwise("binary")
    )


def make_table(source: str, index: int, grid: list[list[str]], headed: bool = True) -> dict:
    """Headers made unique; rows padded to them and capped, with the whole count."""
    grid = [r[:MAX_COLUMNS] for r in grid]
    width = max(map(len, grid), default=0)
    first = grid[0] if headed and grid else []
    names, used = [], {}
    for i in range(width):
        name = (first[i].strip() if i < len(first) else "") or f"col{i + 1}"
        used[name] = used.get(name, 0) + 1
        names.append(name if used[name] == 1 else f"{name}_{used[name]}")
    rows = [[(c.strip() or None) for c in r] + [None] * (width - len(r)) for r in grid[bool(first) :]]
    return {"source": source, "index": index, "headers": names, "rows": rows[:MAX_ROWS], "row_count": len(rows), "truncated": len(rows) > MAX_ROWS}


def delimiter(text: str) -> str:
    """The separator that splits lines most evenly."""
    lines = [x for x in text.splitlines()[:200] if x.strip()]
    best = max((((n := sorted(x.count(s) for x in lines))[len(n) // 2], s) for s in ",;\t|"), default=(0, ","), key=lambda p: (p[0] > 0) * (10 * sum(x.count(p[1]) == p[0] for x in lines) + p[0]))
    return best[1] if best[0] else ","


def read_csv(content: bytes) -> tuple[str, list[dict]]:
    text = decode_text(content.removeprefix(b"\xef\xbb\xbf"), None)
    grid = [r for r in csv.reader(io.StringIO(text), delimiter=delimiter(text)) if any(c.strip() for c in r)]
    return text, [make_table("csv", 0, grid)] if grid else []


def _members(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > MAX_MEMBERS:
            raise ValueError("too many members")
        return {i.filename: z.read(i) for i in infos if i.file_size <= MAX_MEMBER and i.filename.endswith((".xml", ".rels"))}


_local = lambda e: e.tag.rpartition("}")[2]
_texts = lambda e, name="t": "".join(x.text or "" for x in e.iter() if _local(x) == name)


def read_xlsx(content: bytes) -> tuple[str, list[dict]]:
    """A table for each sheet, of cached values; a cell's column comes from its reference."""
    parts = _members(content)
    strings = [_texts(si) for si in ElementTree.fromstring(parts["xl/sharedStrings.xml"]) if _local(si) == "si"] if "xl/sharedStrings.xml" in parts else []
    tables = []
    for name in sorted((n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0])):
        grid = []
        for row in (e for e in ElementTree.fromstring(parts[name]).iter() if _local(e) == "row"):
            cells: dict[int, str] = {}
            for c in (e for e in row if _local(e) == "c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                value, kind = _texts(c, "v"), c.get("t")
                cells[at] = strings[int(value)] if kind == "s" and value else _texts(c) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value
            grid.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        grid = [r for r in grid if any(c.strip() for c in r)]
        if grid:
            tables.append(make_table("xlsx", len(tables), grid))
    return "\n".join("\t".join(c or "" for c in r) for t in tables for r in [t["headers"], *t["rows"]]), tables


def read_docx(content: bytes) -> tuple[str, list[dict]]:
    body = ElementTree.fromstring(_members(content)["word/document.xml"])
    paragraphs = [_texts(p) for p in body.iter() if _local(p) == "p"]
    grids = [[[" ".join(_texts(p) for p in c.iter() if _local(p) == "p") for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"] for t in body.iter() if _local(t) == "tbl"]
    return "\n".join(paragraphs), [make_table("docx", i, g) for i, g in enumerate(g for g in grids if g)]


#: Elements without an end, and elements whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style head title template noscript".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|mso-hide\s*:\s*all|(?:font-size|max-height|opacity)\s*:\s*0(?:px|pt|em)?\s*(?:;|$)", re.I)


def is_hidden(tag: str, attrs: dict[str, str | None]) -> bool:
    """Elements that a reader doesn't see: preheaders, hidden blocks, scripts."""
    return tag in UNSHOWN or "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style") or "") is not None


def is_pixel(attrs: dict[str, str | None]) -> bool:
    """An image of one pixel or none, which only counts views."""
    return any((attrs.get(side) or "").strip().removesuffix("px") in ("0", "1") for side in ("width", "height"))


class _Html(HTMLParser):
    """Text with one line for each block, and the grids of innermost tables; hidden elements are left out."""

    def __init__(self) -> None:
        super().__init__()
        self.text, self.grids, self.stack, self.cell = [], [], [], None
        self.open: list[tuple[str, bool]] = []  # open elements, and whether they are hidden

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "img" and named.get("alt") and not is_pixel(named) and not is_hidden(tag, named):
            self.handle_data(named["alt"])
        if tag in ("p", "li", "tr", "td", "th") and self.open and self.open[-1][0] == tag:
            self.open.pop()  # its end tag may be left out
        if tag not in VOID:
            self.open.append((tag, bool(self.open) and self.open[-1][1] or is_hidden(tag, named)))
        if self.open and self.open[-1][1]:
            return
        if tag == "table":
            self.stack.append([])
        elif tag == "tr" and self.stack:
            self.stack[-1].append([])
        elif tag in ("td", "th") and self.stack and self.stack[-1]:
            self.stack[-1][-1].append("")
            self.cell = self.stack[-1][-1]
        if tag in ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "table"):
            self.text.append("\n- " if tag == "li" else "\n")

    def handle_endtag(self, tag: str) -> None:
        hidden = bool(self.open) and self.open[-1][1]
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if hidden:
            return
        if tag in ("td", "th"):
            self.cell = None
            self.text.append("\t")
        elif tag == "table" and self.stack:
            grid = [r for r in self.stack.pop() if r]
            if sum(sum(bool(c.strip()) for c in r) >= 2 for r in grid) >= 2:
                self.grids.append(grid)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.cell is not None:
                self.cell[-1] += data


def read_html(content: bytes) -> tuple[str, list[dict]]:
    parser = _Html()
    parser.feed(decode_text(content, None))
    parser.close()
    lines = ("\t".join(" ".join(c.split()) for c in x.split("\t")).strip() for x in "".join(parser.text).split("\n"))
    return "\n".join(x for x in lines if x), [make_table("html", i, [[" ".join(c.split()) for c in r] for r in g]) for i, g in enumerate(parser.grids)]


def read_text(content: bytes) -> tuple[str, list[dict]]:
    """Plain text; runs of lines with a pipe at both ends are tables."""
    for mark, charset in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if content.startswith(mark):
            text = content[len(mark) :].decode(charset, "replace")
            break
    else:
        text = decode_text(content, None)
    tables, run = [], []
    for line in [*text.split("\n"), ""]:
        if re.fullmatch(r"\s*\|.*\|\s*", line):
            run.append([c.strip() for c in line.strip().strip("|").split("|")])
            continue
        grid = [r for r in run if not all(re.fullmatch(r":?-+:?", c) for c in r)]
        if len(grid) >= 2:
            tables.append(make_table("text", len(tables), grid))
        run = []
    return text, tables


READERS = {"csv": read_csv, "xlsx": read_xlsx, "docx": read_docx, "html": read_html, "text": read_text}


def extract_attachments(rows: DataFrame, *, content: str = "content", filename: str = "filename", content_type: str = "content_type") -> DataFrame:
    """``rows`` with kind, text, tables and warnings in place of the bytes."""
    known = rows.withColumn("__kind", sniff(F.col(content), F.col(filename), F.col(content_type)))
    kept = [f for f in rows.schema if f.name not in (content, "kind", "text", "tables", "warnings")]
    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + RESULT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, body in zip(b["__kind"], b[content], strict=True):
                try:
                    text, tables, warnings = *READERS[kind](bytes(body)), []
                except KeyError as e:
                    text, tables, warnings = None, [], [f"no_reader:{kind}" if kind not in READERS else f"missing_part:{e}"]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error, IndexError) as e:
                    text, tables, warnings = None, [], [f"unreadable:{type(e).__name__}"]
                out.append((kind, text, tables, warnings))
            made = pd.DataFrame(out, columns=["kind", "text", "tables", "warnings"], index=b.index)
            yield pd.concat([b[[f.name for f in kept]], made], axis=1)

    return known.mapInPandas(run, ddl)


def table_rows(extracted: DataFrame, key: str) -> DataFrame:
    """A row for each row of each table, as a map by header; an attachment without tables has none."""
    t = extracted.select(key, F.explode("tables").alias("t"))
    return t.select(key, F.col("t.source").alias("source"), F.col("t.index").alias("table"), F.posexplode(F.transform("t.rows", lambda r: F.map_from_arrays(F.col("t.headers"), r))).alias("row", "record"))

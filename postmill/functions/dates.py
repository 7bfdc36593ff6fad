"""Dates in running text: six forms, conventions voted by the whole text, confidence, and what they were read from.

Batches of texts are read in tasks by Python's patterns: one expression of nested lambdas took several times as long."""

from __future__ import annotations

import re
from datetime import date
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import _ship  # noqa: F401
from ..sources.tables import table
from . import spans as S
from . import text as T

#: Names of the months in English, German, French, Spanish and Italian, long and short.
MONTHS = (
    "jan january januar janvier enero gennaio ene", "feb february februar fevrier février febrero febbraio fev", "mar march märz marz maerz mars marzo", "apr april avril abril aprile abr",
    "may mai mayo maggio mag", "jun june juni juin junio giugno", "jul july juli juillet julio luglio", "aug august aout août agosto ago",
    "sep sept september septembre septiembre settembre set", "oct october oktober octobre octubre ottobre okt ott", "nov november novembre noviembre", "dec december dezember décembre decembre diciembre dicembre dez dic",
)
MONTH_OF = {name: no for no, names in enumerate(MONTHS, 1) for name in names.split()}
_MONTH = "(" + "|".join(sorted(MONTH_OF, key=len, reverse=True)) + ")"
_SPACE = S.SPACE.replace(r"\s", r" \t-\r")
_DAY, _NTH, _GAP = "([0-9]{1,2})", "(?:st|nd|rd|th)?", _SPACE + "+"
#: The forms, with the confidence of each: year first, the month by its name, a day without a year, and numbers alone.
FORMS = {
    "iso": (S.LEFT + r"([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9-])", 0.99),
    "slashed": (S.LEFT + r"([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})" + S.RIGHT, 0.95),
    "day_month": (rf"(?i){S.LEFT}{_DAY}\.?{_NTH}{_GAP}{_MONTH}\.?,?{_GAP}([0-9]{{2,4}}){S.RIGHT}", 0.98),
    "month_day": (rf"(?i){S.LEFT}{_MONTH}\.?{_GAP}{_DAY}{_NTH},?{_GAP}([0-9]{{2,4}}){S.RIGHT}", 0.98),
    "no_year": (rf"(?i){S.LEFT}{_DAY}\.{_SPACE}*{_MONTH}{S.RIGHT}(?!{_SPACE}*[0-9])", 0.7),
    "numeric": (S.LEFT + r"([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{2,4})" + S.RIGHT, 0.9),
}
#: What a text holds that has a date of a form, looked for first as the forms, names of months above all, are slow to look for.
HOLDS = {
    "iso": "[0-9]-[0-9]",
    "slashed": "[0-9]/[0-9]",
    "day_month": rf"[0-9]\.?(?:[SsNnRrTt\u017f][TtDdHh])?{_GAP}[^\W0-9_]",
    "month_day": rf"{_SPACE}[0-9]{{1,2}}(?:[SsNnRrTt\u017f][TtDdHh])?,?{_GAP}[0-9]{{2}}",
    "no_year": rf"[0-9]\.{_SPACE}*[^\W0-9_]",
    "numeric": "[0-9][./-][0-9]",
}
COMPILED = {form: (re.compile(HOLDS[form]), re.compile(pattern), sure) for form, (pattern, sure) in FORMS.items()}
FIELDS = {"value": pa.date32(), "raw": pa.string(), "start": pa.int32(), "end": pa.int32(), "confidence": pa.float64(), "ambiguous": pa.bool_(), "no": pa.int32()}
DATES = "array<struct<value:date,raw:string,start:int,end:int,confidence:double,ambiguous:boolean,no:int>>"
EPOCH = date(1970, 1, 1).toordinal()
#: Confidence of a numeric date that can be read one way, by the text's convention, by the sender's, by neither; and the most of one whose year is inferred.
SURE, VOTED, HINTED, GUESSED, INFERRED = 0.97, 0.8, 0.72, 0.55, 0.65
#: Endings of domains, and beginnings of locales, that write the day or the month first.
DAY_FIRST = "de at ch uk fr it es nl be pl cz se no dk fi pt gr ie au nz in br ar ru tr za eu".split()
MONTH_FIRST = "us ph".split()
NEITHER = "com net org io".split()
DAY_FIRST_LOCALES, MONTH_FIRST_LOCALES = "^(?:de|fr|es|it|nl|pt|pl)", "^(?:en-us|us)"


def convention(locale: Column) -> Column:
    """'dmy' or 'mdy' by a domain's ending or a locale; null where it tells neither."""
    low = F.lower(locale)
    ending = F.regexp_extract(low, r"\.([a-z]{2,})$", 1)
    return (
        F.when(ending.isin(DAY_FIRST), "dmy").when(ending.isin(MONTH_FIRST), "mdy").when(ending.isin(NEITHER), F.lit(None))
        .when(low.rlike(DAY_FIRST_LOCALES), "dmy").when(low.rlike(MONTH_FIRST_LOCALES), "mdy")
    )


def _year(digits: str) -> int:
    """Two digits are of 1970 to 2069."""
    n = int(digits)
    return n if len(digits) > 2 else 2000 + n if n < 70 else 1900 + n


def _read(form: str, g: tuple[str, ...]) -> tuple:
    """Year, month and day of a match, and the two first numbers and the separator of numbers alone."""
    if form in ("iso", "slashed"):
        return int(g[0]), int(g[1]), int(g[2]), None, None, None
    if form == "day_month":
        return _year(g[2]), MONTH_OF.get(g[1].lower()), int(g[0]), None, None, None
    if form == "month_day":
        return _year(g[2]), MONTH_OF.get(g[0].lower()), int(g[1]), None, None, None
    if form == "no_year":
        return None, MONTH_OF.get(g[1].lower()), int(g[0]), None, None, None
    return _year(g[3]), None, None, int(g[0]), int(g[2]), g[1]


def _vote(a: int, b: int, sep: str) -> int:
    """Twice a vote for days first, less one for months first: of a date that reads one way only, and half a vote of each other dotted one."""
    return 2 if a > 12 >= b else -2 if b > 12 >= a else int(sep == ".")


def _found(text: str, hint: str | None, year: int | None) -> list[tuple]:
    """(value as days since 1970, raw, start, end, confidence, ambiguous, no) of a text's dates."""
    hits = []
    for no, (form, (held, pattern, sure)) in enumerate(COMPILED.items()):
        if held.search(text):
            hits += [(m.start(), no, m.end(), m[0], sure, *_read(form, m.groups())) for m in pattern.finditer(text)]
    if not hits:
        return []
    hits.sort(key=itemgetter(0, 1))
    votes = sum([_vote(*h[8:]) for h in hits if h[8] is not None])
    known, seen = [], set()
    for start, no, end, raw, sure, y, mo, d, a, b, _ in hits:
        ambiguous = False
        if a is not None:
            ambiguous = a <= 12 and b <= 12
            months_first = b > 12 >= a or ambiguous and (votes < 0 if votes else hint == "mdy")
            mo, d = (a, b) if months_first else (b, a)
            sure = SURE if not ambiguous else VOTED if votes else GUESSED if hint is None else HINTED
        elif y is None:
            y, sure = year, min(sure, INFERRED)
        if y is None or mo is None or not 1900 <= y <= 2999:
            continue
        try:
            value = date(y, mo, d).toordinal() - EPOCH
        except ValueError:
            continue
        if (value, raw) not in seen:
            seen.add((value, raw))
            known.append((value, raw, start, end, sure, ambiguous, no))
    if len(known) < 2:
        return known
    reached, apart = -1, []
    for x in sorted(known, key=lambda x: (x[2], -x[3], x[6])):
        if x[3] > reached:
            reached = x[3]
            apart.append(x)
    return apart


def _dates_of(texts: pa.Array, hints: pa.Array, years: pa.Array) -> pa.Array:
    """Dates of each text of a batch."""
    found = [_found(t, h, y) if t else [] for t, h, y in zip(texts.to_pylist(), hints.to_pylist(), years.to_pylist())]
    offsets = pa.array([0, *accumulate(map(len, found))], pa.int32())
    columns = list(zip(*chain.from_iterable(found))) or [()] * len(FIELDS)
    kinds = list(FIELDS.values())
    values = [pa.array(columns[0], pa.int32()).cast(kinds[0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:]))]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=list(FIELDS)))


def dates(text: Column, locale: Column | None = None, reference_year: Column | None = None) -> Column:
    """array<struct<value, raw, start, end, confidence, ambiguous, no>> of the valid dates by place, each value and spelling once, without those that a longer one covers.

    ``locale``: the sender's domain or a locale. ``reference_year``: that of dates without one, else this year.
    Read in batches inside tasks, so it can't stand in the lambda of another expression."""
    hint = F.lit(None).cast("string") if locale is None else convention(locale)
    year = F.year(F.current_date()) if reference_year is None else reference_year
    return F.arrow_udf(_dates_of, DATES)(F.when(text.rlike("[0-9]"), text), hint, year.cast("int"))


def to_date(raw: Column, locale: Column | None = None, reference_year: Column | None = None) -> Column:
    """The first date of a text."""
    return F.get(dates(F.trim(raw), locale, reference_year), F.lit(0))["value"]


# Queries

def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders dealt anew: a file of few bytes a row is read by few tasks, and each row has much to do."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").hint("rebalance")


def _spelt(spark: SparkSession, d: str) -> DataFrame:
    """Orders as mails of many locales would date them, with a second date that settles the convention, or doesn't."""
    day = lambda f: F.date_format("o_orderdate", f)
    month = lambda k: F.get(F.array(*(F.lit(names.split()[k]) for names in MONTHS)), F.month("o_orderdate") - 1)
    d_, y_ = F.dayofmonth("o_orderdate").cast("string"), day("yyyy")
    forms = (
        F.concat(F.lit("am "), d_, F.lit(". "), month(2), F.lit(" "), y_, F.lit(" fällig")),
        F.concat(F.lit("by "), day("yyyy/MM/dd"), F.lit(".")),
        F.concat(F.lit("by "), month(1), F.lit(" "), d_, F.lit("th, "), y_),
        F.concat(F.lit("le "), d_, F.lit(" "), month(3), F.lit(" "), y_),
        F.concat(day("d.M.yy"), F.lit(" it was")),
        F.concat(F.lit("at "), day("yyyy-MM-dd"), F.lit("T10:00:00Z")),
        F.concat(day("d/M/yyyy"), F.lit(", as on 31/12/2024")),
        F.concat(day("M/d/yyyy"), F.lit(", as on 12/31/2024")),
        F.concat(day("M-d-yyyy"), F.lit(" alone")),
        F.concat(d_, F.lit(". "), month(1), F.lit(" and "), d_, F.lit("."), F.month("o_orderdate").cast("string"), F.lit("."), y_, F.lit(" and 31.02.2024")),
    )
    k = (F.col("o_orderkey") % len(forms)).cast("int")
    return _orders(spark, d).select("o_orderkey", "o_orderdate", F.get(F.array(*forms), k).alias("said"), F.when(k == 8, "acme.us").alias("locale"))


def _shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(" ", F.date_format(x["value"], "yyyy-MM-dd"), F.format_number(x["confidence"], 2), F.when(x["ambiguous"], "?"))), ";")


def t24_date_forms(spark: SparkSession, d: str) -> DataFrame:
    return _spelt(spark, d).select("o_orderkey", _shown(dates(F.col("said"), F.col("locale"), F.lit(2031))).alias("dates"))


def t24_document_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dotted dates of whole documents, addresses of machines included, beside one that their end states."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" seen on "), F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int")), "dd.MM.yyyy"))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(dates(said), lambda x: F.concat_ws(" ", F.date_format(x["value"], "yyyy-MM-dd"), x["raw"])), ";").alias("dates"))


def t25_t28_dates(spark: SparkSession, d: str) -> DataFrame:
    y, m, day = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    iso, dotted, slashed = F.format_string("%04d-%02d-%02d", y, m, day), F.format_string("%d.%d.%d", day, m, y), F.format_string("due %04d-%02d-%02dT10:00:00Z", y, m, day)
    raw = F.get(F.array(iso, dotted, slashed, F.lit("2023-02-30"), F.lit("soon")), (F.col("o_orderkey") % 5).cast("int"))
    return _orders(spark, d).select("o_orderkey", F.date_format(to_date(raw), "yyyy-MM-dd").alias("date"))


def t27_locale_hint(spark: SparkSession, d: str) -> DataFrame:
    """Conventions of hosts, under their own ending and others."""
    host = F.concat(F.regexp_extract("url", T.HOST, 1), F.get(F.array(*map(F.lit, ("", ".de", ".us", ".org", ".xyz", ".co.uk"))), (F.col("page_id") % 6).cast("int")))
    return table(spark, d, "pages").select("page_id", convention(host).alias("hint"))


QUERIES = {f.__name__: f for f in (t24_date_forms, t24_document_dates, t25_t28_dates, t27_locale_hint)}
_list = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
ORACLE_SQL = {
    "t24_date_forms": """WITH o AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_orderdate AS t, strftime(o_orderdate, '%Y-%m-%d') AS v, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)
        SELECT o_orderkey, CASE
            WHEN k IN (0, 2, 3) THEN v || ' 0.98' WHEN k = 1 THEN v || ' 0.95' WHEN k = 5 THEN v || ' 0.99'
            WHEN k = 4 THEN v || CASE WHEN d > 12 THEN ' 0.97' ELSE ' 0.80 ?' END
            WHEN k IN (6, 7) THEN CASE WHEN (k = 6 AND d = 31 AND m = 12 AND year(t) = 2024) THEN '' ELSE v || CASE WHEN d > 12 THEN ' 0.97' ELSE ' 0.80 ?' END || ';' END || '2024-12-31 0.97'
            WHEN k = 8 THEN v || CASE WHEN d > 12 THEN ' 0.97' ELSE ' 0.72 ?' END
            ELSE CASE WHEN d = 29 AND m = 2 THEN '' ELSE '2031-' || strftime(t, '%m-%d') || ' 0.65;' END || v || CASE WHEN d > 12 THEN ' 0.97' ELSE ' 0.80 ?' END END AS dates FROM o""",
    "t24_document_dates": r"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' seen on ' || strftime(DATE '1995-01-01' + CAST(doc_id % 4000 AS INT), '%d.%m.%Y') AS said FROM documents),
        m AS (SELECT doc_id, regexp_extract_all(said, '(?:^|[^0-9A-Za-z_])([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4})\b', 1) AS l FROM t),
        p AS (SELECT doc_id, i, l[i] AS raw, CAST(string_split(l[i], '.')[1] AS INT) AS a, CAST(string_split(l[i], '.')[2] AS INT) AS b, string_split(l[i], '.')[3] AS y FROM (SELECT doc_id, l, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i FROM m)),
        v AS (SELECT *, sum(CASE WHEN a > 12 AND b <= 12 THEN 2 WHEN b > 12 AND a <= 12 THEN -2 ELSE 1 END) OVER (PARTITION BY doc_id) AS votes FROM p),
        r AS (SELECT *, a <= 12 AND (b > 12 OR votes < 0) AS mdy, CASE WHEN length(y) > 2 THEN CAST(y AS INT) WHEN CAST(y AS INT) < 70 THEN 2000 + CAST(y AS INT) ELSE 1900 + CAST(y AS INT) END AS year FROM v WHERE a <= 12 OR b <= 12),
        d AS (SELECT doc_id, i, raw, CASE WHEN year BETWEEN 1900 AND 2999 THEN try_strptime(year || '-' || CASE WHEN mdy THEN a ELSE b END || '-' || CASE WHEN mdy THEN b ELSE a END, '%Y-%m-%d') END AS value FROM r),
        f AS (SELECT doc_id, min(i) AS i, strftime(value, '%Y-%m-%d') || ' ' || raw AS shown FROM d WHERE value IS NOT NULL GROUP BY doc_id, value, raw)
        SELECT t.doc_id, coalesce(string_agg(shown, ';' ORDER BY i), '') AS dates FROM t LEFT JOIN f ON f.doc_id = t.doc_id GROUP BY t.doc_id""",
    "t25_t28_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders",
    "t27_locale_hint": rf"""WITH h AS (SELECT page_id, regexp_extract(url, '{T.HOST}', 1) || ['', '.de', '.us', '.org', '.xyz', '.co.uk'][page_id % 6 + 1] AS host FROM pages),
        e AS (SELECT page_id, host, regexp_extract(lower(host), '\.([a-z]+)$', 1) AS ending FROM h)
        SELECT page_id, CASE WHEN ending IN {_list(DAY_FIRST)} THEN 'dmy' WHEN ending IN {_list(MONTH_FIRST)} THEN 'mdy' WHEN ending IN {_list(NEITHER)} THEN NULL
            WHEN regexp_matches(host, '{DAY_FIRST_LOCALES}') THEN 'dmy' WHEN regexp_matches(host, '{MONTH_FIRST_LOCALES}') THEN 'mdy' END AS hint FROM e""",
}

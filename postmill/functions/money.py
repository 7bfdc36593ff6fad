"""Amounts of money in running text: a lexer of currency symbols and codes, longest first, beside numbers of any locale."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import spans as S
from . import text as T

_LEXEMES = [*sorted((s for s in T.SYMBOLS if s not in T.NO_LEXEME), key=len, reverse=True), *T.CODES]
_any = lambda lexemes: "|".join(re.escape(s) for s in lexemes).replace("Fr", r"Fr\.?")
SYMBOLS, CODES = _any(s for s in _LEXEMES if s not in T.CODES), _any(T.CODES)  # patterns of both
#: A currency of letters that is part of a longer word is none, as `AED3` in a key and `Fr` in `6261 From`. Words that begin with a currency and name it are left.
_LETTER = r"[\p{L}_]"
_ALONE = rf"(?<!{_LETTER}[0-9]{{0,40}})"
_ENDS = rf"(?!(?!(?:OS?|onor|oner|onur|ona|one|anken|ancs?|oty|otych|ote)(?!{_LETTER})){_LETTER})"
_SIGNS, _WORDS = _any(s for s in _LEXEMES if not s[0].isalpha()), _any(s for s in _LEXEMES if s[0].isalpha())
_AFTER = rf"{_any(s for s in _LEXEMES if not s[-1].isalpha())}|(?:{_any(s for s in _LEXEMES if s[-1].isalpha())}){_ENDS}"
_BEFORE = rf"{_SIGNS}|(?={_WORDS}){_ALONE}(?:{_WORDS})"
#: Groups of thousands, parted by one kind of sign; the first begins a run of digits.
_GROUPS = "(?:" + "|".join(rf"(?:{sep}[0-9]{{3}})+" for sep in (r"\.", ",", "[’‘']", S.SPACE)) + ")"
#: Dots of a machine's address (four numbers up to 255, without leading zeros) group no thousands, wherever in it a number begins.
_PART = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PARTS = lambda n: rf"{_PART}(?:\.{_PART}){{{n - 1}}}(?![0-9]|[.,][0-9])"
_NO_ADDRESS = rf"(?!{_PARTS(4)})(?!(?<={_PART}\.[0-9]{{0,2}}){_PARTS(3)})(?!(?<={_PART}\.{_PART}\.[0-9]{{0,2}}){_PARTS(2)})"
_NUMBER = rf"{_NO_ADDRESS}(?<![0-9])[0-9]{{1,3}}{_GROUPS}(?:[.,][0-9]{{1,4}})?|[0-9]+(?:[.,][0-9]{{1,4}})?"
_COUNTED = _NUMBER.replace("|[0-9]+", "|[0-9]++")  # a currency can't stand within a run of digits
_HYPHEN = r"(?<![\p{L}0-9])"  # a dash after a letter or digit is no sign
_WIDE = r"[ \u00a0\u202f]"
_FIRST = "".join(sorted({re.escape(s[0]) for s in (*T.SYMBOLS, *T.CODES)}))  # what an amount may begin with, so that most places are passed over at once
#: A sign, then a currency at most three blanks before its number, or after it with no further number within two blanks, then a sign.
MONEY = (
    rf"(?=[-−(  ]*[0-9{_FIRST}])((?:{_HYPHEN}[-−]|\()?[  ]*)(?:({_BEFORE}){_WIDE}{{0,3}}({_NUMBER})"
    rf"|({_COUNTED})(?:{_WIDE}{{1,3}}|(?![A-Za-z])|{_ALONE})({_AFTER})(?!{_WIDE}{{0,2}}[0-9]))([-−)]?)"
)
#: What any text with an amount holds. The look ahead passes over most places.
HINT = rf"(?=[{_FIRST}])(?:{SYMBOLS}|{CODES})"


def all_amounts(text: Column) -> Column:
    """array<struct<value, currency, raw, start, end>> of every amount, in order."""

    def amount(s: Column) -> Column:
        sign, tail = F.trim(F.coalesce(S.group(s, 1), F.lit(""))), S.group(s, 6)
        number = T.parse_number(F.coalesce(S.group(s, 3), S.group(s, 4)))
        minus = sign.isin("-", "−", "(") | F.coalesce(tail.isin("-", "−"), F.lit(False))
        lead = F.length(s["raw"]) - F.length(F.regexp_replace(s["raw"], rf"^{S.SPACE}+", ""))
        return F.struct(
            F.when(minus, -F.abs(number)).otherwise(number).alias("value"), T.currency(F.coalesce(S.group(s, 2), S.group(s, 5))).alias("currency"),
            F.regexp_replace(s["raw"], rf"^{S.SPACE}+|{S.SPACE}+$", "").alias("raw"), (s["start"] + lead).alias("start"), s["end"].alias("end"),
        )

    some = F.when(text.rlike("[0-9]") & text.rlike(HINT), text).otherwise("")
    return F.filter(F.transform(S.spans(some, MONEY, 6), amount), lambda a: a["value"].isNotNull() & a["currency"].isNotNull())


def amounts(text: Column) -> Column:
    """The first of each value and currency."""
    return T.first_of_each(all_amounts(text), lambda a: F.struct(a["value"], a["currency"]))


# Queries

def _priced(spark: SparkSession, d: str) -> DataFrame:
    """Orders as mails of many locales would price them."""
    us = F.format_number("o_totalprice", 2)
    german, swiss, french = F.translate(us, ",.", ".,"), F.replace(us, F.lit(","), F.lit("’")), F.translate(us, ",.", " ,")
    forms = (
        F.concat(F.lit("pay C$"), us, F.lit(" now")), F.concat(us, F.lit(" US$ in all")), F.concat(F.lit("kr "), german), F.concat(german, F.lit(" EUR- credited")),
        F.concat(F.lit("CHF "), swiss, F.lit(", or ("), F.lit("HK$"), us, F.lit(")")), F.concat(F.lit("−"), us, F.lit(" zł")), F.concat(french, F.lit(" €")),
        F.concat(F.lit("Qty 1 $"), us), F.concat(F.lit("4        "), german, F.lit(" EUR     298,00 EUR")), F.concat(F.lit("no money: "), us), F.concat(F.lit("RMB "), us, F.lit(" and RMB "), us),
        F.concat(F.lit("NZ$"), us, F.lit(" A$"), us, F.lit(" "), us, F.lit(" ISK")),
    )
    return table(spark, d, "orders").select("o_orderkey", F.get(F.array(*forms), (F.col("o_orderkey") % len(forms)).cast("int")).alias("said"))


def t22_money_forms(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform(amounts(F.col("said")), lambda a: F.concat_ws(" ", F.replace(F.format_number(a["value"], 2), F.lit(","), F.lit("")), a["currency"]))
    return _priced(spark, d).select("o_orderkey", F.array_join(shown, ";").alias("amounts"))


def t22_document_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of whole documents, with their places."""
    found = amounts(F.concat_ws(" ", "text", F.concat(F.lit("for € "), (F.col("doc_id") % 900 + 1).cast("string"), F.lit(",50"))))
    shown = F.transform(found, lambda a: F.concat_ws(" ", F.replace(F.format_number(a["value"], 2), F.lit(","), F.lit("")), a["currency"], a["start"].cast("string")))
    return table(spark, d, "documents").select("doc_id", F.array_join(shown, ";").alias("amounts"))


def t23_currencies(spark: SparkSession, d: str) -> DataFrame:
    """Each part under a symbol or code, in several spellings."""
    known = F.array(*map(F.lit, [*T.SYMBOLS, *T.CODES]))
    token = F.get(known, (F.col("p_partkey") % F.size(known)).cast("int"))
    spelt = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), token, F.lit(". "))).otherwise(token)
    return table(spark, d, "part").select("p_partkey", T.currency(spelt).alias("currency"))


QUERIES = {f.__name__: f for f in (t22_money_forms, t22_document_amounts, t23_currencies)}
_amount = "format('{:.2f}', o_totalprice)"
ORACLE_SQL = {
    "t22_money_forms": f"""SELECT o_orderkey, CASE o_orderkey % 12 WHEN 0 THEN {_amount} || ' CAD' WHEN 1 THEN {_amount} || ' USD' WHEN 2 THEN {_amount} || ' SEK' WHEN 3 THEN '-' || {_amount} || ' EUR'
        WHEN 4 THEN {_amount} || ' CHF;-' || {_amount} || ' HKD' WHEN 5 THEN '-' || {_amount} || ' PLN' WHEN 6 THEN {_amount} || ' EUR' WHEN 7 THEN {_amount} || ' USD' WHEN 8 THEN {_amount} || ' EUR;298.00 EUR'
        WHEN 9 THEN '' WHEN 10 THEN {_amount} || ' CNY' ELSE {_amount} || ' NZD;' || {_amount} || ' AUD;' || {_amount} || ' ISK' END AS amounts FROM orders""",
    "t22_document_amounts": r"""WITH t AS (SELECT doc_id, concat_ws(' ', text, 'for € ' || (doc_id % 900 + 1) || ',50') AS said, doc_id % 900 + 1 || '.50 EUR' AS own FROM documents),
        m AS (SELECT doc_id, said, own, list_concat(regexp_extract_all(said, '\$ {0,3}[0-9]+(?:[.,][0-9]{1,4})?'), regexp_extract_all(said, '([0-9]+(?:[.,][0-9]{1,4})? {0,3}\$)(?: {0,2}[^0-9 ]|$)', 1)) AS l FROM t),
        n AS (SELECT doc_id, said, own, list_transform(l, lambda x: {'at': strpos(said, x) - 1, 'raw': regexp_extract(x, '[0-9]+(?:[.,][0-9]{1,4})?')}) AS l FROM m),
        f AS (SELECT doc_id, said, own, list_sort(list_transform(l, lambda x: (x.at, format('{:.2f}', CAST(CASE WHEN regexp_matches(x.raw, '^[0-9]{1,3}[.,][0-9]{3}$') THEN translate(x.raw, ',.', '') ELSE replace(x.raw, ',', '.') END AS DOUBLE))))) AS l FROM n),
        u AS (SELECT doc_id, said, own, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: y[2]), x[2]) = i) AS l FROM f)
        SELECT doc_id, concat_ws(';', nullif(array_to_string(list_transform(l, lambda x: x[2] || ' USD ' || x[1]), ';'), ''), own || ' ' || (length(said) - length(split_part(own, '.', 1)) - 5)) AS amounts FROM u""",
    "t23_currencies": f"""SELECT p_partkey, [{', '.join(repr(v) for v in [*T.SYMBOLS.values(), *('CNY' if c == 'RMB' else c for c in T.CODES)])}][p_partkey % {len(T.SYMBOLS) + len(T.CODES)} + 1] AS currency FROM part""",
}

"""Identifiers, phone numbers and postal addresses in running text. What stands before and after a match decides what it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import spans as S
from . import text as T

_ID = r"([A-Z0-9][A-Z0-9._/-]{1,29})"
_NO = r"(?:number|no\.?|nr\.?|#)?"
_NO_ID = r"(?:number|no\.?|nr\.?|#|id)?"
_NUM_ID = r"(?:number|no\.?|nr\.?|num\.?|#|id)?"
#: The words that name an identifier's kind, what may follow them, and the form of the identifier.
KINDS = {
    "invoice_number": (r"(?:invoice|inv\.?|rechnung(?:s)?|facture|factura|fattura|faktura)", _NUM_ID, _ID),
    "order_number": (r"(?:order|bestell(?:ung|nummer)?|auftrag(?:s)?|commande|pedido|ordine)", _NUM_ID, _ID),
    "tracking_number": (r"(?:tracking|sendungs(?:nummer)?|shipment|awb|waybill|track(?:ing)? id|colis)", _NO_ID, r"([A-Z0-9][A-Z0-9._-]{5,34})"),
    "customer_number": (r"(?:customer|account|kunden(?:nummer)?|konto|client|cliente)", r"(?:number|no\.?|nr\.?|id|#)", _ID),
    "po_number": (r"(?:p\.?o\.?|purchase order)", _NO, _ID),
    "receipt_number": (r"(?:receipt|beleg|quittung|recibo|ricevuta)", _NO_ID, _ID),
    "reference": (r"(?:reference|referenz|ref\.?|verwendungszweck)", _NO, r"([A-Z0-9][A-Z0-9._/-]{2,29})"),
    "credit_note_number": (r"(?:credit[\s-]*note|credit[\s-]*memo|gutschrift|avoir|nota[\s-]*de[\s-]*cr[ée]dito|nota[\s-]*di[\s-]*credito)", _NUM_ID, _ID),
    "vat_id": (r"(?:VAT|USt-?IdNr\.?|Ust-?ID|TVA|IVA)", _NO_ID, r"([A-Z]{2}[A-Z0-9]{6,14})"),
}
#: Forms of tracking numbers that need no label, by carrier, and the words one of them needs in the text.
CARRIERS = (("ups", r"1Z[0-9A-Z]{16}", 0.9), ("dhl", r"(?:JJD|JVGL|GM)[0-9]{10,20}", 0.9), ("fedex", r"[0-9]{12}(?=[^0-9])", 0.6))
CARRIED = r"(?i)track|shipment|sendung|versand|delivery"
#: Words straight before a label that say that the message only quotes the number, and those that are no identifier.
QUOTES = (
    r"against", r"original", r"ref(?:erence|erences|erring|ers)?\s*(?:to)?\s*[:.]?", r"relat(?:ing|ed)\s+to", r"correction\s+(?:to|for)", r"cancels?", r"bezug(?:nehmend)?(?:\s+auf)?\s*[:.]?", r"bezüglich",
    r"storno(?:\s+(?:zu|für))?", r"korrektur\s+zu", r"storniert", r"zur?",
)
QUOTED = rf"(?iu){S.LEFT}(?:{'|'.join(QUOTES)})\s*$"
STOP_WORDS = "NUMBER NO NR ID FOR FROM TO IS THE AND OF DATE TOTAL AT ON YOUR OUR HAS BEEN WAS WE YOU IST DER DIE DAS VON FUER UND EINE EINEN IHRE IHR WURDE HAT".split()
OWN, ONLY_QUOTED, REACH = 0.9, 0.5, 40

PHONE = r"(?:(?:\+|00)[0-9]{1,3}[\s./-]?)?(?:\([0-9]{2,5}\)[\s./-]?)?[0-9]{2,5}(?:[\s./-][0-9]{2,6}){1,4}" + S.RIGHT
#: Words before a number that say it is a phone's.
PHONE_WORDS = r"(?i)(?:tel|phone|mobile|mobil|fax|cell|call|hotline|telefon)[\s.:]{0,4}$"
_PLACE = r"[A-Za-zÀ-ÿ.' -]"
#: Lines that name a place with its postal code, in the forms of five countries, and lines that name a street.
PLACES = (rf"{_PLACE}+,\s*[A-Z]{{2}}\s+[0-9]{{5}}(?:-[0-9]{{4}})?", rf"[0-9]{{5}}\s+{_PLACE}{{2,}}", r"(?i:[A-Z]{1,2}[0-9]{1,2}[A-Z]?\s+[0-9][A-Z]{2})", rf"[0-9]{{4}}\s+{_PLACE}{{2,}}", rf"{_PLACE}+\s+[0-9]{{4}}\s*[A-Z]{{2}}")
PLACE_LINE = rf"^\s*(?:{'|'.join(PLACES)})\s*$"
STREET_LINE = r"^\s*(?:[0-9]+[A-Za-z]?[\s,]+[A-Za-zÀ-ÿ].{2,60}|[A-Za-zÀ-ÿ].{2,60}?\s+[0-9]+[A-Za-z]?)\s*$"


def _label(kind: str) -> str:
    word, follows, value = KINDS[kind]
    return rf"(?i){S.LEFT}{word}[\s-]*{follows}\s*[:#]?\s*{value}{S.RIGHT}"


def ids(text: Column) -> Column:
    """array<struct<kind, value, start, confidence, referenced, carrier>>: what follows a label, by kind and place, then carriers' forms; each kind and value once.

    A number behind a word such as "against" is only quoted: ``referenced``, with half the confidence."""

    def labelled(kind: str, t: Column) -> Column:
        def one(s: Column) -> Column:
            found = S.group(s, 1)
            value = F.regexp_replace(found, r"[.,;:]+$", "")
            glue = F.regexp_extract(F.substring(s["raw"], F.lit(1), F.length(s["raw"]) - F.length(found)), r"([A-Za-z]{2,10}[-/])$", 1)
            value = F.when((glue != "") & value.rlike("^[0-9]"), F.concat(F.upper(glue), value)).otherwise(value)
            cue = S.before(t, s, REACH).rlike(QUOTED)
            return F.struct(F.lit(kind).alias("kind"), value.alias("value"), s["start"].alias("start"), F.when(cue, ONLY_QUOTED).otherwise(OWN).alias("confidence"), cue.alias("referenced"), F.lit(None).cast("string").alias("carrier"))

        def counts(i: Column) -> Column:
            v = i["value"]
            names = (F.length(v) >= 2) & ~F.upper(v).isin(STOP_WORDS) & ~v.rlike(r"^(?:19|20)[0-9]{2}$") & ~v.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$")
            return names if kind == "vat_id" else names & v.rlike("[0-9]")

        return F.filter(F.transform(S.spans(t, _label(kind), 1), one), counts)

    def carried(name: str, pattern: str, sure: float, t: Column) -> Column:
        some = F.when(t.rlike(CARRIED), t).otherwise("") if name == "fedex" else t
        of = lambda s: F.struct(F.lit("tracking_number").alias("kind"), s["raw"].alias("value"), s["start"].alias("start"), F.lit(sure).alias("confidence"), F.lit(False).alias("referenced"), F.lit(name).alias("carrier"))
        return F.transform(S.spans(some, S.LEFT + pattern + ("" if name == "fedex" else S.RIGHT)), of)

    hint = "(?i)" + "|".join(word for word, _, _ in KINDS.values())
    some = F.when(text.rlike("[0-9]") & text.rlike(hint), text).otherwise("")
    numbers = F.when(text.rlike(r"1Z[0-9A-Z]{16}|(?:JJD|JVGL|GM)[0-9]{10}|[0-9]{12}"), text).otherwise("")
    every = T.let(F.struct(some.alias("some"), numbers.alias("numbers")), lambda x: F.concat(*(labelled(k, x["some"]) for k in KINDS), *(carried(*c, x["numbers"]) for c in CARRIERS)))
    return T.first_of_each(every, lambda i: F.struct(i["kind"], i["value"]))


def phones(text: Column) -> Column:
    """Numbers of seven to fifteen digits that look like a phone's, or follow a word that says so; never dates, amounts or parts of longer numbers."""

    def counts(t: Column, s: Column) -> Column:
        raw, ahead, behind = F.trim(s["raw"]), S.before(t, s, 24), F.substring(t, s["start"] + F.length(F.trim(s["raw"])) + 1, F.lit(12))
        other = (
            F.trim(F.regexp_replace(ahead, r"\s", " ")).rlike(r"[0-9)]$") | behind.rlike(r"^\s*[0-9]") | ahead.rlike(r"[$€£¥]\s*$") | behind.rlike(r"^\s*(?:USD|EUR|GBP|%)")
            | raw.rlike(S.LEFT + r"(?:19|20)[0-9][0-9][-/.][0-9]") | raw.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$") | raw.rlike(r"^[0-9]+[.,][0-9]{1,2}$")
        )
        return F.length(F.regexp_replace(raw, "[^0-9]", "")).between(7, 15) & ~other & (raw.rlike(r"^\+|^00[0-9]|\(|(?:[0-9][\s./-]){2,}") | ahead.rlike(PHONE_WORDS))

    some = F.when(text.rlike(r"[0-9]{2}[\s./-][0-9]{2}"), text).otherwise("")
    found = T.let(some, lambda t: F.transform(F.filter(S.spans(t, PHONE), lambda s: counts(t, s)), lambda s: F.regexp_replace(F.trim(s["raw"]), r"\s+", " ")))
    return F.array_distinct(found)


def addresses(text: Column) -> Column:
    """A street's line straight above a place's, with the line before them if it is short and doesn't introduce something."""

    def of(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            place, above = F.get(lines, i + 1), F.trim(F.get(lines, i - 1))
            fits = line.rlike(STREET_LINE) & F.length(F.trim(line)).between(6, 80) & place.rlike(PLACE_LINE) & ~F.concat(line, place).rlike("@|https?:")
            named = F.when((above != "") & (F.length(above) < 60) & ~above.rlike("[:;]$"), above)
            return F.when(fits, F.concat_ws("\n", named, F.trim(line), F.trim(place)))

        return F.array_distinct(F.filter(F.transform(lines, one), lambda a: a.isNotNull()))

    return T.let(F.split(F.coalesce(text, F.lit("")), "\n"), of)


# Queries

def _lettered(spark: SparkSession, d: str) -> DataFrame:
    """Customers as mails would name their numbers, phones and addresses."""
    key, word = F.col("c_custkey").cast("string"), F.initcap("c_mktsegment")
    forms = (
        F.concat(F.lit("Credit note CN-"), key, F.lit(" against invoice INV-"), key), F.concat(F.lit("Gutschrift Nr. 49"), key, F.lit("\nBezug: Rechnung 91"), key), F.concat(F.lit("Invoice INV-"), key, F.lit(", Total: 120.00 EUR")),
        F.concat(F.lit("Invoice illustration follows. Order number: SO-"), key, F.lit(". Invoice 2024, invoice 12/10/2024")), F.concat(F.lit("PO #P/"), key, F.lit(" with purchase order P/"), key),
        F.concat(F.lit("Ref. X-"), key, F.lit(" VAT no. DE"), F.lpad(key, 9, "0")), F.concat(F.lit("the customer 77"), key, F.lit(" has customer no. C-"), key), F.concat(F.lit("delivery by 1Z"), F.lpad(key, 16, "0"), F.lit(" or "), F.lpad(key, 12, "4"), F.lit(".")),
        F.concat(F.lit("beside "), F.lpad(key, 12, "4"), F.lit(" nothing")), F.concat(F.lit("Quittung 12-"), key, F.lit("; receipt 12-"), key),
    )
    k = (F.col("c_custkey") % len(forms)).cast("int")
    phones_ = F.get(F.array(F.lit("Tel: +1 555 123 4567"), F.lit("Total $1,234.56 on 08/09/2026"), F.concat(F.lit("call 030/"), F.lpad(key, 6, "5")), F.concat(F.lit("number "), F.lpad(key, 7, "5")), F.lit("(030) 123 4567 or 1999-12-31 10")), (F.col("c_custkey") % 5).cast("int"))
    streets = F.array(F.concat(F.lit("Main Street "), key), F.concat(key, F.lit(" Elm Street")), F.lit("just words"), F.concat(F.lit("Hauptstr. "), key))
    places = F.array(F.concat(F.lit("80331 "), word), F.concat(word, F.lit(", IL 62704")), F.lit("1010 Wien"), F.lit("SW1A 1AA"), F.concat(word, F.lit(" 1012 AB")), F.lit("no place"))
    lines = F.concat_ws("\n", F.lit("Ship to:"), F.when(F.col("c_custkey") % 2 == 0, word), F.get(streets, (F.col("c_custkey") % 4).cast("int")), F.get(places, (F.col("c_custkey") % 6).cast("int")), F.lit("Thanks"))
    return table(spark, d, "customer").select("c_custkey", F.get(F.array(*forms), k).alias("said"), phones_.alias("called"), lines.alias("lines"))


def t17_id_forms(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform(ids(F.col("said")), lambda i: F.concat_ws(" ", i["kind"], i["value"], F.format_number(i["confidence"], 1)))
    return _lettered(spark, d).select("c_custkey", F.array_join(shown, ";").alias("ids"))


def t16_phone_forms(spark: SparkSession, d: str) -> DataFrame:
    return _lettered(spark, d).select("c_custkey", F.array_join(phones(F.col("called")), ";").alias("phones"))


def t16_phones(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(phones(F.col("text")), ";").alias("phones"))


def t18_w03_addresses(spark: SparkSession, d: str) -> DataFrame:
    return _lettered(spark, d).select("c_custkey", F.array_join(addresses(F.col("lines")), ";").alias("addresses"))


QUERIES = {f.__name__: f for f in (t17_id_forms, t16_phone_forms, t16_phones, t18_w03_addresses)}
_word = "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"
_k = "c_custkey"
ORACLE_SQL = {
    "t17_id_forms": f"""SELECT c_custkey, CASE {_k} % 10 WHEN 0 THEN 'invoice_number INV-' || {_k} || ' 0.5;credit_note_number CN-' || {_k} || ' 0.9' WHEN 1 THEN 'invoice_number 91' || {_k} || ' 0.5;credit_note_number 49' || {_k} || ' 0.9'
        WHEN 2 THEN 'invoice_number INV-' || {_k} || ' 0.9' WHEN 3 THEN 'order_number SO-' || {_k} || ' 0.9' WHEN 4 THEN 'order_number P/' || {_k} || ' 0.9;po_number P/' || {_k} || ' 0.9'
        WHEN 5 THEN 'reference X-' || {_k} || ' 0.9;vat_id DE' || lpad(CAST({_k} AS VARCHAR), 9, '0') || ' 0.9' WHEN 6 THEN 'customer_number C-' || {_k} || ' 0.9'
        WHEN 7 THEN 'tracking_number 1Z' || lpad(CAST({_k} AS VARCHAR), 16, '0') || ' 0.9;tracking_number ' || lpad(CAST({_k} AS VARCHAR), 12, '4') || ' 0.6' WHEN 8 THEN '' ELSE 'receipt_number 12-' || {_k} || ' 0.9' END AS ids FROM customer""",
    "t16_phone_forms": f"""SELECT c_custkey, CASE {_k} % 5 WHEN 0 THEN '+1 555 123 4567' WHEN 1 THEN '' WHEN 2 THEN '030/' || lpad(CAST({_k} AS VARCHAR), 6, '5') WHEN 3 THEN '' ELSE '(030) 123 4567' END AS phones FROM customer""",
    "t16_phones": r"""WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '(?:(?:\+|00)[0-9]{1,3}[\s./-]?)?(?:\([0-9]{2,5}\)[\s./-]?)?[0-9]{2,5}(?:[\s./-][0-9]{2,6}){1,4}\b') AS l,
            string_split_regex(text, '(?:(?:\+|00)[0-9]{1,3}[\s./-]?)?(?:\([0-9]{2,5}\)[\s./-]?)?[0-9]{2,5}(?:[\s./-][0-9]{2,6}){1,4}\b') AS gaps FROM documents),
        m AS (SELECT doc_id, i, l[i] AS raw, right(coalesce(array_to_string(list_transform(range(1, i), lambda j: gaps[j] || l[j]), ''), '') || gaps[i], 24) AS ahead, left(gaps[i + 1] || coalesce(l[i + 1], ''), 12) AS behind, regexp_replace(l[i], '[^0-9]', '', 'g') AS digits
            FROM (SELECT doc_id, l, gaps, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS i FROM p)),
        k AS (SELECT doc_id, min(i) AS i, regexp_replace(raw, '\s+', ' ', 'g') AS phone FROM m WHERE length(digits) BETWEEN 7 AND 15 AND NOT regexp_matches(regexp_replace(ahead, '\s+$', ''), '[0-9)]$') AND NOT regexp_matches(behind, '^\s*[0-9]')
            AND NOT regexp_matches(ahead, '[$€£¥]\s*$') AND NOT regexp_matches(behind, '^\s*(?:USD|EUR|GBP|%)') AND NOT regexp_matches(raw, '\b(?:19|20)[0-9][0-9][-/.][0-9]') AND NOT regexp_matches(raw, '^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$')
            AND NOT regexp_matches(raw, '^[0-9]+[.,][0-9]{1,2}$') AND (regexp_matches(raw, '^\+|^00[0-9]|\(|(?:[0-9][\s./-]){2,}') OR regexp_matches(ahead, '(?i)(?:tel|phone|mobile|mobil|fax|cell|call|hotline|telefon)[\s.:]{0,4}$')) GROUP BY doc_id, phone)
        SELECT d.doc_id, coalesce(string_agg(phone, ';' ORDER BY i), '') AS phones FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id""",
    "t18_w03_addresses": f"""WITH a AS (SELECT c_custkey, {_word} AS w, ['Main Street ' || {_k}, {_k} || ' Elm Street', NULL, 'Hauptstr. ' || {_k}][{_k} % 4 + 1] AS street,
            ['80331 ' || {_word}, {_word} || ', IL 62704', '1010 Wien', 'SW1A 1AA', {_word} || ' 1012 AB', NULL][{_k} % 6 + 1] AS place FROM customer)
        SELECT c_custkey, CASE WHEN street IS NULL OR place IS NULL THEN '' ELSE concat_ws(chr(10), CASE WHEN {_k} % 2 = 0 THEN w END, street, place) END AS addresses FROM a""",
}

"""Text functions as column expressions: detection, normalising, number and date reading, evidence.

All of them stay inside Spark's expressions, so they need no Python on executors. Queries apply
them to whole tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

EMAIL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"\b(?i:https?)://[^\s<>\"'\])}]+[^\s<>\"'\])}.,;:!?]"
BARE_URL = r"\b(?i:www)\.[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:/[^\s<>\"']*)?"
BEFORE_URL = r"(?:^|[\s(\[{<\"'])"  # else a bare address is the rest of another
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"

#: Function words by language, the first language wins ties.
MARKERS = {
    "en": "the and you your for with this that have from please will been invoice thanks",
    "de": "der die das und ist nicht sie ihre für mit wir bitte auf eine rechnung werden",
    "fr": "le la les et est vous pour avec nous votre dans une que facture merci",
    "es": "el la los que de para con una por su gracias factura usted como",
    "it": "il la che per con una del sono grazie fattura della nel",
    "nl": "de het een van is voor met wij uw niet dank factuur",
    "pt": "de que para com uma não obrigado fatura você seu",
}
LEAST_CHARS, LEAST_WORDS, LEAST_SCORE = 24, 8, 0.012

#: Patterns that speak for a type of document, on lower-case text, with their weight; each counts three times at most.
TYPE_PATTERNS = {
    "invoice": {
        r"\binvoice\b": 3, r"\brechnung\b": 3, r"\bfacture\b": 3, r"\bfactura\b": 3, r"\bamount due\b": 3, r"\bdue date\b": 2, r"\bf(?:ä|ae)llig(?:keit)?\b": 2, r"\bpayment (?:is )?due\b": 3,
        r"\bbill(?:ing)? (?:statement|period)\b": 2, r"\bnet\s*\d{1,3}\b": 1, r"\bpay (?:this )?invoice\b": 3, r"\bzahlbar\b": 2, r"\bust-?idnr\b": 1, r"\bvat\b": 1, r"\bsteuernummer\b": 1, "請求書": 4,
    },
    "receipt": {
        r"\breceipt\b": 3, r"\bbeleg\b": 2, r"\bquittung\b": 3, r"\bpayment (?:received|successful|confirmation)\b": 3, r"\bthanks? for your payment\b": 3, r"\byou (?:have been |were )?charged\b": 3, r"\bpaid\b": 1, r"\bzahlungseingang\b": 3,
        r"\bcard ending\b": 2, r"\btransaction id\b": 2, r"\brefund(?:ed)?\b": 1, r"\bbeleg-?nr\b": 4, r"\bzahlungs(?:mittel|art|methode)\b": 2, r"\btrinkgeld\b": 2, "領収書": 4, "お支払い": 2,
    },
    "order": {
        r"\border confirmation\b": 4, r"\bbestellbest(?:ä|ae)tigung\b": 4, r"\bthank you for your order\b": 4, r"\byour order\b": 2, r"\border\s*#": 2, r"\bbestellnummer\b": 3, r"\bwe(?:'| ha)ve received your order\b": 3,
        r"\bauftragsbest(?:ä|ae)tigung\b": 3, r"\bconfirmaci(?:ó|o)n de pedido\b": 3, "注文番号": 4, "ご注文": 3,
    },
    "shipping": {
        r"\bshipped\b": 3, r"\bhas shipped\b": 4, r"\btracking (?:number|code|id)\b": 4, r"\bout for delivery\b": 4, r"\bversand(?:best(?:ä|ae)tigung)?\b": 3, r"\bsendungsnummer\b": 4, r"\bdelivery (?:date|estimate|address)\b": 2,
        r"\bin transit\b": 3, r"\bpaket\b": 2, r"\bzustellung\b": 3, r"\bcarrier\b": 2, "発送": 3,
    },
    "form": {r"\bform submission\b": 4, r"\bnew submission\b": 4, r"\bcontact form\b": 4, r"\bkontaktformular\b": 4, r"\bnew (?:lead|enquiry|inquiry)\b": 3, r"\bsubmitted (?:the |a )?form\b": 3, r"\banfrage (?:ü|ue)ber\b": 3},
    "calendar": {r"\binvitation\b": 3, r"\bcalendar\b": 2, r"\bmeeting (?:invite|request)\b": 4, r"\bwhen:\s": 2, r"\bwhere:\s": 2, r"\btermin(?:einladung)?\b": 3, r"\brsvp\b": 2, r"\bbesprechung\b": 2},
}
#: What identifiers, and a table with amounts, add to a type, and what missing amounts take.
TYPE_OF_ID = {"shipping": ("tracking_number", 4), "invoice": ("invoice_number", 4), "order": ("order_number", 3), "receipt": ("receipt_number", 3)}
TABLE_BONUS, NO_AMOUNT = {"invoice": 1, "order": 1}, {"invoice": -2, "receipt": -2, "order": -1}
#: Promotions, in which "receipt" is a legal word, and phrases of a real payment.
PROMOTION = r"\b(?:sweepstakes?|contest rules?|prize (?:notification|winner|claim))\b"
PAYMENT = r"\b(?:payment (?:received|successful|confirmation)|thanks? for your payment|you (?:have been |were )?charged|card ending|transaction id|receipt\s*(?:#|number|no\.?|id))\b"
#: Currency symbols and what they stand for, and codes.
SYMBOLS = {
    "$": "USD", "US$": "USD", "C$": "CAD", "CA$": "CAD", "A$": "AUD", "AU$": "AUD", "NZ$": "NZD", "HK$": "HKD", "S$": "SGD", "R$": "BRL", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₽": "RUB",
    "₩": "KRW", "₪": "ILS", "₺": "TRY", "₴": "UAH", "฿": "THB", "₱": "PHP", "₫": "VND", "zł": "PLN", "Kč": "CZK", "kr": "SEK", "R": "ZAR", "Fr": "CHF", "CHF": "CHF",
}
CODES = "USD EUR GBP JPY CHF CAD AUD NZD SEK NOK DKK PLN CZK HUF RON BGN TRY RUB UAH INR CNY RMB HKD SGD KRW THB MYR IDR PHP VND BRL MXN ARS CLP COP ZAR AED SAR ILS EGP NGN KES ISK HRK RSD".split()
NO_LEXEME = ("R", "CHF")  # a letter alone isn't looked for in texts, and this symbol is a code
#: Named character references.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "shy": "", "zwnj": "", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "mdash": "—", "ndash": "–",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "deg": "°", "plusmn": "±", "times": "×", "divide": "÷",
    "laquo": "«", "raquo": "»", "sect": "§", "para": "¶", "dagger": "†", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à",
    "ccedil": "ç", "ntilde": "ñ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú", "ecirc": "ê", "ocirc": "ô", "acirc": "â", "ucirc": "û", "aring": "å", "oslash": "ø", "aelig": "æ", "check": "✓", "star": "★",
}
REFERENCE = r"&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,31});?"
#: Words that mean true and false.
TRUE_WORDS = ("true", "yes", "y", "ja", "oui", "si", "1", "on", "paid", "confirmed", "x")
FALSE_WORDS = ("false", "no", "n", "nein", "non", "0", "off", "unpaid", "none")
#: Phrases of subject or body that raise or lower a spam score, top-level domains that do, and hosts that shorten addresses.
SPAM_PHRASES = (
    ("pharma", r"\bviagra\b|\bcialis\b", 1.5),
    ("crypto", r"\bcrypto|bitcoin|usdt|binance\b", 0.4),
    ("lottery", r"\b(you (have )?won|winner|lottery|prize claim)\b", 1.2),
    ("wire", r"\b(wire transfer|western union|bank transfer urgent)\b", 1.0),
    ("advance-fee", r"\b(nigerian?|inheritance|next of kin|beneficiary fund)\b", 1.0),
    ("phish", r"\b(verify your account|confirm your password|account (will be )?suspended)\b", 1.2),
    ("urgency", r"\b(click here (now|immediately)|act now|limited time offer|risk[- ]free)\b", 0.6),
    ("marketing", r"\b(no obligation|money[- ]back guarantee|100% (free|satisfied))\b", 0.5),
    ("has-unsubscribe", r"\b(unsubscribe|opt[- ]out)\b", -0.3),
)
SPAM_TLDS = ("zip", "mov", "top", "xyz", "click", "link", "work", "gq", "cf", "tk", "ml", "buzz", "rest", "cam", "quest", "monster", "sbs", "cfd", "bond")
SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rb.gy")
SPAM_URL = r"https?://[^\s\"'<>)]+"
SPAM_HOST = r"^https?://(?:[^/?#@]*@)?([^/?#:]*)"
BARE_IP = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"
HIDDEN_STYLE = r"style=[\"'][^\"']*(display\s*:\s*none|visibility\s*:\s*hidden)"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def replaced(text: Column, pairs: tuple) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, each once, from left to right; unknown ones, and numbers of no character, stay as they are."""
    named = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    clear = F.when(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")), F.translate(text, "\x01\x02", "  ")).otherwise(text)
    marked = F.regexp_replace(clear, REFERENCE, "\x01$0\x02$1\x01")

    def decoded(piece: Column) -> Column:
        raw, body = F.substring_index(piece, "\x02", 1), F.substring_index(piece, "\x02", -1)
        hexed = body.rlike("^#[xX]")
        digits = F.regexp_replace(body, "^#[xX]?", "")
        point = F.when(F.length(digits) <= 9, F.when(hexed, F.conv(digits, 16, 10)).when(digits.rlike("^[0-9]+$"), digits).cast("long"))
        real = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        return F.when(body.startswith("#"), F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))).otherwise(F.coalesce(named[body], named[F.lower(body)])), raw

    def whole(pieces: Column) -> Column:
        one = lambda p: F.coalesce(*decoded(p))
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, p).otherwise(one(p))), "")

    return F.when(F.contains(text, F.lit("&")), let(F.split(marked, "\x01", -1), whole)).otherwise(text)


def escape_html(text: Column) -> Column:
    return replaced(text, (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def language(text: Column) -> Column:
    """The language whose function words are the largest share of the words; null for short or unclear texts."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\s]", " ")
    count = lambda words, lang: F.size(F.filter(words, lambda w: w.isin(MARKERS[lang].split())))

    def best(words: Column) -> Column:
        top = F.array_max(F.array(*(F.struct(count(words, lang).alias("n"), F.lit(-k).alias("order"), F.lit(lang).alias("lang")) for k, lang in enumerate(MARKERS))))
        return let(top, lambda t: F.when((F.size(words) >= LEAST_WORDS) & (t["n"] > 0) & (t["n"] / F.size(words) >= LEAST_SCORE), t["lang"]))

    return let(plain, lambda p: F.when(F.length(F.trim(p)) >= LEAST_CHARS, let(split_words(p), best)))


def domain_lowered(address: Column) -> Column:
    local = F.regexp_extract(address, r"(?s)^(.*)@[^@]*$", 1)
    return F.when(F.contains(address, F.lit("@")), F.concat(local, F.lit("@"), F.lower(F.substring_index(address, "@", -1)))).otherwise(address)


def emails(text: Column) -> Column:
    some = F.when(F.contains(text, F.lit("@")), text).otherwise(F.lit(""))  # most texts have none, and the pattern is slow
    found = F.transform(F.regexp_extract_all(some, F.lit(EMAIL), F.lit(0)), lambda e: domain_lowered(F.regexp_replace(e, r"^[.]+|[.]+$", "")))
    return F.array_distinct(F.filter(found, lambda e: e.rlike(r"\.[A-Za-z]{2,}$") & (F.length(e) < 254)))


def urls(text: Column) -> Column:
    bare = F.transform(F.regexp_extract_all(text, F.lit(BEFORE_URL + "(" + BARE_URL + ")"), F.lit(1)), lambda u: F.concat(F.lit("http://"), u))
    return F.array_distinct(F.transform(F.concat(F.regexp_extract_all(text, F.lit(URL), F.lit(0)), bare), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def links(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*href=["']((?:https?:|mailto:|tel:|/)[^"']*)["']"""), F.lit(1))
    return F.array_distinct(found)


def _sure_part(pattern: str) -> str:
    """The longest text that every match of a type's pattern holds; looked for first, as patterns are slow."""
    return max(re.split(r"\(\?:[^)]*\)\??|\\[bs]\*?|\\d\{[^}]*\}|.\?", pattern), key=len)


def document_type(text: Column, subject: Column | None = None, ids: Column | None = None, amounts: Column | None = None, tables: Column | None = None, attachments: Column | None = None) -> Column:
    """The type whose patterns weigh most, at least 3; the first-listed of ties.

    ``text`` holds the subject as well; ``subject`` counts each pattern in it once more. What was found is used
    where it is given: ``ids`` (kind), ``amounts``, the number of ``tables``, ``attachments`` (content_type, filename)."""

    def extra(kind: str) -> Column:
        points = F.lit(0)
        if ids is not None and kind in TYPE_OF_ID:
            points += F.when(F.exists(ids, lambda i: i["kind"] == TYPE_OF_ID[kind][0]), TYPE_OF_ID[kind][1]).otherwise(0)
        if amounts is not None and kind in NO_AMOUNT:
            points += F.when(F.size(amounts) < 1, NO_AMOUNT[kind]).otherwise(0)
            if tables is not None and kind in TABLE_BONUS:
                points += F.when((tables > 0) & (F.size(amounts) >= 2), TABLE_BONUS[kind]).otherwise(0)
        if attachments is not None and kind == "calendar":
            points += F.when(F.exists(attachments, lambda a: F.coalesce(a["content_type"], F.lit("")) == "text/calendar"), 8).otherwise(0)
        if attachments is not None and kind == "invoice":
            points += F.when(F.exists(attachments, lambda a: F.lower(F.coalesce(a["filename"], F.lit(""))).rlike("invoice|rechnung|facture")), 4).otherwise(0)
        return points

    def best(both: Column) -> Column:
        low, head = both["text"], both["subject"]

        def count(p: str) -> Column:
            n = F.least(F.regexp_count(low, F.lit(p)), F.lit(3))
            return F.when(F.contains(low, F.lit(_sure_part(p))), n if subject is None else n + F.when(head.rlike(p), 1).otherwise(0)).otherwise(0)

        score = lambda kind: reduce(lambda a, b: a + b, (count(p) * w for p, w in TYPE_PATTERNS[kind].items())) + extra(kind)
        scores = {k: score(k) for k in TYPE_PATTERNS}
        scores["receipt"] = F.when(low.rlike(PROMOTION) & ~low.rlike(PAYMENT), 0).otherwise(scores["receipt"])
        top = F.array_max(F.array(*(F.struct(n.alias("n"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, (t, n) in enumerate(scores.items()))))
        return let(top, lambda t: F.when(t["n"] >= 3, t["type"]).otherwise("generic"))

    known = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("text"), F.lower(F.coalesce(F.lit("") if subject is None else subject, F.lit(""))).alias("subject"))
    return F.coalesce(let(known, best), F.lit("generic"))


def first_of_each(found: Column, key: Callable[[Column], Column]) -> Column:
    """Of elements with equal keys the first, in their order. Sorts twice, so n log n."""
    keyed = F.array_sort(F.transform(found, lambda x, i: F.struct(key(x).alias("key"), i.alias("no"), x.alias("it"))))
    firsts = let(keyed, lambda k: F.filter(k, lambda x, i: ~x["key"].eqNullSafe(F.get(k, i - 1)["key"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda x: F.struct(x["no"], x["it"]))), lambda x: x["it"])


def parse_number(raw: Column) -> Column:
    """A number of any locale: the last separator is the decimal one, unless it only groups thousands."""
    s = F.regexp_replace(F.trim(raw), "[    ]", " ")
    negative = s.rlike(r"^\(.*\)$|^-|-$")
    core = F.regexp_replace(F.regexp_replace(s, r"^[^0-9]+|[^0-9]+$", ""), r"['’ ]([0-9]{3})\b", "$1")
    comma, dot = F.length(core) - F.length(F.substring_index(core, ",", 1)), F.length(core) - F.length(F.substring_index(core, ".", 1))
    after = lambda sep: F.length(F.substring_index(core, sep, -1))
    many = lambda sep: F.length(core) - F.length(F.replace(core, F.lit(sep), F.lit(""))) > 1
    decimal = (
        F.when((comma > 0) & (dot > 0), F.when(after(",") < after("."), ",").otherwise("."))
        .when(comma > 0, F.when(many(",") | (after(",") == 3), "").otherwise(","))
        .when(dot > 0, F.when(many(".") | core.rlike(r"^[0-9]{1,3}\.[0-9]{3}$"), "").otherwise("."))
        .otherwise("")
    )
    digits = F.when(decimal == ",", F.replace(F.replace(core, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(decimal == ".", F.replace(core, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(core, "[.,]", ""))
    value = digits.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def currency(token: Column) -> Column:
    """The code of a symbol or code, whatever its case; null for others."""
    of = {c: "CNY" if c == "RMB" else c for c in CODES}
    codes, symbols = (F.create_map(*(F.lit(x) for pair in t.items() for x in pair)) for t in (of, SYMBOLS))
    bare = F.regexp_replace(F.trim(token), r"\.$", "")
    return F.coalesce(codes[F.upper(bare)], symbols[bare], symbols[F.upper(bare)])


def number_forms(n: Column) -> Column:
    grouped = F.format_number(n, 2)
    return F.array_distinct(F.array(grouped, F.replace(grouped, F.lit(","), F.lit("")), F.translate(grouped, ",.", ".,"), F.format_number(F.floor(n), 0)))


def norm(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, "[\\s ]+", " ")))


def supported(evidence: Column, surface: Column) -> Column:
    """Evidence counts if it has four characters and stands in the surface, blanks and case aside."""
    return (F.length(F.trim(evidence)) >= 4) & F.contains(norm(surface), norm(evidence))


def around(text: Column, needle: Column, reach: int = 20) -> Column:
    at = F.locate(needle, text) if isinstance(needle, str) else F.instr(text, needle)
    return F.when(at > 0, F.substring(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)) + F.length(needle) + reach))


def slug(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 32)


def id_hash(message_id: Column) -> Column:
    return F.substring(F.sha2(F.lower(F.trim(message_id)), 256), 1, 24)


#: Ceilings of confidence by how a value was found.
CEILINGS = {"header": 0.95, "rule": 0.88, "both": 0.97, "cited_and_seen": 0.93, "cited": 0.85, "seen": 0.8, "bare": 0.55, "invented": 0.25, "disagreement": 0.5, "unanchored": 0.85, "nonsense": 0.55, "sums": 0.98}


def confidence(source: Column, given: Column, ok: Column, seen: Column, disagree: Column, sums: Column, anchored: Column, sound: Column | None = None, stated: Column | None = None, own: Column | None = None) -> Column:
    """A value's confidence: the ceiling of its source, then what evidence, agreement and arithmetic allow.

    ``own``: how sure the rule or header that found it is. ``sound``: false where a set of rows is nonsense. ``stated``: what the second extractor says of itself, which can only lower the result."""
    c = {k: F.lit(v) for k, v in CEILINGS.items()}
    second = F.when(given & ~ok, c["invented"]).when(ok & seen, c["cited_and_seen"]).when(ok, c["cited"]).when(seen, c["seen"]).otherwise(c["bare"])
    found = lambda most: most if own is None else F.least(most, own)  # noqa: E731  a null is passed over
    top = F.when(source == "header", found(c["header"])).when(source == "rule", found(c["rule"])).when(source == "both", c["both"]).otherwise(second)
    top = F.when((source != "second") & given & ~ok, F.least(top * 0.5, c["invented"])).otherwise(top)
    top = F.when(disagree, F.least(top, c["disagreement"])).otherwise(top)
    top = F.when(sums.isNull(), top).when(sums, F.least(c["sums"], top + 0.03)).otherwise(top * 0.8)
    if sound is not None:
        top = F.when(~sound, F.least(top * 0.6, c["nonsense"])).otherwise(top)
    top = F.when(~anchored & (source != "header"), F.least(top, c["unanchored"])).otherwise(top)
    if stated is not None:
        top = F.least(top, F.greatest(F.lit(0.0), F.least(F.lit(1.0), stated)))  # a null is passed over
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), top)), 3)


def redacted(entries: Column) -> Column:
    """A map with secret keys masked and long values cut."""
    return F.transform_values(entries, lambda k, v: F.when(F.lower(k).rlike("secret|token|password|api_?key|authorization"), "[redacted]").when(F.length(v) > 200, F.concat(F.substring(v, 1, 200), F.lit("…"))).otherwise(v))


# Queries

def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def t03_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(decode_entities(F.col("html"))).alias("decoded"))


def p16_escape(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(escape_html(F.col("text"))).alias("escaped"))


def t08_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(links(F.col("html")), " ").alias("links"))


def t13_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", language(F.col("text")).alias("language"))


def t14_emails(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(emails(F.col("text")), " ").alias("emails"))


def t15_urls(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_join(urls(F.concat_ws(" see ", "text", F.lit("www.example.org/a. (see https://a.example/x) HTTP://B.example/y, [www.c.example]"))), " ").alias("urls"))


def t19_l07_type(spark: SparkSession, d: str) -> DataFrame:
    """Texts under a subject that speaks for a type, or for none."""
    subjects = ("Invoice, amount due", "Your parcel has shipped: tracking code", "Meeting request, RSVP", "Prize notification: receipt of documents, receipt", "Payment received: prize claim, receipt 7", "Anfrage über das Kontaktformular")
    subject = F.get(F.array(*map(F.lit, subjects)), (F.col("doc_id") % 7).cast("int"))
    return _docs(spark, d).select("doc_id", document_type(F.concat_ws("\n", subject, "text"), subject).alias("type"))


def _number_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_totalprice")
    us = F.format_number(n, 2)
    raw = F.get(F.array(us, F.translate(us, ",.", ".,"), F.concat(F.lit("("), us, F.lit(")")), F.concat(F.lit("EUR "), F.translate(us, ",.", " ,")), F.format_number(F.floor(n), 0), F.lit("none"), F.concat(us, F.lit("-"))), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw"))


def t21_parse_number(spark: SparkSession, d: str) -> DataFrame:
    return _number_texts(spark, d).select("o_orderkey", parse_number(F.col("raw")).alias("value"))


def t29_t63_number_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(number_forms(F.col("p_retailprice")), " | ").alias("forms"))


def t23_currency(spark: SparkSession, d: str) -> DataFrame:
    token = F.get(F.array(*map(F.lit, ("$", "eur", "€", "RMB", "Fr.", "usd."))), (F.col("c_custkey") % 6).cast("int"))
    return table(spark, d, "customer").select("c_custkey", currency(token).alias("currency"))


def t30_t62_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Does a cited passage stand in the document that it is cited from?"""
    cited = F.concat_ws(" ", F.slice(F.split("text", " "), 3, F.col("doc_id") % 4 + 1))
    cited = F.when(F.col("doc_id") % 5 == 0, F.concat(cited, F.lit(" never said"))).otherwise(cited)
    return _docs(spark, d).select("doc_id", supported(cited, F.col("text")).alias("ok"))


def t32_t44_evidence_window(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.contains("text", F.lit("token = "))).select("doc_id", around(F.col("text"), F.lit("token = ")).alias("window"))


def t33_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", norm(F.col("text")).alias("norm"))


def t34_t35_corroborates(spark: SparkSession, d: str) -> DataFrame:
    """Stated totals that some line item repeats to the cent."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice")).alias("amounts"))
    value = F.element_at("amounts", 1) + F.when(F.col("o_orderkey") % 2 == 0, 0.004).otherwise(0.02)
    both = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_orderkey", F.exists("amounts", lambda a: F.abs(a - value) < 0.005).alias("seen"))


def t36_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    source = F.get(F.array(*map(F.lit, ("header", "rule", "both", "second"))), (e % 4).cast("int"))
    sums = F.when(e % 3 == 0, F.lit(True)).when(e % 3 == 1, F.lit(False))
    score = confidence(source, e % 2 == 0, e % 5 < 3, e % 7 < 3, e % 11 == 0, sums, e % 13 != 0, e % 17 != 0, F.when(e % 19 < 5, (e % 100) / 100))
    return table(spark, d, "events").select("event_id", score.alias("confidence"))


def t47_quantity_tail(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(" ", "p_name", F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" x"))))
    return table(spark, d, "part").select("p_partkey", F.regexp_extract(line, r"([0-9]+) ?x$", 1).try_cast("int").alias("qty"), F.trim(F.regexp_replace(line, r"[0-9]+ ?x$", "")).alias("description"))


def t52_domain_lowered(spark: SparkSession, d: str) -> DataFrame:
    address = F.concat("c_name", F.lit("@Mail."), "c_mktsegment", F.lit(".COM"))
    return table(spark, d, "customer").select("c_custkey", domain_lowered(address).alias("address"))


def t54_path_host(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_replace(F.lower(F.regexp_extract("url", HOST, 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    return table(spark, d, "pages").select("page_id", host.alias("host"), path.alias("path"))


def t55_recipient_token(spark: SparkSession, d: str) -> DataFrame:
    local = F.concat(F.lower("c_mktsegment"), F.lit("-tok"), "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("+tagged")).otherwise(F.lit("")))
    rows = table(spark, d, "customer").select("c_custkey", local.alias("local"))
    base = F.substring_index("local", "+", 1)
    return rows.select("c_custkey", F.substring_index(base, "-", -1).alias("token"), F.substring_index(base, "-", 1).alias("slug"), F.when(F.contains("local", F.lit("+")), F.substring_index("local", "+", -1)).alias("tag"))


def t56_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


def t58_id_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", id_hash(F.concat(F.lit(" <"), "c_name", F.lit("@X> "))).alias("hash"))


def t60_numeric_cells(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pipe tables: how many cells are numbers, and whether the line is a total."""
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(F.contains("line", F.lit("|")))
    return lines.select("doc_id", "no", F.size(cells).cast("long").alias("cells"), F.size(F.filter(cells, lambda c: c.rlike(r"^[-+]?[0-9][0-9.,]*$"))).cast("long").alias("numeric"), F.exists(cells, lambda c: F.lower(c).rlike(r"^(sub)?(total|summe|gesamt)")).alias("totals"))


def t61_to_amount(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit("was "), "raw", F.lit(" in all"))
    return _number_texts(spark, d).select("o_orderkey", parse_number(F.regexp_extract(said, r"([0-9][0-9.,]*[0-9])", 1)).alias("amount"))


def s23_s25_delimiter(spark: SparkSession, d: str) -> DataFrame:
    """The delimiter that splits the lines of a text most evenly: ten times the lines like the median, and the median."""
    def judged(lines: Column, sep: str) -> Column:
        counts = F.array_sort(F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit("")))))
        score = lambda c, median: F.when(median > 0, F.size(F.filter(c, lambda n: n == median)) * 10 + median).otherwise(0)
        return let(counts, lambda c: let(F.get(c, F.floor(F.size(c) / 2).cast("int")), lambda m: score(c, m)))

    def best(lines: Column) -> Column:
        top = F.array_max(F.array(*(F.struct(judged(lines, s).alias("n"), F.lit(-k).alias("order"), F.lit(s).alias("sep")) for k, s in enumerate((",", ";", "|")))))
        return let(top, lambda t: F.when(t["n"] > 0, t["sep"]))

    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return _docs(spark, d).select("doc_id", let(lines, best).alias("delimiter"))


def s38_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(decode_entities(bare), r"[ \t\n\r]+", " "))).alias("digest"))


def p02_preview(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.substring("text", 1, 40).alias("preview"), F.length("text").cast("long").alias("text_length"), (F.length("text") > 40).alias("text_truncated"))


def p03_summary(spark: SparkSession, d: str) -> DataFrame:
    """Recipients that are one string or a list become a list."""
    to = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.array("c_name", "c_mktsegment"))).otherwise(F.to_json(F.struct(F.col("c_name").alias("one"))))
    many = F.coalesce(F.when(to.startswith("["), F.from_json(to, "array<string>")), F.array(F.get_json_object(to, "$.one")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(many, ";").alias("recipients"))


def p06_flatten_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return rows.groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.count(F.lit(1)))


def p07_p09_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A row for each line item, and one for an order without items."""
    items = table(spark, d, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("rows"))
    both = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", F.coalesce(F.size("rows"), F.lit(0)).cast("long").alias("row_count"), F.posexplode_outer("rows").alias("row_index", "line"))


def p15_redact(spark: SparkSession, d: str) -> DataFrame:
    entries = redacted(F.create_map(F.lit("user"), F.col("c_name"), F.lit("API_key"), F.col("c_mktsegment"), F.lit("note"), F.repeat("c_mktsegment", 30)))
    return table(spark, d, "customer").select("c_custkey", F.to_json(entries).alias("log"))


def body_spam(text: Column) -> Column:
    """The rules about a body that hold, as structs of rule and points; a null text has none."""

    def rules(low: Column, found: Column) -> Column:
        hosts = F.transform(F.slice(found, 1, 200), lambda u: F.regexp_extract(u, SPAM_HOST, 1))
        several = lambda test, each, most: let(F.size(F.filter(hosts, test)), lambda n: F.least(F.lit(most), n * F.lit(each)))
        # Slow patterns run only on texts that hold what every match of theirs does.
        bare = F.when(F.contains(low, F.lit("<")), F.regexp_replace(low, "<[^>]*>", " ")).otherwise(low)
        visible = F.trim(F.regexp_replace(bare, r"\s+", " "))
        points = {f"body:{name}": F.when(low.rlike(pattern), F.lit(w)) for name, pattern, w in SPAM_PHRASES} | {
            "many-urls": F.when(F.size(found) > 40, F.lit(0.6)),
            "url-shorteners": several(lambda h: h.isin(*SHORTENERS), 0.4, 1.0),
            "bare-ip-urls": several(lambda h: h.rlike(BARE_IP), 0.8, 1.5),
            "suspicious-tld-urls": several(lambda h: F.substring_index(h, ".", -1).isin(*SPAM_TLDS), 0.4, 1.2),
            "script-in-body": F.when(F.contains(low, F.lit("<script")) | F.contains(low, F.lit("onerror=")) | F.contains(low, F.lit("onload=")), F.lit(1.2)),
            "hidden-text": F.when(F.contains(low, F.lit("style=")), F.when(low.rlike(HIDDEN_STYLE), F.lit(0.6))),
            "image-or-link-only": F.when((F.size(found) > 0) | F.contains(low, F.lit("<img")), F.when(F.length(visible) < 15, F.lit(0.8))),
        }
        return F.filter(F.array(*(F.struct(F.lit(rule).alias("rule"), p.alias("points")) for rule, p in points.items())), lambda r: r["points"] != 0)

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: let(F.regexp_extract_all(F.when(F.contains(low, F.lit("http")), low).otherwise(""), F.lit(SPAM_URL), F.lit(0)), lambda found: rules(low, found)))


def spam_score(reasons: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.aggregate(reasons, F.lit(0.0), lambda a, r: a + r["points"]))), 2)


def spam_sample() -> Column:
    """Texts of the documents, with endings that meet the rules."""
    ends = ("You have won! Act now", "unsubscribe", "see https://bit.ly/a and http://10.1.2.3/b or http://x.example.top/?q", "<p style='display: none'>x</p><script>y</script>", "bitcoin, no obligation: verify your account")
    return F.concat_ws(" ", F.when(F.col("doc_id") % 7 != 6, F.col("text")), F.get(F.array(*map(F.lit, ends), F.lit("<img src=x>")), (F.col("doc_id") % 7).cast("int")))


def v07_spam_score(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", body_spam(spam_sample()).alias("reasons"))
    return rows.select("doc_id", spam_score(F.col("reasons")).alias("score"), F.array_join(F.transform("reasons", lambda r: r["rule"]), ",").alias("reasons"))


def message_detections(spark: SparkSession, d: str) -> DataFrame:
    """What the deterministic pass finds in every document."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", document_type(t).alias("type"), language(t).alias("language"), F.size(emails(t)).cast("long").alias("n_emails"), F.size(urls(t)).cast("long").alias("n_urls"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:1] in "tpsjv" and n[1:3].isdigit()} | {"message_detections": message_detections}

#: References that pages use, the ampersand last, so that nothing is decoded twice.
_REFERENCES = (*((f'&{n};', c) for n, c in ENTITIES.items() if n != 'amp'), ('&#39;', "'"))
_decoded = lambda x: f"regexp_replace({_replaced(x, _REFERENCES)}, '&amp;?', '&', 'g')"
_q = lambda s: "'" + s.replace("'", "''") + "'"
_replaced = lambda x, pairs: reduce(lambda t, p: f"replace({t}, {_q(p[0])}, {_q(p[1])})", pairs, x)
_best = lambda rows: f"list_max([{', '.join(rows)}])"


def _language_sql(text: str) -> str:
    rows = [f"{{'n': len(list_filter(words, lambda w: w IN ({', '.join(map(_q, m.split()))}))), 'o': {-k}, 'v': '{lang}'}}" for k, (lang, m) in enumerate(MARKERS.items())]
    return f"""SELECT *, CASE WHEN length(trim(plain)) >= {LEAST_CHARS} AND len(words) >= {LEAST_WORDS} AND best.n > 0 AND best.n / len(words) >= {LEAST_SCORE} THEN best.v END AS language
        FROM (SELECT *, {_best(rows)} AS best FROM (SELECT *, list_filter(regexp_split_to_array(plain, '\\s+'), lambda w: w <> '') AS words FROM (SELECT *, regexp_replace(lower({text}), '[^\\p{{L}}\\s]', ' ', 'g') AS plain FROM documents)))"""


def _type_sql(text: str, subject: str = "''") -> str:
    weight = lambda p, w: f"(least(len(regexp_extract_all(low, {_q(p)})), 3) + CASE WHEN regexp_matches(head, {_q(p)}) THEN 1 ELSE 0 END) * {w}"
    score = lambda t, ps: f"(CASE WHEN {_q(t)} = 'receipt' AND regexp_matches(low, {_q(PROMOTION)}) AND NOT regexp_matches(low, {_q(PAYMENT)}) THEN 0 ELSE " + " + ".join(weight(p, w) for p, w in ps.items()) + " END)"
    rows = [f"{{'n': {score(t, ps)}, 'o': {-k}, 'v': '{t}'}}" for k, (t, ps) in enumerate(TYPE_PATTERNS.items())]
    return f"SELECT doc_id, CASE WHEN best.n >= 3 THEN best.v ELSE 'generic' END AS type FROM (SELECT doc_id, {_best(rows)} AS best FROM (SELECT doc_id, lower(coalesce({text}, '')) AS low, lower(coalesce({subject}, '')) AS head FROM documents))"


def _number_sql(raw: str, source: str, key: str, name: str) -> str:
    return f"""WITH r AS (SELECT {key}, trim({raw}) AS s FROM {source}),
        c AS (SELECT *, regexp_matches(s, '^\\(.*\\)$|^-|-$') AS neg, regexp_replace(regexp_replace(s, '^[^0-9]+|[^0-9]+$', '', 'g'), '[''’ ]([0-9]{{3}})\\b', '\\1', 'g') AS core FROM r),
        p AS (SELECT *, contains(core, ',') AS comma, contains(core, '.') AS dot, length(list_extract(string_split(core, ','), -1)) AS ac, length(list_extract(string_split(core, '.'), -1)) AS ad,
            len(string_split(core, ',')) > 2 AS mc, len(string_split(core, '.')) > 2 AS md FROM c),
        x AS (SELECT *, CASE WHEN comma AND dot THEN CASE WHEN ac < ad THEN ',' ELSE '.' END WHEN comma THEN CASE WHEN mc OR ac = 3 THEN '' ELSE ',' END
            WHEN dot THEN CASE WHEN md OR regexp_matches(core, '^[0-9]{{1,3}}\\.[0-9]{{3}}$') THEN '' ELSE '.' END ELSE '' END AS sep FROM p),
        v AS (SELECT *, try_cast(CASE sep WHEN ',' THEN replace(replace(core, '.', ''), ',', '.') WHEN '.' THEN replace(core, ',', '') ELSE regexp_replace(core, '[.,]', '', 'g') END AS DOUBLE) AS n FROM x)
        SELECT {key}, CASE WHEN neg THEN -n ELSE n END AS {name} FROM v"""


_FMT = "format('{:,.2f}', {})"
_US = "format('{:,.2f}', o_totalprice)"
_RAW = f"[{_US}, translate({_US}, ',.', '.,'), '(' || {_US} || ')', 'EUR ' || translate({_US}, ',.', ' ,'), format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)), 'none', {_US} || '-'][o_orderkey % 7 + 1]"
_DOMAIN = f"regexp_extract(url, '{HOST}', 1)"
_C = CEILINGS
_SUBJECT = "['Invoice, amount due', 'Your parcel has shipped: tracking code', 'Meeting request, RSVP', 'Prize notification: receipt of documents, receipt', 'Payment received: prize claim, receipt 7', 'Anfrage über das Kontaktformular'][doc_id % 7 + 1]"

ORACLE_SQL = {
    "t03_entities": f"SELECT page_id, md5({_decoded('html')}) AS decoded FROM pages",
    "p16_escape": f"""SELECT doc_id, md5({_replaced('text', (('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), ('"', '&quot;'), ("'", '&#39;')))}) AS escaped FROM documents""",
    "t08_links": """SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href=["'']((?:https?:|mailto:|tel:|/)[^"'']*)["'']', 1) AS l FROM pages)""",
    "t13_language": f"SELECT doc_id, language FROM ({_language_sql('text')})",
    "t14_emails": f"""WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(text, {_q(EMAIL)}), lambda e: regexp_replace(e, '^[.]+|[.]+$', '', 'g')) AS l FROM documents),
        m AS (SELECT doc_id, list_filter(list_transform(l, lambda e: regexp_extract(e, '(?s)^(.*)@[^@]*$', 1) || '@' || lower(list_extract(string_split(e, '@'), -1))), lambda e: regexp_matches(e, '\\.[A-Za-z]{{2,}}$')) AS l FROM e)
        SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS emails FROM m""",
    "t15_urls": f"""WITH u AS (SELECT doc_id, text || ' see www.example.org/a. (see https://a.example/x) HTTP://B.example/y, [www.c.example]' AS t FROM documents),
        m AS (SELECT doc_id, list_transform(list_concat(regexp_extract_all(t, {_q(URL)}), list_transform(regexp_extract_all(t, {_q(BEFORE_URL + '(' + BARE_URL + ')')}, 1), lambda x: 'http://' || x)), lambda x: regexp_replace(x, '[.,;:!?]+$', '')) AS l FROM u)
        SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS urls FROM m""",
    "t19_l07_type": _type_sql(f"concat_ws(chr(10), {_SUBJECT}, text)", _SUBJECT),
    "t21_parse_number": _number_sql(_RAW, "orders", "o_orderkey", "value"),
    "t29_t63_number_forms": """WITH f AS (SELECT p_partkey, format('{:,.2f}', p_retailprice) AS g, format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS w FROM part),
        l AS (SELECT p_partkey, [g, replace(g, ',', ''), translate(g, ',.', '.,'), w] AS l FROM f) SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' | ') AS forms FROM l""",
    "t23_currency": "SELECT c_custkey, ['USD', 'EUR', 'EUR', 'CNY', 'CHF', 'USD'][c_custkey % 6 + 1] AS currency FROM customer",
    "t30_t62_evidence": """WITH c AS (SELECT doc_id, text AS t, array_to_string(string_split(text, ' ')[3 : 3 + doc_id % 4], ' ') || CASE WHEN doc_id % 5 = 0 THEN ' never said' ELSE '' END AS e FROM documents)
        SELECT doc_id, length(trim(e)) >= 4 AND contains(lower(trim(regexp_replace(t, '[\\s ]+', ' ', 'g'))), lower(trim(regexp_replace(e, '[\\s ]+', ' ', 'g')))) AS ok FROM c""",
    "t32_t44_evidence_window": "SELECT doc_id, substring(text, greatest(p - 20, 1), least(p - 1, 20) + 8 + 20) AS window FROM (SELECT doc_id, text, instr(text, 'token = ') AS p FROM documents) WHERE p > 0",
    "t33_norm": "SELECT item_id, lower(trim(regexp_replace(text, '[\\s ]+', ' ', 'g'))) AS norm FROM benchmark",
    "t34_t35_corroborates": """WITH i AS (SELECT l_orderkey, list_sort(list(l_extendedprice)) AS a FROM lineitem GROUP BY 1), v AS (SELECT o_orderkey, a, a[1] + CASE WHEN o_orderkey % 2 = 0 THEN 0.004 ELSE 0.02 END AS v FROM orders JOIN i ON o_orderkey = l_orderkey)
        SELECT o_orderkey, len(list_filter(a, lambda x: abs(x - v) < 0.005)) > 0 AS seen FROM v""",
    "t36_confidence": f"""WITH e AS (SELECT event_id, event_id % 4 AS s, event_id % 2 = 0 AS given, event_id % 5 < 3 AS ok, event_id % 7 < 3 AS seen, event_id % 11 = 0 AS dis, event_id % 3 AS ar, event_id % 13 <> 0 AS anchored, event_id % 17 <> 0 AS sound, CASE WHEN event_id % 19 < 5 THEN (event_id % 100) / 100 END AS stated FROM events),
        a AS (SELECT *, CAST(CASE s WHEN 0 THEN {_C['header']} WHEN 1 THEN {_C['rule']} WHEN 2 THEN {_C['both']} ELSE CASE WHEN given AND NOT ok THEN {_C['invented']} WHEN ok AND seen THEN {_C['cited_and_seen']} WHEN ok THEN {_C['cited']} WHEN seen THEN {_C['seen']} ELSE {_C['bare']} END END AS DOUBLE) AS t FROM e),
        b AS (SELECT *, CASE WHEN s <> 3 AND given AND NOT ok THEN least(t * 0.5, {_C['invented']}) ELSE t END AS t2 FROM a), c AS (SELECT *, CASE WHEN dis THEN least(t2, {_C['disagreement']}) ELSE t2 END AS t3 FROM b),
        d AS (SELECT *, CASE ar WHEN 0 THEN least(0.98, t3 + 0.03) WHEN 1 THEN t3 * 0.8 ELSE t3 END AS t4 FROM c), g AS (SELECT *, CASE WHEN sound THEN t4 ELSE least(t4 * 0.6, {_C['nonsense']}) END AS t6 FROM d),
        f AS (SELECT *, least(CASE WHEN NOT anchored AND s <> 0 THEN least(t6, {_C['unanchored']}) ELSE t6 END, coalesce(stated, 1.0)) AS t5 FROM g)
        SELECT event_id, round(greatest(0.0, least(1.0, t5)), 3) AS confidence FROM f""",
    "t47_quantity_tail": """WITH l AS (SELECT p_partkey, concat_ws(' ', p_name, CASE WHEN p_size % 2 = 0 THEN p_size || ' x' END) AS line FROM part)
        SELECT p_partkey, try_cast(nullif(regexp_extract(line, '([0-9]+) ?x$', 1), '') AS INT) AS qty, trim(regexp_replace(line, '[0-9]+ ?x$', '')) AS description FROM l""",
    "t52_domain_lowered": "SELECT c_custkey, c_name || '@' || lower('Mail.' || c_mktsegment || '.COM') AS address FROM customer",
    "t54_path_host": f"SELECT page_id, regexp_replace(lower({_DOMAIN}), '^www\\.', '') AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages",
    "t55_recipient_token": "SELECT c_custkey, 'tok' || c_custkey AS token, lower(c_mktsegment) AS slug, CASE WHEN c_custkey % 2 = 0 THEN 'tagged' END AS tag FROM customer",
    "t56_slug": "SELECT p_partkey, left(regexp_replace(regexp_replace(lower(concat_ws(' / ', p_name, p_type)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 32) AS slug FROM part",
    "t58_id_hash": "SELECT c_custkey, left(sha256(lower('<' || c_name || '@X>')), 24) AS hash FROM customer",
    "t60_numeric_cells": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents), c AS (SELECT doc_id, no, list_transform(string_split(line, '|'), lambda x: trim(x, ' ')) AS cells FROM l WHERE contains(line, '|'))
        SELECT doc_id, CAST(no AS INT) AS no, CAST(len(cells) AS BIGINT) AS cells, CAST(len(list_filter(cells, lambda x: regexp_matches(x, '^[-+]?[0-9][0-9.,]*$'))) AS BIGINT) AS numeric, len(list_filter(cells, lambda x: regexp_matches(lower(x), '^(sub)?(total|summe|gesamt)'))) > 0 AS totals FROM c""",
    "t61_to_amount": _number_sql(f"regexp_extract('was ' || {_RAW} || ' in all', '([0-9][0-9.,]*[0-9])', 1)", "orders", "o_orderkey", "amount"),
    "s23_s25_delimiter": """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM documents),
        c AS (SELECT doc_id, s, o, list_sort(list_transform(l, lambda x: length(x) - length(replace(x, s, '')))) AS c FROM l, (VALUES (',', 0), (';', -1), ('|', -2)) v(s, o)),
        m AS (SELECT *, c[CAST(floor(len(c) / 2) AS BIGINT) + 1] AS m FROM c), n AS (SELECT doc_id, s, o, CASE WHEN m > 0 THEN len(list_filter(c, lambda x: x = m)) * 10 + m ELSE 0 END AS n FROM m)
        SELECT doc_id, CASE WHEN n > 0 THEN s END AS delimiter FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o DESC) AS no FROM n) WHERE no = 1""",
    "s38_html_to_text": f"""SELECT page_id, md5(trim(regexp_replace({_decoded("regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g')")}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')) AS digest FROM pages""",
    "p02_preview": "SELECT doc_id, left(text, 40) AS preview, length(text) AS text_length, length(text) > 40 AS text_truncated FROM documents",
    "p03_summary": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || ';' || c_mktsegment ELSE c_name END AS recipients FROM customer",
    "p06_flatten_pivot": """SELECT l_orderkey, nullif(count(*) FILTER (l_returnflag = 'A'), 0) AS "A", nullif(count(*) FILTER (l_returnflag = 'N'), 0) AS "N", nullif(count(*) FILTER (l_returnflag = 'R'), 0) AS "R" FROM lineitem GROUP BY 1""",
    "p07_p09_fan_out": """WITH i AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_quantity > 40)
        SELECT o_orderkey, coalesce(n, 0) AS row_count, CAST(k AS INT) AS row_index, l_linenumber AS line FROM orders LEFT JOIN i ON o_orderkey = l_orderkey""",
    "p15_redact": """SELECT c_custkey, '{"user":"' || c_name || '","API_key":"[redacted]","note":"' || CASE WHEN length(repeat(c_mktsegment, 30)) > 200 THEN left(repeat(c_mktsegment, 30), 200) || '…' ELSE repeat(c_mktsegment, 30) END || '"}' AS log FROM customer""",
    "v07_spam_score": f"""WITH b AS (SELECT doc_id, lower(concat_ws(' ', CASE WHEN doc_id % 7 <> 6 THEN text END, ['You have won! Act now', 'unsubscribe', 'see https://bit.ly/a and http://10.1.2.3/b or http://x.example.top/?q',
          '<p style=''display: none''>x</p><script>y</script>', 'bitcoin, no obligation: verify your account', '<img src=x>'][doc_id % 7 + 1])) AS low FROM documents),
        u AS (SELECT *, regexp_extract_all(low, {_q(SPAM_URL)}) AS urls FROM b),
        h AS (SELECT *, list_transform(urls[1:200], lambda x: regexp_extract(x, {_q(SPAM_HOST)}, 1)) AS hosts, trim(regexp_replace(regexp_replace(low, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS visible FROM u),
        r AS (SELECT doc_id, list_filter([{', '.join(f"{{'rule': 'body:{n}', 'points': CASE WHEN regexp_matches(low, {_q(p)}) THEN CAST({w} AS DOUBLE) ELSE 0 END}}" for n, p, w in SPAM_PHRASES)},
          {{'rule': 'many-urls', 'points': CASE WHEN len(urls) > 40 THEN 0.6 ELSE 0 END}},
          {{'rule': 'url-shorteners', 'points': least(1.0, 0.4 * len(list_filter(hosts, lambda x: x IN ({', '.join(map(_q, SHORTENERS))}))))}},
          {{'rule': 'bare-ip-urls', 'points': least(1.5, 0.8 * len(list_filter(hosts, lambda x: regexp_matches(x, {_q(BARE_IP)}))))}},
          {{'rule': 'suspicious-tld-urls', 'points': least(1.2, 0.4 * len(list_filter(hosts, lambda x: string_split(x, '.')[-1] IN ({', '.join(map(_q, SPAM_TLDS))}))))}},
          {{'rule': 'script-in-body', 'points': CASE WHEN regexp_matches(low, '<script|onerror=|onload=') THEN 1.2 ELSE 0 END}},
          {{'rule': 'hidden-text', 'points': CASE WHEN regexp_matches(low, {_q(HIDDEN_STYLE)}) THEN 0.6 ELSE 0 END}},
          {{'rule': 'image-or-link-only', 'points': CASE WHEN length(visible) < 15 AND (len(urls) > 0 OR contains(low, '<img')) THEN 0.8 ELSE 0 END}}], lambda x: x.points <> 0) AS reasons FROM h)
        SELECT doc_id, round(greatest(0.0, least(10.0, coalesce(list_sum(list_transform(reasons, lambda x: x.points)), 0))), 2) AS score, array_to_string(list_transform(reasons, lambda x: x.rule), ',') AS reasons FROM r""",
}
ORACLE_SQL["message_detections"] = f"""SELECT doc_id, type, language, CAST(len(string_split(emails, ' ')) - CASE WHEN emails = '' THEN 1 ELSE 0 END AS BIGINT) AS n_emails, CAST(len(string_split(urls, ' ')) - 4 AS BIGINT) AS n_urls
    FROM ({_type_sql('text')}) JOIN ({ORACLE_SQL['t13_language']}) USING (doc_id) JOIN ({ORACLE_SQL['t14_emails']}) USING (doc_id) JOIN ({ORACLE_SQL['t15_urls']}) USING (doc_id)"""

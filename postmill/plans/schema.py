"""User schemas: a list of typed fields, checked before a job starts, planned as column expressions.

Each field becomes a struct (ok, value): a value that can't be read as the field's type is null and
not ok, which is a flag of the row, never an error. Placeholders such as "N/A" are null and ok.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import to_date
from ..functions.money import CODES, SYMBOLS

#: The types of fields.
TYPES = ("string", "number", "integer", "boolean", "date", "datetime", "email", "url", "phone", "currency", "enum", "array", "object")
MAX_FIELDS, MAX_DEPTH = 60, 2
PLACEHOLDER = r"(?i)^\s*(n/?a|none|null|unknown|not (?:found|provided|specified|available)|-{1,3}|keine? angabe)?\s*$"
CURRENCY = f"({SYMBOLS}|{CODES})"
AMOUNT = rf"((?:{SYMBOLS}|{CODES})\s{{0,3}}-?[0-9][0-9.,' ]*[0-9]|-?[0-9][0-9.,' ]*\s{{0,3}}(?:{SYMBOLS}|{CODES}))"


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    description: str = ""
    hint: str = ""
    required: bool = False
    options: tuple[str, ...] = ()
    items: Field | None = None
    fields: tuple[Field, ...] = field(default=())


def normalise(schema: list | dict) -> tuple[Field, ...]:
    """The list form, or the shorthand {name: type}, as checked fields."""
    rows = [{"name": n, "type": t} for n, t in schema.items()] if isinstance(schema, dict) else schema
    if not isinstance(rows, (list, tuple)) or not 0 < len(rows) <= MAX_FIELDS:
        raise SchemaError(f"a schema has 1 to {MAX_FIELDS} fields")
    fields = tuple(_field(r, 0) for r in rows)
    if len({f.name for f in fields}) < len(fields):
        raise SchemaError("a field's name occurs twice")
    return fields


def from_form(rows: list[dict]) -> tuple[Field, ...]:
    """A schema of a form's rows: name, type, description, required, hint, and, as texts, enumOptions (comma-separated), itemType and nestedFields (a JSON array)."""
    found = []
    for no, row in enumerate(rows, 1):
        name, kind = str(row.get("name") or "").strip(), row.get("type") or "string"
        if not name:
            raise SchemaError(f"field {no} has no name")
        field = {"name": name, "type": kind, **{k: row[k] for k in ("description", "hint") if row.get(k)}, "required": bool(row.get("required"))}
        if kind == "enum":
            field["options"] = [v.strip() for v in str(row.get("enumOptions") or "").split(",") if v.strip()]
        if kind == "array":
            field["items"] = {"type": row.get("itemType") or "string"}
        if kind == "object":
            try:
                field["fields"] = json.loads(row.get("nestedFields") or "")
            except ValueError:
                field["fields"] = None
            if not isinstance(field["fields"], list):
                raise SchemaError(f"{name}: sub-fields are no JSON array")
        found.append(field)
    return normalise(found)


def _field(row: dict, depth: int) -> Field:
    name, kind = str(row.get("name", "")), str(row.get("type", "string")).lower()
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,63}", name):
        raise SchemaError(f"bad name: {name!r}")
    if kind not in TYPES:
        raise SchemaError(f"{name}: bad type {kind!r}")
    if kind == "enum" and not row.get("options"):
        raise SchemaError(f"{name}: an enum needs options")
    if kind == "object" and depth >= MAX_DEPTH:
        raise SchemaError(f"{name}: objects nest too deep")
    items = _field({"name": "item", **row["items"]}, depth + 1) if kind == "array" and row.get("items") else None
    return Field(name, kind, row.get("description", ""), row.get("hint", ""), bool(row.get("required")), tuple(row.get("options", ())), items, tuple(_field(f, depth + 1) for f in row.get("fields", ())))


def _value(raw: Column, f: Field, day: Callable[[Column], Column]) -> Column:
    """The text ``raw`` as the field's type; null where it can't be."""
    s = F.trim(raw)
    match f.type:
        case "string":
            return F.regexp_replace(s, r"\s+", " ")
        case "number":
            return T.parse_number(raw)
        case "integer":
            return F.floor(T.parse_number(raw) + 0.5).cast("long")
        case "boolean":
            return F.when(F.lower(s).isin(*T.TRUE_WORDS), F.lit(True)).when(F.lower(s).isin(*T.FALSE_WORDS), F.lit(False))
        case "date":
            return day(s)
        case "datetime":
            return F.coalesce(*(F.try_to_timestamp(s, F.lit(x)) for x in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")), day(s).cast("timestamp"))
        case "email":
            return T.domain_lowered(F.nullif(F.regexp_extract(s, f"({T.EMAIL})", 1), F.lit("")))
        case "url":
            u = F.when(F.lower(s).startswith("www."), F.concat(F.lit("https://"), s)).otherwise(s)
            return F.when(u.rlike(r"(?i)^https?://[^\s/]+"), u)
        case "phone":
            digits = F.regexp_replace(s, "[^0-9]", "")
            plus = s.startswith("+") | digits.startswith("00")
            return F.when(F.length(digits).between(6, 15), F.when(plus, F.concat(F.lit("+"), F.regexp_replace(digits, "^00", ""))).otherwise(digits))
        case "currency":
            hit = F.nullif(F.regexp_extract(s, AMOUNT, 1), F.lit(""))
            amount = T.parse_number(F.coalesce(hit, s))
            return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), T.currency(F.regexp_extract(hit, CURRENCY, 1)).alias("currency")))
        case "enum":
            exact = [F.when(F.lower(s) == o.lower(), F.lit(o)) for o in f.options]
            loose = [F.when(F.contains(F.lower(s), F.lit(o.lower())) | F.contains(F.lit(o.lower()), F.lower(s)), F.lit(o)) for o in f.options]
            return F.coalesce(*exact, *loose)
        case "array":
            parts = F.coalesce(F.when(s.startswith("["), F.from_json(s, "array<string>")), F.split(s, r"\s*[,;\n]\s*"))
            item = f.items or Field("item")
            return F.filter(F.transform(parts, lambda x: coerced(x, item)["value"]), lambda x: x.isNotNull())
        case _:
            entries = F.from_json(s, "map<string,string>")
            return F.when(entries.isNotNull(), F.struct(*(coerced(entries[x.name], x)["value"].alias(x.name) for x in f.fields)) if f.fields else entries)


def coerced(raw: Column, f: Field, day: Callable[[Column], Column] = to_date) -> Column:
    """struct(ok, value). ``day`` reads dates, where they are known to be of one form."""
    none = raw.isNull() | raw.rlike(PLACEHOLDER)
    value = F.when(~none, _value(raw, f, day))
    return F.struct((none | value.isNotNull()).alias("ok"), value.alias("value"))


def typed(rows: DataFrame, fields: tuple[Field, ...], raw: str = "raw") -> DataFrame:
    """``rows`` with ``fields``, a struct of typed values, and ``flags``; ``raw`` is a map of texts by field name."""
    out = rows.withColumn("__typed", F.struct(*(coerced(F.col(raw)[f.name], f).alias(f.name) for f in fields)))
    flag = lambda f: F.when(~F.col("__typed")[f.name]["ok"], F.lit(f"{'enum_violation' if f.type == 'enum' else 'type_error'}:{f.name}")).when(F.lit(f.required) & F.col("__typed")[f.name]["value"].isNull(), F.lit(f"required_missing:{f.name}"))
    values = F.struct(*(F.col("__typed")[f.name]["value"].alias(f.name) for f in fields))
    return out.withColumn("fields", values).withColumn("flags", F.array_compact(F.array(*(flag(f) for f in fields)))).drop("__typed")


_GAP, _SIGNS = r"[^\S\n]*", "$€£¥₹"
_DIGITS = r"[0-9][0-9.,'\u00a0’ ]*"
#: What may follow a label, by the field's type: an amount that is no rate, the rest of a line, an address.
VALUES = {
    "number": rf"(?!{_GAP}[-(]?{_GAP}[{_SIGNS}]?{_GAP}{_DIGITS}{_GAP}%)([-(]?{_GAP}(?:[A-Z]{{1,3}}{_GAP})?[{_SIGNS}]?{_GAP}-?{_DIGITS}(?:[A-Z]{{3}}|[{_SIGNS}])?{_GAP}[-)]?)",
    "date": r"([^\n\t]{4,60})", "email": f"({T.EMAIL})", "url": r"((?:https?://|www\.)[^\s<>\"']+)", "string": r"(\S[^\n]*)",
}
VALUES |= {"integer": VALUES["number"], "currency": VALUES["number"], "datetime": VALUES["date"]}


def label_search(text: Column, labels: list[str], kind: str = "string") -> Column:
    """What follows the first label found, the longest first: after a sign, a gap or on the next line, and, for types whose values show themselves, after one blank. ``kind``: the field's type."""
    tries, value = [], VALUES.get(kind, VALUES["string"])
    end = "$" if value == VALUES["string"] else ""
    for label in sorted(labels, key=len, reverse=True):
        name = re.escape(label)
        tries += [rf"(?im)^\s*{name}\s*(?:no\.?|nr\.?|#)?\s*[:=#]\s*{value}{end}", rf"(?im)^\s*{name}\s{{2,}}{value}{end}", rf"(?im)^\s*{name}\s*:?\s*\n\s*{value}{end}"]
        if kind in VALUES and kind != "string":
            tries.append(rf"(?im)^[^\S\n]{{0,8}}{name}[ \t]{value}")
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in tries))


def field_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What a replay with another schema changes, by key and field: rows (keys, field, value, confidence, source)."""
    b, a = (df.select(*keys, "field", F.struct("value", "confidence", "source").alias(n)) for df, n in ((before, "before"), (after, "after")))
    same = F.col("before.value").eqNullSafe(F.col("after.value")) & (F.abs(F.col("before.confidence") - F.col("after.confidence")) < 0.005) & F.col("before.source").eqNullSafe(F.col("after.source"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.coalesce(same, F.lit(False)), "changed")
    return b.join(a, [*keys, "field"], "full_outer").withColumn("change", change).where("change IS NOT NULL")


def versions_in_force(versions: DataFrame) -> DataFrame:
    """The greatest version of each mailbox of an append-only table (mailbox_id, version, schema)."""
    return versions.groupBy("mailbox_id").agg(F.max("version").alias("version"), F.max_by("schema", "version").alias("schema"))


def rolled_back(versions: DataFrame, mailbox_id: object, to_version: int) -> DataFrame:
    """The row that a rollback appends: the old schema under a new version."""
    newest = F.max("version").over(Window.partitionBy("mailbox_id"))
    return versions.withColumn("newest", newest).where((F.col("mailbox_id") == mailbox_id) & (F.col("version") == to_version)).select("mailbox_id", (F.col("newest") + 1).alias("version"), "schema")

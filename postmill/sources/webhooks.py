"""Deliveries that landed as JSON, from several senders, as one shape: sender, recipients, raw message, error.

Each adapter is a projection of landed rows (headers: map, body: JSON text, fields: map of form fields) to
struct(from, to, raw). Unknown adapters and deliveries without a message become rows with an error. Adapters
are looked up by name, so others can be added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detect import hmac_sha256
from . import mailbox

MAX_SKEW_S = 300


def _header(name: str) -> Column:
    return F.try_element_at("headers", F.lit(name))


def _list(text: Column) -> Column:
    """A JSON array or a comma-separated text."""
    parts = F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.split(text, r"\s*,\s*"))
    return F.filter(parts, lambda x: F.trim(x) != "")


def crlf(raw: Column) -> Column:
    """Lines end in CR LF, as mail does; bytes beyond ASCII stay as they are."""
    return F.encode(F.regexp_replace(F.decode(raw, "ISO-8859-1"), "\r?\n", "\r\n"), "ISO-8859-1")


def _shape(sender: Column, to: Column, raw: Column) -> Column:
    return F.struct(sender.alias("from"), _list(to).alias("to"), crlf(raw).alias("raw"))


def worker() -> Column:
    """The raw message is the body, the envelope stands in headers."""
    return _shape(_header("x-envelope-from"), _header("x-envelope-to"), F.encode("body", "UTF-8"))


def form() -> Column:
    """A posted form with the untouched message."""
    field = lambda n: F.try_element_at("fields", F.lit(n))
    return _shape(field("sender"), field("recipient"), F.encode(field("body-mime"), "UTF-8"))


def enveloped() -> Column:
    """JSON with an envelope and the message as text or base64."""
    at = lambda path: F.get_json_object("body", path)
    raw = F.coalesce(F.try_to_binary(at("$.raw_mime_base64"), F.lit("base64")), F.encode(F.coalesce(at("$.raw_message"), at("$.raw_mime"), at("$.raw"), at("$.message")), "UTF-8"))
    return _shape(at("$.envelope.from"), F.coalesce(at("$.envelope.to"), at("$.envelope.recipients")), raw)


ADAPTERS: dict[str, Callable[[], Column]] = {"worker": worker, "form": form, "enveloped": enveloped}
SOURCES: dict[str, Callable[[SparkSession], None]] = {"mailbox": mailbox.register}


def signature_error(secret: str, now: Column) -> Column:
    """Why a signed form can't be trusted, null if it can: timestamp and token are signed, and the time must be near."""
    field = lambda n: F.try_element_at("fields", F.lit(n))
    missing = field("timestamp").isNull() | field("token").isNull() | field("signature").isNull()
    age = F.abs(F.unix_timestamp(now) - field("timestamp").try_cast("bigint"))
    good = hmac_sha256(secret, F.concat(field("timestamp"), field("token"))) == field("signature")
    return F.when(missing, "missing signature").when(~F.coalesce(age <= MAX_SKEW_S, F.lit(False)), "stale timestamp").when(~good, "bad signature")


def normalised(landed: DataFrame, *, adapter: str = "adapter") -> DataFrame:
    """``landed`` with from, to, raw and error."""
    tries = [F.when(F.col(adapter) == name, make()) for name, make in ADAPTERS.items()]
    rows = landed.withColumn("__d", F.coalesce(*tries))
    error = F.when(F.col("__d").isNull(), "unknown adapter").when(F.coalesce(F.length("__d.raw"), F.lit(0)) == 0, "no message")
    return rows.select("*", "__d.from", "__d.to", "__d.raw", error.alias("error")).drop("__d")

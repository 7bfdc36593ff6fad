"""RFC 822 messages: raw bytes to one nested row each.

Files come in by ``spark.read.format("binaryFile")`` (or a stream of it); the parse is a map over
Arrow batches with the standard library's e-mail package. What follows (attachment rows, search
surfaces, header lookups) is DataFrame work on the nested row. A message that can't be parsed
becomes a row with an error, which ``quarantine`` splits off.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
from collections.abc import Iterator
from datetime import UTC
from email.header import decode_header
from email.message import Message

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import _ship  # noqa: F401

MAX_TEXT, MAX_DEPTH, MAX_PARTS, MAX_INLINE = 1_000_000, 20, 500, 25 << 20
ADDRESS = "struct<name:string,email:string>"
ATTACHMENT = "struct<id:string,filename:string,content_type:string,size:bigint,inline:boolean,content_id:string,content:binary>"
MESSAGE = (
    f"message_id string, subject string, date timestamp, from struct<name:string,email:string>, to array<{ADDRESS}>, cc array<{ADDRESS}>, reply_to array<{ADDRESS}>, in_reply_to string, "
    f"references array<string>, raw_headers map<string,array<string>>, text string, html string, attachments array<{ATTACHMENT}>, warnings array<string>, error string"
)
#: Charset labels that Python knows by another name.
CHARSETS = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "x-sjis": "shift_jis", "ks_c_5601-1987": "cp949", "gb2312": "gbk", "unicode-1-1-utf-7": "utf-7"}


def decode_text(raw: bytes, label: str | None) -> str:
    """By the declared charset, else strict UTF-8, else Windows-1252."""
    name = (label or "").strip().strip("\"'").lower()
    for charset in (CHARSETS.get(name, name), "utf-8", "cp1252"):
        if charset:
            try:
                return raw.decode(charset)
            except (LookupError, UnicodeDecodeError):
                pass
    return raw.decode("cp1252", "replace")


def decode_words(value: str | None) -> str | None:
    """Encoded words of a header; neighbours of one charset are joined before decoding."""
    if value is None:
        return None
    unfolded = " ".join(str(value).split())
    try:
        parts: list[tuple[bytes, str | None]] = []
        for raw, charset in decode_header(unfolded):
            raw = raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogateescape")
            if parts and parts[-1][1] == charset:
                parts[-1] = (parts[-1][0] + raw, charset)
            else:
                parts.append((raw, charset))
        return "".join(decode_text(raw, charset) for raw, charset in parts)
    except (ValueError, UnicodeError):
        return unfolded


def addresses(values: list[str]) -> list[dict]:
    found = email.utils.getaddresses([" ".join(str(v).split()) for v in values])
    out = []
    for name, address in found:
        local, at, domain = address.rpartition("@")
        if name or address:
            out.append({"name": decode_words(name) or None, "email": f"{local}{at}{domain.lower()}" if at else address or None})
    return out


def _filename(part: Message) -> str | None:
    name = part.get_filename()
    return decode_words(name)[:255] if name else None


def _walk(part: Message, depth: int, found: dict, seen: list[int]) -> None:
    seen[0] += 1
    if depth > MAX_DEPTH or seen[0] > MAX_PARTS:
        if "parts_capped" not in found["warnings"]:
            found["warnings"].append("parts_capped")
        return
    kind = part.get_content_type()
    if part.is_multipart() and kind != "message/rfc822":
        for sub in part.get_payload():
            _walk(sub, depth + 1, found, seen)
        return
    if kind == "message/rfc822" and part.is_multipart():
        payload = part.get_payload(0).as_bytes()
    else:
        payload = part.get_payload(decode=True) or b""
    disposition, name = part.get_content_disposition(), _filename(part)
    if kind in ("text/plain", "text/html") and disposition != "attachment" and not name:
        text = decode_text(payload, part.get_content_charset())
        if len(text) > MAX_TEXT:
            found["warnings"].append("text_truncated")
        found["text" if kind == "text/plain" else "html"].append(text[:MAX_TEXT])
        return
    found["attachments"].append(
        {
            "id": "att_" + hashlib.sha256(payload).hexdigest()[:22], "filename": name, "content_type": kind, "size": len(payload),
            "inline": disposition == "inline" or part.get("content-id") is not None, "content_id": (part.get("content-id") or "").strip("<> ") or None, "content": payload if len(payload) <= MAX_INLINE else None,
        }
    )


def parse(raw: bytes) -> dict:
    """One message; of several plain or HTML bodies of an alternative the last counts, others are joined."""
    if raw.startswith(b"From "):
        raw = raw.partition(b"\n")[2]
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    found: dict = {"text": [], "html": [], "attachments": [], "warnings": [type(d).__name__ for d in message.defects]}
    _walk(message, 0, found, [0])
    pick = lambda bodies: None if not bodies else bodies[-1] if message.get_content_type() == "multipart/alternative" else "\n".join(bodies)
    headers: dict[str, list[str]] = {}
    for name, value in message.items():
        headers.setdefault(name.lower(), []).append(decode_words(value))
    try:
        when = email.utils.parsedate_to_datetime(message["date"]) if message["date"] else None
        when = when.replace(tzinfo=UTC) if when and when.tzinfo is None else when
    except (ValueError, TypeError):
        when = None
    listed = lambda name: addresses(message.get_all(name) or [])
    return {
        "message_id": (message["message-id"] or "").strip() or None, "subject": decode_words(message["subject"]), "date": when.astimezone(UTC).replace(tzinfo=None) if when else None,
        "from": next(iter(listed("from")), None), "to": listed("to"), "cc": listed("cc"), "reply_to": listed("reply-to"), "in_reply_to": (message["in-reply-to"] or "").strip() or None,
        "references": (message["references"] or "").split(), "raw_headers": headers, "text": pick(found["text"]), "html": pick(found["html"]), "attachments": found["attachments"], "warnings": found["warnings"], "error": None,
    }


def parse_messages(raw: DataFrame, *, key: str = "path", content: str = "content") -> DataFrame:
    """Rows (key, bytes) to key and the nested message. Null bytes give a message without anything."""
    kind = raw.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = parse(b"")
        for b in batches:
            rows = []
            for k, body in zip(b[key], b[content], strict=True):
                try:
                    rows.append({key: k, **parse(bytes(body or b""))})
                except Exception as e:  # a message may be broken in any way; its row says how
                    rows.append({key: k, **empty, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[key, *empty])

    return raw.select(key, content).mapInPandas(run, f"`{key}` {kind}, {MESSAGE}")


def quarantine(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed, failed)"""
    return messages.where("error IS NULL"), messages.where("error IS NOT NULL")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return parse_messages(spark.read.format("binaryFile").load(path).select("path", "content"))


def from_parts(rows: DataFrame, *, subject: str, text: str, html: str, sender: str) -> DataFrame:
    """Loose columns as the message row, without bytes."""
    return rows.select("*", F.struct(F.col(subject).alias("subject"), F.substring(F.col(text), 1, MAX_TEXT).alias("text"), F.col(html).alias("html"), F.col(sender).alias("from")).alias("message"))


def attachment_rows(messages: DataFrame, key: str = "path") -> DataFrame:
    return messages.select(key, F.posexplode("attachments").alias("place", "a")).select(key, "place", "a.*")


def sniff_message_id(raw: Column) -> Column:
    """The Message-ID in the first 16 KB of the bytes, without a parse."""
    head = F.decode(F.substring(raw, 1, 16384), "ISO-8859-1")
    return F.regexp_extract(head, r"(?im)^message-id:[ \t]*(\S.*?)[ \t\r]*$", 1)


def surfaces(message: Column) -> Column:
    """Texts to search, kept apart, the empty ones left out."""
    named = F.array(*(F.struct(F.lit(n).alias("label"), message[n].alias("text")) for n in ("subject", "text", "html")))
    return F.filter(named, lambda s: F.length(s["text"]) > 1)


def read_auth(raw_headers: Column) -> Column:
    """What the Authentication-Results header says."""
    line = F.array_join(raw_headers["authentication-results"], " ")
    one = lambda n: F.nullif(F.lower(F.regexp_extract(line, rf"(?i)\b{n}=(\w+)", 1)), F.lit(""))
    return F.struct(one("spf").alias("spf"), one("dkim").alias("dkim"), one("dmarc").alias("dmarc"))

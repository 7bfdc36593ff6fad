"""Sender policies (RFC 7208) against a table of DNS answers.

A check is a small function over what is known of DNS. Where it needs a name that hasn't been looked up, it says so, and a join with the
answers adds it: in rounds, over the distinct senders that are still undecided, until none of them asks for anything new. A name
may depend on the sender by macros, so names are those of a sender, not of a domain.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import _ship  # noqa: F401
from ..sources.scratch import delete, written

#: Fixed values of RFC 7208: lookups of terms, lookups without an answer, addresses of one term, and how deep policies include others.
MAX_LOOKUPS, MAX_VOID, MAX_NAMES, MAX_DEPTH = 10, 2, 10, 10
RESULTS = {"+": "pass", "-": "fail", "~": "softfail", "?": "neutral"}
MACRO = re.compile(r"%(?:\{([a-z])([0-9]*)(r?)([-.+,/_=]*)\}|([%_-]))", re.IGNORECASE)
ESCAPES = {"%": "%", "_": " ", "-": "%20"}
ROUNDS = 4 * MAX_LOOKUPS

Address = ipaddress.IPv4Address | ipaddress.IPv6Address
Ask = Callable[[str, str], list[str]]


class Permanent(Exception):
    """The policy can't be followed."""


class Unknown(Exception):
    """Names (type, name) that have to be looked up first."""


def plain(ip: str) -> Address:
    address = ipaddress.ip_address(ip.strip())
    return getattr(address, "ipv4_mapped", None) or address


def dotted(ip: Address) -> str:
    """As the macro i shows it: IPv6 as its 32 hexadecimal digits."""
    return str(ip) if ip.version == 4 else ".".join(ip.exploded.replace(":", ""))


def reverse_name(ip: Address) -> str:
    """The name under which DNS keeps an address."""
    return ".".join(reversed(dotted(ip).split("."))) + (".in-addr.arpa" if ip.version == 4 else ".ip6.arpa")


class Check:
    """One sender against the policies that ``answers``, (type, name) to what DNS said, hold."""

    def __init__(self, ip: str, domain: str, answers: dict[tuple[str, str], list[str]], sender: str | None = None, helo: str | None = None):
        self.ip, self.answers, self.helo = plain(ip), answers, helo
        self.local, _, host = (sender or "").rpartition("@")
        self.local, self.sender_domain = self.local or "postmaster", host or domain
        self.kind = "A" if self.ip.version == 4 else "AAAA"
        self.lookups = self.void = 0
        self.named: str | None = None  # by ptr

    def ask(self, kind: str, name: str) -> list[str]:
        key = (kind, name.lower().rstrip("."))
        if key not in self.answers:
            raise Unknown([key])
        return self.answers[key]

    def count(self) -> None:
        self.lookups += 1
        if self.lookups > MAX_LOOKUPS:
            raise Permanent

    def found(self, answers: list[str]) -> list[str]:
        self.void += not answers
        if self.void > MAX_VOID:
            raise Permanent
        return answers

    def expanded(self, text: str, at: str) -> str:
        """With macros: a letter, how many labels from the right, whether reversed first, and what parts them."""
        values = {
            "s": f"{self.local}@{self.sender_domain}", "l": self.local, "o": self.sender_domain, "d": at, "i": dotted(self.ip), "p": self.named or "unknown", "v": "in-addr" if self.ip.version == 4 else "ip6", "h": self.helo or "unknown",
        }

        def one(m: re.Match) -> str:
            letter, digits, reverse, marks, escape = m.groups()
            if escape:
                return ESCAPES[escape]
            if letter.lower() not in values or digits and int(digits) == 0:
                raise Permanent
            parts = re.split("[" + re.escape(marks or ".") + "]", values[letter.lower()])
            parts = parts[::-1] if reverse else parts
            shown = ".".join(parts[-int(digits) :] if digits else parts)
            return quote(shown, safe="-_.!~*'()") if letter.isupper() else shown

        return MACRO.sub(one, text)

    def within(self, address: str, bits: str) -> bool:
        try:
            network = ipaddress.ip_network(f"{address}/{bits}" if bits else address, strict=False)
        except ValueError as wrong:
            raise Permanent from wrong
        return network.version == self.ip.version and self.ip in network

    def terms(self, record: str) -> Iterator[tuple[str, str, str, str]]:
        """(qualifier or "=", name, value, bits of this address's version)."""
        for term in record.split()[1:]:
            if m := re.fullmatch(r"([a-z][a-z0-9_.-]*)=(.*)", term, re.IGNORECASE):
                yield "=", m[1].lower(), m[2], ""
                continue
            m = re.fullmatch(r"([-+~?]?)([a-z0-9]+)(?::([^/]*(?:/(?![0-9/])[^/]*)*))?(?:/([0-9]{1,3}))?(?://([0-9]{1,3}))?", term, re.IGNORECASE)
            if m and m[2].lower() == "ip6":
                m = re.fullmatch(r"([-+~?]?)(ip6):([0-9a-f:.]+)(?:/([0-9]{1,3}))?()", term, re.IGNORECASE)
            if not m:
                raise Permanent
            yield m[1] or "+", m[2].lower(), m[3] or "", (m[4] if self.ip.version == 4 or m[2].lower() == "ip6" else m[5]) or ""

    def matches(self, name: str, value: str, bits: str, at: str, depth: int) -> bool:
        if name == "all":
            return True
        if name in ("ip4", "ip6"):
            try:
                version = ipaddress.ip_address(value).version
            except ValueError as wrong:
                raise Permanent from wrong
            if version != int(name[2]):
                raise Permanent
            return version == self.ip.version and self.within(value, bits)
        if name not in ("a", "mx", "ptr", "exists", "include") or not value and name in ("exists", "include"):
            raise Permanent
        self.count()
        target = self.expanded(value, at) if value else at
        if name == "a":
            return any(self.within(a, bits) for a in self.found(self.ask(self.kind, target)))
        if name == "mx":
            servers = self.found(self.ask("MX", target))
            if len(servers) > MAX_NAMES:
                raise Permanent
            return any(self.within(a, bits) for s in servers for a in self.found(self.ask(self.kind, s)))
        if name == "exists":
            return bool(self.found(self.ask("A", target)))
        if name == "ptr":
            for host in self.ask("PTR", reverse_name(self.ip))[:MAX_NAMES]:
                host = host.lower().rstrip(".")
                own = host == target.lower() or host.endswith("." + target.lower())
                if own and any(plain(a) == self.ip for a in self.found(self.ask(self.kind, host))):
                    self.named = host
                    return True
            return False
        result = self.check(target, depth + 1)
        if result in ("none", "permerror"):
            raise Permanent
        return result == "pass"

    def check(self, at: str, depth: int = 0) -> str:
        if depth > MAX_DEPTH or not 0 < len(at) <= 253:
            raise Permanent
        records = [r.strip() for r in self.ask("TXT", at) if re.match(r"v=spf1(\s|$)", r.strip(), re.IGNORECASE)]
        if len(records) != 1:
            if records:
                raise Permanent
            return "none"
        terms = list(self.terms(records[0]))
        for modifier in ("redirect", "exp"):
            if sum(q == "=" and n == modifier for q, n, _, _ in terms) > 1:
                raise Permanent
        for qualifier, name, value, bits in terms:
            if qualifier != "=" and self.matches(name, value, bits, at, depth):
                return RESULTS[qualifier]
        redirect = next((v for q, n, v, _ in terms if q == "=" and n == "redirect"), None)
        if redirect is None or any(q != "=" and n == "all" for q, n, _, _ in terms):
            return "neutral"
        self.count()
        result = self.check(self.expanded(redirect, at), depth + 1)
        if result == "none":
            raise Permanent
        return result


def spf(ip: str, domain: str, answers: dict[tuple[str, str], list[str]], sender: str | None = None, helo: str | None = None) -> str | list[tuple[str, str]]:
    """pass, fail, softfail, neutral, none or permerror; or the names that have to be looked up first."""
    try:
        return Check(ip, domain, answers, sender, helo).check(domain)
    except Unknown as asked:
        return asked.args[0]
    except (Permanent, ValueError):
        return "permerror"


def with_spf(mail: DataFrame, dns: DataFrame, *, ip: str = "remote_ip", domain: str = "mail_from_domain", sender: str | None = None, helo: str | None = None) -> DataFrame:
    """``mail`` with spf. ``dns``: name, type (TXT, A, AAAA, MX, PTR), answers. What isn't in it has no answer.

    Each distinct sender is checked once in a round. A round adds a name for every sender that is undecided, and a check ends
    after ten lookups with ten addresses each, so the rounds end. A mail without address or domain gets none."""
    part = lambda c: F.lit(None).cast("string") if c is None else F.col(c).cast("string")
    key = {"__ip": F.col(ip).cast("string"), "__domain": F.lower(domain), "__sender": part(sender), "__helo": part(helo)}
    told = "array<struct<type:string,name:string,answers:array<string>>>"
    senders = mail.select(*(v.alias(k) for k, v in key.items())).where("__ip IS NOT NULL AND __domain IS NOT NULL AND __domain <> ''").distinct()
    open_ = written(senders.withColumn("known", F.array().cast(told)), "spf-open")
    answers = dns.groupBy(F.upper("type").alias("type"), F.regexp_replace(F.lower("name"), r"\.$", "").alias("name")).agg(F.array_distinct(F.flatten(F.collect_list("answers"))).alias("answers"))
    done, names = None, list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                known = {(r["type"], r["name"]): list(r["answers"]) for r in row.known}
                said = spf(row[0], row[1], known, row[2], row[3])
                out.append((said, None, None) if isinstance(said, str) else (None, *said[0]))
            yield b.assign(**{c: [x[k] for x in out] for k, c in enumerate(("result", "type", "name"))})

    shape = ", ".join(f"`{c}` string" for c in names) + f", known {told}, result string, type string, name string"
    for _ in range(ROUNDS * MAX_NAMES):
        checked = written(open_.mapInPandas(run, shape), "spf-checked")
        decided = checked.where("result IS NOT NULL").select(*names, "result")
        done = decided if done is None else done.unionByName(decided)
        asking = checked.where("result IS NULL")
        if asking.isEmpty():
            break
        found = asking.join(answers, ["type", "name"], "left").withColumn("got", F.struct("type", "name", F.coalesce("answers", F.array().cast("array<string>")).alias("answers")))
        before, open_ = open_, written(found.select(*names, F.concat("known", F.array("got")).cast(told).alias("known")), "spf-open")
        delete(before)
    same = [v.eqNullSafe(F.col(f"__of{k}")) for k, v in key.items()]
    known = done.select(*(F.col(k).alias(f"__of{k}") for k in names), F.col("result").alias("__result"))
    rows = mail.drop("spf").join(known, on=[same[0] & same[1] & same[2] & same[3]], how="left")
    return rows.withColumn("spf", F.coalesce("__result", F.lit("none"))).drop("__result", *(f"__of{k}" for k in names))

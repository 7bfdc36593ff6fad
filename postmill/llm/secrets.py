"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. A ledger table holds the
findings of each (blob, rule version) pair that was scanned. A run scans only pairs that the
ledger lacks, appends them, and joins the findings back to every path that holds the blob.

Only DataFrame functions are used. A match's place is found without a UDF: ``split`` yields the
texts between the matches, ``regexp_extract_all`` the matches, and their lengths add up.

Defined results: a null text is the empty text and has no findings; a null path stays a path;
equal rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ._shared import fresh_path, table, written


@dataclass(frozen=True)
class Rule:
    """``least``: code points that ``group`` needs for a match to count. ``hint``: cheap test that any match passes."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


#: The kinds and patterns of the contract come first, in its order.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, r"(?i)(?:passw|secret|token|api_?key)[a-z]*[\"']?\x20*[:=]"),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
OWN_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, r"eyJ[A-Za-z0-9_-]+\.eyJ"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, "xox[abprs]-"),
)
RULES = BASE_RULES + OWN_RULES
RULE_VERSION = "2026-1"

SPAN = "struct<start:int,kind_no:int,end:int>"
CHUNK, FEW = 256, 64
LEDGER = f"blob string, rule_version string, spans array<{SPAN}>"


def _narrowed(rule: Rule) -> str:
    """A maximal run that is too short can be passed over at once; a failing assignment can't, as it uses up its text."""
    return rule.pattern[:-1] + "{%d,}" % rule.least if rule.kind == "hex" else rule.pattern


def rule_spans(text: Column, no: int, rule: Rule) -> Column:
    """The counting matches of one rule, leftmost first, as an array of spans; ends are exclusive."""
    pattern = F.lit(_narrowed(rule))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, _narrowed(rule), -1)

    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    matches = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found"), tested.alias("tested")), lambda m: m["found"].isNotNull())
    sized = F.transform(matches, lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["found"]).alias("long"), F.length(m["tested"]).alias("tested")))

    def spans(ms: Column) -> Column:
        ends = so_far(F.transform(ms, lambda m: m["gap"] + m["long"]), lambda x, y: x + y)
        span = lambda m, before: F.struct((before + m["gap"]).alias("start"), F.lit(no).alias("kind_no"), (before + m["gap"] + m["long"]).alias("end"))
        return F.filter(F.zip_with(ms, ends, lambda m, before: F.when(m["tested"] >= rule.least, span(m, before))), lambda x: x.isNotNull())

    return F.when(text.rlike(rule.hint), let(sized, spans)).otherwise(none)


def so_far(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of numbers, ``op`` over the values before it, from 0 on.

    Chunks come first, then the values of a place's own chunk, so that long arrays aren't gone through again for each place."""
    over = lambda part: F.aggregate(part, F.lit(0), op)

    def chunked(vs: Column) -> Column:
        count = F.ceil(F.size(vs) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: over(F.slice(vs, c * CHUNK + 1, F.lit(CHUNK))))
        heads = let(chunks, lambda cs: F.transform(cs, lambda _, c: over(F.slice(cs, F.lit(1), c))))
        own = lambda i: over(F.slice(vs, i - i % CHUNK + 1, i % CHUNK))
        return F.when(F.size(vs) > 0, let(heads, lambda hs: F.transform(vs, lambda _, i: op(F.get(hs, F.floor(i / CHUNK).cast("int")), own(i))))).otherwise(vs)

    return let(values, chunked)


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans of every rule by start, then in the order of the rules."""
    return F.array_sort(F.concat(*(rule_spans(text, no, rule) for no, rule in enumerate(rules))))


def _ledger(spark: SparkSession, path: str, rule_version: str) -> DataFrame:
    """blob and spans of each blob that was scanned by the rules, once, however often it was appended; none where nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(LEDGER).parquet(path) if exists else spark.createDataFrame([], LEDGER)
    return rows.where(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])


def scan_versions(versions: DataFrame, ledger_path: str, *, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the versions that the ledger at ``ledger_path`` lacks, then returns path, blob and spans of every version.

    ``versions`` has a row for each historical version of a path. The whole text moves once, dealt by
    (blob, path), so that a content with many copies isn't dealt to one task; where rows repeat in both,
    they become one row before they move. A run that dies before its append leaves the ledger as it was,
    and what two runs append twice is read once.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    named = written(spark, versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob")), "versions")
    pairs = named.groupBy("blob", "path").count()
    known = _ledger(spark, ledger_path, rule_version).select("blob")
    unseen = named.groupBy("blob").agg(F.min("path").alias("first_path")).join(known, "blob", "left_anti")
    texts = versions.select(F.col(path).alias("path"), F.sha2(body, 256).alias("of_blob"), body.alias("body"))
    if not pairs.where("count > 1").isEmpty():
        texts = texts.groupBy("path", "of_blob").agg(F.first("body").alias("body"))
    todo = texts.join(unseen.hint("shuffle_hash"), (F.col("of_blob") == F.col("blob")) & F.col("path").eqNullSafe(F.col("first_path")))
    found = todo.select("blob", F.lit(rule_version).alias("rule_version"), all_spans(F.col("body"), rules).alias("spans"))
    found.write.mode("append").parquet(ledger_path)
    return named.join(_ledger(spark, ledger_path, rule_version), "blob")


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind_no"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, and each run of overlapping spans, replaced by ``mark``."""

    def joined(ends: Column, cut: Callable[[Column, Column], Column]) -> Column:
        pieces = F.zip_with(spans, ends, lambda s, at: F.when(s["start"] >= at, F.concat(cut(at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(last, F.length(text)))

    by_place = lambda lo, hi: F.substring(text, lo + 1, hi - lo)
    ends = so_far(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    few = let(ends, lambda at: joined(at, by_place))
    # substring counts from the text's start each time, so texts with many spans are cut from an array of their characters
    many = let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda cs: let(ends, lambda at: joined(at, lambda lo, hi: F.array_join(F.slice(cs, lo + 1, hi - lo), ""))))
    return F.when(F.size(spans) > FEW, many).when(F.size(spans) > 0, few).otherwise(text)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "ledger"))
    base = F.filter(F.col("spans"), lambda s: s["kind_no"] < len(BASE_RULES))
    count = lambda no: F.size(F.filter(F.col("spans"), lambda s: s["kind_no"] == no)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(no).alias(f"n_{rule.kind}") for no, rule in enumerate(BASE_RULES)),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for no, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc, {no} AS kind_no, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS found, "
            f"regexp_extract_all(t, '{p}', {r.group}) AS tested, string_split_regex(t, '{p}') AS gaps FROM d"
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT doc, kind_no, kind, length(found[i]) AS n,
        list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS st
      FROM e WHERE length(tested[i]) >= least),
g AS (SELECT doc, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
        string_agg(kind || ':' || CAST(st AS BIGINT) || ':' || CAST(st + n AS BIGINT), ',' ORDER BY st, kind_no) FILTER (kind_no < {len(BASE_RULES)}) AS base,
        string_agg(kind || ':' || CAST(st AS BIGINT) || ':' || CAST(st + n AS BIGINT), ',' ORDER BY st, kind_no) AS spans
      FROM s GROUP BY doc)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc)"""


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL = {"op10_secret_scan": _sql()}

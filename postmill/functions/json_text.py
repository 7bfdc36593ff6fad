"""The first JSON object in free text: fences, balanced brackets outside strings, and one repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import text as T

#: What the automaton reads at once: an escaped character, a quote, a bracket, or a run of anything else.
TOKEN = r"\\(?s:.)|[\"{}]|[^\\\"{}]+|\\"
FENCE = r"```(?:json|JSON)?\s*((?s:.*?))```"


def parsed(text: Column) -> Column:
    """The text, or what a repair of commas before closing brackets and of single-quoted keys makes of it, if that is a JSON object or array; else null."""
    def valid(s: Column) -> Column:
        alone = lambda v: v.isNotNull() & (F.try_variant_get(v, "$[1]", "int") == 0) & F.try_variant_get(v, "$[2]", "variant").isNull()
        return s.rlike(r"^\s*[{\[]") & F.coalesce(T.let(F.try_parse_json(F.concat(F.lit("["), s, F.lit(",0]"))), alone), F.lit(False))  # a parser alone would pass over what follows

    repaired = F.regexp_replace(F.regexp_replace(text, r",\s*([}\]])", "$1"), r"([{,]\s*)'([^']+)'\s*:", '$1"$2":')
    return F.when(valid(text), text).otherwise(T.let(repaired, lambda r: F.when(valid(r), r)))


def balanced(tokens: Column, first: Column) -> Column:
    """The text from the bracket at place ``first`` of the tokens to the one that closes it; null if none does. Brackets in strings don't count."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(-1).alias("last"), F.lit(0).alias("no"))

    def step(s: Column, t: Column) -> Column:
        quote, open_ = (t == '"') & (s["last"] < 0), ~s["quoted"] & (s["last"] < 0)
        depth = s["depth"] + F.when(open_ & (t == "{"), 1).when(open_ & (t == "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["quoted"] != quote).alias("quoted"), F.when(open_ & (t == "}") & (depth == 0), s["no"]).otherwise(s["last"]).alias("last"), (s["no"] + 1).alias("no"))

    last = F.aggregate(F.slice(tokens, first + 1, F.size(tokens)), state, step, lambda s: s["last"])
    return T.let(last, lambda n: F.when(n >= 0, F.array_join(F.slice(tokens, first + 1, n + 1), "")))


def first_object(text: Column) -> Column:
    """The first JSON object of a text, as valid JSON: of a fenced block if there is one, the whole if it is JSON, else from the first bracket whose balanced text is JSON. Null without any."""
    whole = T.let(F.trim(text), lambda t: F.coalesce(F.nullif(F.trim(F.regexp_extract(t, FENCE, 1)), F.lit("")), t))

    def scanned(s: Column) -> Column:
        def of(tokens: Column) -> Column:
            opens = F.filter(F.transform(tokens, lambda t, i: F.when(t == "{", i)), lambda i: i.isNotNull())
            return F.aggregate(opens, F.lit(None).cast("string"), lambda known, i: F.when(known.isNotNull(), known).otherwise(parsed(balanced(tokens, i))))

        return F.coalesce(F.when(s.rlike(r"(?s)^[{\[].*[}\]]$"), parsed(s)), F.when(F.contains(s, F.lit("{")), T.let(F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0)), of)))

    return T.let(whole, scanned)


# Queries

def t50_balanced_json(spark: SparkSession, d: str) -> DataFrame:
    """The object of each event in the replies that models give: fenced, nested, with brackets in strings, with slips to repair, behind brackets that aren't JSON."""
    said = F.get(F.array(
        F.concat(F.lit("Sure: "), "props", F.lit(" as asked")), F.concat(F.lit('a "{" {"x": {"y": '), "props", F.lit('}, "s": "} {"} and }')), F.concat(F.lit("Sure!\n```json\n"), "props", F.lit("\n```\nHope {that} helps.")),
        F.concat(F.lit("not {this} but {'x': {'y': "), "props", F.lit(",},}")), F.concat(F.lit('{"open": '), "props"), F.lit("nonsense } {"),
    ), (F.col("event_id") % 6).cast("int"))
    found = first_object(said)
    rows = table(spark, d, "events").select("event_id", found.alias("json"))
    return rows.select("event_id", F.coalesce(F.get_json_object("json", "$.k"), F.get_json_object("json", "$.x.y.k")).cast("int").alias("k"), F.get_json_object("json", "$.s").alias("s"))


QUERIES = {"t50_balanced_json": t50_balanced_json}
ORACLE_SQL = {
    "t50_balanced_json": "SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS k, CASE WHEN event_id % 6 = 1 THEN '} {' END AS s FROM events",
}

"""Walsh-Hadamard audit of how filters interact.

A document's mask holds a bit for each filter that it fails. With k filters the table is read once for
2**k signed sums for each part and label: sum s counts a document as +1 where it fails an even number of the filters
in s, as -1 otherwise. The transform is its own inverse but for the factor 2**k, so whole numbers give the
number of documents of each mask back exactly, and these cells answer every order of the filters.
Shapley values need no orders: of all k! orders, a document that fails m filters is removed by each
of them in k! / m.

Whether a text has an earlier equal is told after rows are summed up by text: a text's rows that share
part and labels become one row (count, least id, rows of that id) before they move, so a text that
fills a third of the table is a few rows. Only sums reach the parts.

Defined results: a null text is empty; a null part is the part ""; a null id is smaller than none and fails no
filter for being a copy; rows of one id and text don't make each other copies; equal rows count each; a document has a
label if any row of ``labels`` gives it, rows of null ids aside; texts of any length are one row each; an empty table has no
parts and so no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACE_WORD, table

#: Fixed values of the contract.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
COPY = "E"  # the filter that looks at other documents


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on one text, by the filter's letter, over a text that isn't null."""
    words = F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def _parity(mask: Column, s: int) -> Column:
    return 1 - 2 * F.bit_count(mask.bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1))


def masks(docs: DataFrame, labels: DataFrame, own: dict[str, Column] | None = None, *, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Rows (part, good, toxic, mask, n): how many documents fail just the filters of a mask. Bits are in the order of the letters, copies last."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = conditions(F.col("text")) if own is None else own
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(found.values())), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), mask.alias("mask"))
    good, toxic = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.select(F.col(id_col).alias("of"), good.alias("good"), toxic.alias("toxic")).where(F.col("of").isNotNull() & (F.col("good") | F.col("toxic")))
    known = known.groupBy("of").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = rows.join(known, F.col("id") == F.col("of"), "left").drop("of").fillna(False, ["good", "toxic"])
    of_id = rows.groupBy("id", "hash", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))  # stays where the join has put it
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    of_text = of_id.groupBy("hash", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), least.alias("least"))
    # A text's rows are now as few as its parts and labels.
    classes = of_text.groupBy("hash", "mask").agg(F.min("least.id").alias("first"), F.collect_list(F.struct("part", "good", "toxic", "n", "unnamed", "least")).alias("classes"))
    classes = classes.select("mask", "first", F.inline("classes"))
    originals = F.col("unnamed") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    copy = 1 << len(found)
    both = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - originals).alias("n")))
    return classes.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def spectrum(counted: DataFrame, filters: int) -> DataFrame:
    """The 2**filters signed sums (array ``sums``) of each part and label."""
    sums = [F.sum(F.col("n") * _parity(F.col("mask"), s)).cast("long").alias(f"s{s}") for s in range(1 << filters)]
    found = counted.groupBy("part", "good", "toxic").agg(*sums)
    return found.select("part", "good", "toxic", F.array(*(f"s{s}" for s in range(1 << filters))).alias("sums"))


def cells(found: DataFrame, filters: int) -> DataFrame:
    """Of each part: the number of documents of each mask (arrays ``n``, ``good`` and ``toxic``, by mask), inverted from the sums."""
    size = 1 << filters
    inverse = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: (F.aggregate(
        F.zip_with("sums", F.sequence(F.lit(0), F.lit(size - 1)), lambda v, s: v * (1 - 2 * F.bit_count(m.bitwiseAND(s)).bitwiseAND(F.lit(1)))), F.lit(0).cast("long"), lambda a, b: a + b) / size).cast("long"))
    exact = found.select("part", "good", "toxic", inverse.alias("cells"))
    over = lambda weight: [F.sum(F.when(weight, F.col("cells")[m]).otherwise(0)) for m in range(size)]
    return exact.groupBy("part").agg(F.array(*over(F.lit(True))).alias("n"), F.array(*over(F.col("good"))).alias("good"), F.array(*over(F.col("toxic"))).alias("toxic"))


def _total(cell: str, holds) -> Column:  # noqa: ANN001
    """The sum of a part's cells whose mask ``holds``."""
    chosen = F.filter(cell, lambda _, m: holds(m))
    return F.aggregate(chosen, F.lit(0).cast("long"), lambda a, b: a + b)


def audit(docs: DataFrame, labels: DataFrame, own: dict[str, Column] | None = None, **columns: str) -> DataFrame:
    """A row for each part, order of the filters and step: what the step's filter removes there, and its Shapley value.

    ``own``: other failure conditions over the column ``text``, by one-letter names; copies are always the last filter, ``COPY``."""
    letters = [*(conditions(F.col("text")) if own is None else own), COPY]
    k = len(letters)
    parts = cells(spectrum(masks(docs, labels, own, **columns), k), k)
    share = F.array(F.lit(0), *(F.lit(factorial(k) // m) for m in range(1, k + 1)))  # orders in which a filter of m failed ones comes first
    of_mask = lambda bit: F.aggregate(F.transform("n", lambda v, m: F.when(m.bitwiseAND(F.lit(bit)) != 0, v * share[F.bit_count(m)]).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    parts = parts.select("part", "n", "good", "toxic", F.array(*(of_mask(1 << b) for b in range(k))).alias("values"))
    orders = parts.select("*", F.explode(F.lit(["".join(p) for p in permutations(letters)])).alias("filter_order"))
    steps = orders.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    # The bits of the step's filter and of those before it.
    bits = [F.when(F.instr("filter_order", x) < F.col("step"), 1 << b).otherwise(0) for b, x in enumerate(letters)]
    turn = [F.when(F.instr("filter_order", x) == F.col("step"), b).otherwise(0) for b, x in enumerate(letters)]
    steps = steps.select("*", sum(bits, F.lit(0)).alias("before"), sum(turn, F.lit(0)).alias("bit")).withColumn("own", F.expr("shiftleft(1, bit)"))
    passes = lambda m: m.bitwiseAND(F.col("before")) == 0
    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    here = lambda m: passes(m) & fails(m)
    return steps.select(
        "part", "filter_order", "step",
        _total("n", lambda m: passes(m) & ~fails(m)).alias("kept"), _total("n", here).alias("removed"), _total("n", lambda m: ~passes(m) & fails(m)).alias("redundant"),
        F.col("n")[F.col("own")].alias("unique_fails"), _total("good", here).alias("good_lost"), _total("toxic", here).alias("toxic_lost"), F.col("values")[F.col("bit")].alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def _sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w FROM documents),
f AS (SELECT doc_id, part, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e, len(w) < {MIN_WORDS} AS a,
    100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MAX_CAPITALS_PERCENT} * length(t) AS c, regexp_matches(t, '{SYMBOLS}') AS d FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
z AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS l, filter_order[:step - 1] AS before FROM o, range(1, 6) g(step)),
v AS (SELECT part, step, filter_order, l,
    coalesce(sum(n) FILTER (strlen(translate(fails, filter_order[:step], '')) = strlen(fails)), 0) AS kept,
    coalesce(sum(n) FILTER (contains(fails, l) AND strlen(translate(fails, before, '')) = strlen(fails)), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, l) AND strlen(translate(fails, before, '')) < strlen(fails)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = l), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, l) AND strlen(translate(fails, before, '')) = strlen(fails)), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(fails, l) AND strlen(translate(fails, before, '')) = strlen(fails)), 0) AS toxic_lost FROM m, z GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM v"""


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE_SQL = {"op11_filter_audit": _sql()}

"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, twice over. The virtual finish time of what is
served is the source's words up to and with it, divided by the source's target. All queues are
range-sorted into one stream by finish time, and the stream is cut where its running total meets the
total budget. A document is served whole, but for those around virtual time 1, where the cut falls:
they are served in packets of ``PACKET`` words, so that a source misses its target by about a packet,
however long its documents are. What the cut goes through is taken up to the cut.

No source meets in one task: running totals are over range-sorted parts (``running_totals``), for
the order within sources, for the sources themselves, and for the stream. The driver sees totals and
the place of the cut.

Defined results: a null text has size 0; a null source is a source of its own, the last; documents
of size 0 are taken 0; equal rows are told apart by nothing, so which of them is taken is
immaterial; an empty table gives an empty result; other columns are ignored by ``mix_plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import SPACE_WORD, remove, running_totals, table, written

WEIGHTS = (3, 1, 2)  #: Fixed values of the contract, by rank of the source, repeating.
BUDGET_SHARE, MAX_COPIES = 1.5, 2  #: Fixed values of the contract.
SEED = "mix-1"
PACKET = 32
NEAR = (0.9, 1.1)  # virtual times between which documents are served in packets


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) of each source to source_no, source_size, target, and ``before``, the sizes of the sources before it.

    A target is the lesser of ``copies`` times the source's size and its weight times a level that
    is the same for all. In the order of size by weight, those stopped by their size come first.
    """
    numbered = running_totals(sizes.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], "sources", source_no="one", upto="source_size")
    weight = F.get(F.array(*(F.lit(w) for w in weights)), ((F.col("source_no") - 1) % len(weights)).cast("int"))
    ranked = numbered.select("source", "source_no", "source_size", (F.col("upto") - F.col("source_size")).alias("before"), weight.alias("weight"), (copies * F.col("source_size")).alias("most"))
    ranked = written(sizes.sparkSession, ranked, "ranked")
    total, weights_total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = budget_share * total
    filled = running_totals(ranked, [F.col("most") / F.col("weight"), F.col("source_no")], "levels", sum_most="most", sum_weight="weight")
    level = (F.lit(budget) - F.col("sum_most") + F.col("most")) / (weights_total - F.col("sum_weight") + F.col("weight"))
    filled = written(sizes.sparkSession, filled.withColumn("stopped", F.col("most") <= level * F.col("weight")), "stopped")
    spent, left = filled.agg(F.coalesce(F.sum(F.when(F.col("stopped"), F.col("most"))), F.lit(0)), F.sum(F.when(~F.col("stopped"), F.col("weight")))).first()
    level = (budget - spent) / left if left else 0.0
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return filled.select("source", "source_no", "source_size", "before", target.alias("target"))


def packets() -> Column:
    """The packets of a row (size, source_size, target, upto), both copies: finish, copy, begin and words.

    ``upto`` is the source's words up to and with the document; the second copies follow the first."""
    first = F.col("upto") - F.col("size")

    def of(copy: int) -> Column:
        start = first + copy * F.col("source_size")
        near = (start / F.col("target") < NEAR[1]) & ((start + F.col("size")) / F.col("target") > NEAR[0])
        step = F.when(near, F.lit(PACKET).cast("long")).otherwise(F.col("size"))
        end = lambda b: F.least(b + step, F.col("size"))
        packet = lambda b: F.struct(((start + end(b)) / F.col("target")).alias("finish"), F.lit(copy).alias("copy"), b.alias("begin"), (end(b) - b).alias("words"))
        return F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step), packet)

    return F.when((F.col("size") > 0) & (F.col("target") > 0), F.concat(*(of(c) for c in range(MAX_COPIES))))


#: The order of the stream. ``upto`` tells equal rows of a source apart.
ORDER = ("finish", "shuffle", "source_no", "upto", "copy", "begin")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **options) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each row (id, size, source, source_size, target, taken), and the mix itself.

    The mix has a row for each packet before the cut, with finish, copy, begin and words; its parts (``part``) are the ranges of the sort."""
    spark = docs.sparkSession
    shuffle = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit(""))))), 1, 16)
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_WORD)).cast("long")
    sized = written(spark, docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size"), shuffle.alias("shuffle")), "sizes")
    goals = written(spark, targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **options), "targets")
    rows = sized.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    totals = running_totals(rows, [F.col(c) for c in ("source_no", "shuffle", "id")], "queues", upto="size")
    queued = written(spark, totals.withColumn("upto", F.col("upto") - F.col("before")).drop("before"), "queued")
    remove(spark, sized)

    order = [F.col(c) for c in ORDER]
    served = queued.select("id", "shuffle", "source_no", "upto", F.inline(packets()))
    stream = written(spark, served.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "stream")
    budget = int(options.get("budget_share", BUDGET_SHARE) * (goals.agg(F.sum("source_size")).first()[0] or 0))
    sums = stream.groupBy("part").agg(F.sum("words").alias("words")).withColumn("upto", F.sum("words").over(Window.orderBy("part")))  # a row for each part
    last = sums.where(F.col("upto") > budget).orderBy("part").first()
    if last is None:  # the budget takes all there is
        before, part_of = F.lit(True), lambda words, _: words
    else:
        total = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + (last["upto"] - last["words"])
        cut = stream.where(F.col("part") == last["part"]).withColumn("total", total).where(F.col("total") > budget).orderBy(*order).first()
        place = F.struct(*(F.lit(cut[c]).cast(stream.schema[c].dataType).alias(c) for c in ORDER))
        here = lambda key: F.struct(*(key(c).alias(c) for c in ORDER))
        before = here(F.col) <= place
        part_of = lambda words, key: F.when(here(key) < place, words).when(here(key) == place, words - (cut["total"] - budget)).otherwise(0)
    taken = F.aggregate("packets", F.lit(0).cast("long"), lambda sum_, p: sum_ + part_of(p["words"], lambda c: p[c] if c in ("finish", "copy", "begin") else F.col(c)))
    plan = queued.withColumn("packets", packets()).withColumn("taken", F.coalesce(taken, F.lit(0).cast("long")))
    mix = stream.where(before).select(F.col("id").alias(id_col), "finish", "copy", "begin", part_of(F.col("words"), F.col).alias("words"), "part")
    return plan.select(F.col("id").alias(id_col), "size", F.col("source").alias(source), "source_size", "target", "taken"), mix


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per document: the words that the mix takes of it, repeats counted."""
    return mix_plan(docs, **options)[0].drop(options.get("source", "source"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}')) AS BIGINT) AS size,
    substring(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 16) AS shuffle FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(source_no - 1) % {len(WEIGHTS)} + 1] AS weight, {MAX_COPIES} * source_size AS most FROM r),
v AS (SELECT *, {BUDGET_SHARE} * sum(source_size) OVER () AS budget,
    sum(most) OVER (ORDER BY most / weight, source_no ROWS UNBOUNDED PRECEDING) - most AS before,
    sum(weight) OVER (ORDER BY most / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
u AS (SELECT *, most <= (budget - before) / rest * weight AS stopped FROM v),
t AS (SELECT source, source_no, source_size, CASE WHEN stopped THEN CAST(most AS DOUBLE) ELSE
    CAST((budget - coalesce(sum(CASE WHEN stopped THEN most END) OVER (), 0)) AS DOUBLE) / sum(CASE WHEN NOT stopped THEN weight END) OVER () * weight END AS target FROM u),
x AS (SELECT row_number() OVER () AS row, doc_id, size, source_no, source_size, target, shuffle,
    CAST(sum(size) OVER (PARTITION BY source_no ORDER BY shuffle, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT x.*, copy, upto - size + copy * source_size AS start FROM x, (VALUES {', '.join(f'({c})' for c in range(MAX_COPIES))}) k(copy) WHERE size > 0 AND target > 0),
n AS (SELECT *, CASE WHEN start / target < {NEAR[1]} AND (start + size) / target > {NEAR[0]} THEN {PACKET} ELSE size END AS step FROM c),
p AS (SELECT *, unnest(range(0, size, step)) AS begin FROM n),
q AS (SELECT *, (start + least(begin + step, size)) / target AS finish, least(begin + step, size) - begin AS words FROM p),
z AS (SELECT row, words, sum(words) OVER (ORDER BY finish, shuffle, source_no, upto, copy, begin ROWS UNBOUNDED PRECEDING) AS total FROM q),
b AS (SELECT CAST(floor({BUDGET_SHARE} * sum(source_size)) AS BIGINT) AS budget FROM s),
g AS (SELECT row, sum(greatest(0, words - greatest(0, total - budget))) AS taken FROM z, b GROUP BY row)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM x LEFT JOIN g USING (row)"""


QUERIES = {"op4_mix": op4_mix}
ORACLE_SQL = {"op4_mix": _sql()}

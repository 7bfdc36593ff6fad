"""Joins and running sums by key, of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

SHARES = 1024  # a key's rows beyond one in so many are dealt out
LEAST = 4096


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, *, total: int, heavy: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``keyed``, whose ``key`` is unique; both name it alike.

    Keys of more than 1 / ``SHARES`` of the ``total`` rows, so fewer than ``SHARES``, are salted: their rows
    are dealt over as many salts as they hold such shares, and the row of ``keyed`` is repeated once for each.
    ``heavy``: (key, n) of all keys, where it is known already, else rows are counted."""
    share = max(LEAST, total // SHARES)
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if heavy is None else heavy
    hot = counts.where(F.col("n") > share).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / share).cast("int").alias("__salts"))
    hot = written(rows.sparkSession, hot.coalesce(1), "hot-keys")
    if hot.isEmpty():
        return rows.join(keyed, key, how)
    hot = F.broadcast(hot)  # fewer than SHARES rows of two numbers
    own = F.pmod(F.xxhash64(F.struct(*rows.columns)), F.coalesce("__salts", F.lit(1))).cast("int")
    salted = rows.join(hot, F.col(key) == F.col("__hot"), "left").select(*rows.columns, own.alias("__salt"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt")
    dealt = keyed.join(hot, F.col(key) == F.col("__hot"), "left").select(*keyed.columns, every)
    return salted.join(dealt, [key, "__salt"], how).drop("__salt")


def running_within(rows: DataFrame, key: str, order: list[str], tag: str, **amounts: Column) -> DataFrame:
    """``rows`` with running sums within their key up to and with each row, for each name of ``amounts``.

    Rows are range-sorted, so a key's rows may lie in several parts. A part goes on from at most one earlier key,
    so the sums to carry over are fewer than the parts."""
    by = [key, *order]
    placed = written(rows.sparkSession, rows.withColumns({f"__add_{n}": a for n, a in amounts.items()}).repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), tag)
    sums = placed.groupBy("__part", key).agg(*(F.sum(f"__add_{n}").alias(f"__sum_{n}") for n in amounts))
    upto = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col("__part").alias("__of"), F.col(key).alias("__key"), *(F.sum(f"__sum_{n}").over(upto).alias(f"__before_{n}") for n in amounts))
    carried = F.broadcast(carried.where(" OR ".join(f"__before_{n} IS NOT NULL" for n in amounts)))
    own = Window.partitionBy("__part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({f"__own_{n}": F.sum(f"__add_{n}").over(own) for n in amounts})
    joined = summed.join(carried, (F.col("__part") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(*rows.columns, *((F.col(f"__own_{n}") + F.coalesce(f"__before_{n}", F.lit(0))).alias(n) for n in amounts))


def dense_names(pairs: DataFrame, columns: list[str], start: int, tag: str) -> tuple[DataFrame, int]:
    """Each distinct value of ``columns`` with its number of rows ``n`` and a ``name``: whole numbers from ``start`` on without gaps. Also the next free number."""
    spark = pairs.sparkSession
    distinct = pairs.groupBy(*columns).agg(F.count("*").alias("n"))
    distinct = written(spark, distinct.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), tag)
    parts = distinct.groupBy("__part").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")  # a row for each part
    parts = parts.select(F.col("__part").alias("__of"), before.alias("__before"))
    named = distinct.join(F.broadcast(parts), F.col("__part") == F.col("__of")).select(*columns, "n", (F.col("__place") + F.col("__before") + F.lit(start)).alias("name"))
    return named, start + distinct.count()

"""Order over all rows without a task that sees all of them: parts of the range first, then places within one part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def part_of(rows: DataFrame, value: str, parts: int = PARTS) -> Column:
    """The part, from 0 on, that a number is in; parts ascend with it and hold about as many rows each. Equal numbers share a part, and a null is in the first.

    The borders are ``parts`` - 1 numbers, so the same row is always in the same part."""
    cuts = rows.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 100 * parts).alias("cuts")).first()["cuts"] or []
    borders = F.array(*(F.lit(c) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    return F.coalesce(F.size(F.filter(borders, lambda c: c < F.col(value))), F.lit(0))


def order_statistics(rows: DataFrame, keys: list[str], value: str, percents: dict[str, float], parts: int = PARTS) -> DataFrame:
    """For each group, under each name, the value at place min(n - 1, floor(n * percent / 100)) of its values in order, from 0 on; nulls aside.

    Counts of parts say in which part a place lies, and of this part each distinct value is one row, so a group, or a value, that fills the table is in no
    task as a whole."""
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    known = known.withColumn("__part", part_of(known, "__v", parts))
    by_key = Window.partitionBy(*keys)
    sizes = known.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumns({"__upto": F.sum("__n").over(by_key.orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)), "__all": F.sum("__n").over(by_key)})
    place = lambda p: F.least(F.col("__all") - 1, F.floor(F.col("__all") * p / 100))
    wanted = sizes.select(*keys, "__part", "__upto", "__n", F.inline(F.array(*(F.struct(F.lit(name).alias("__name"), place(p).cast("long").alias("__at")) for name, p in percents.items()))))
    wanted = wanted.where("__at < __upto AND __at >= __upto - __n").select(*keys, "__part", "__name", (F.col("__at") - F.col("__upto") + F.col("__n")).alias("__at"))
    values = known.join(wanted.select(*keys, "__part").distinct(), [*keys, "__part"], "left_semi").groupBy(*keys, "__part", "__v").agg(F.count("*").alias("__m"))
    ranked = values.withColumn("__to", F.sum("__m").over(Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    found = wanted.join(ranked, [*keys, "__part"]).where("__at < __to AND __at >= __to - __m")
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in percents))

"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import atexit
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules["postmill"])

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Fixed value of the contract: letters and digits, and anything beyond ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed value of the contract: everything but ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[str] = []  # folders of intermediate tables that this driver has written and not yet deleted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session uses its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A folder of its own for a table, deleted by ``sweep``, at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/postmill/{tag}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read again.

    The table is deleted by ``remove`` or ``sweep``, at the latest when the driver ends."""
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folders(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files behind a table that ``written`` made, once nothing reads it any more."""
    own = _folders(df)
    for path in [p for p in _scratch if p.rsplit("/", 1)[1] in own]:
        _scratch.remove(path)
        _delete(spark, path)


def sweep(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the intermediate tables from number ``since`` on, but not the one behind ``keep``."""
    kept = _folders(keep) if keep is not None else set()
    for path in [p for p in _scratch[since:] if p.rsplit("/", 1)[1] not in kept]:
        _scratch.remove(path)
        _delete(spark, path)


def mark() -> int:
    """The number of the next intermediate table, for ``sweep``."""
    return len(_scratch)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context is not None and _scratch else None
    if spark is not None:
        sweep(spark)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str, *, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` through ``run``, which takes and returns Arrow batches: all columns but ``dropped``, whatever their names, then those of ``added``."""
    names, kept = rows.columns, [c for c in rows.columns if c not in dropped]
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    new = StructType.fromDDL(added).fieldNames()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(names) for x in batches):
            yield b.rename_columns([plain[c] for c in kept] + new)

    ddl = ", ".join([f"{plain[c]} {kinds[c]}" for c in kept] + [added])
    return rows.toDF(*plain.values()).mapInArrow(inner, ddl).toDF(*kept, *new)


def running_totals(rows: DataFrame, order: list[Column], tag: str, **amounts: str) -> DataFrame:
    """``rows`` with a running total up to and with each row, in a range-sorted order, for each name of ``amounts``.

    Totals are two-level: those of the sorted parts, as many as there are shuffle partitions, and rows
    within a part. ``order`` must tell all rows apart whose amounts differ.
    """
    placed = written(rows.sparkSession, rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), tag)
    parts = placed.groupBy("__part").agg(*(F.sum(a).alias(f"__sum_{n}") for n, a in amounts.items()))
    upto = Window.orderBy("__part")  # a row for each part
    parts = parts.select(F.col("__part").alias("__of"), *((F.sum(f"__sum_{n}").over(upto) - F.col(f"__sum_{n}")).alias(f"__before_{n}") for n in amounts))
    own = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumns({f"__own_{n}": F.sum(a).over(own) for n, a in amounts.items()}).join(parts, F.col("__part") == F.col("__of"))
    return summed.select(*rows.columns, *((F.col(f"__own_{n}") + F.col(f"__before_{n}")).alias(n) for n in amounts))


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Texts can be long, so fewer of them go into an Arrow batch than by default. The session keeps the setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= most:
        spark.conf.set(name, str(most))

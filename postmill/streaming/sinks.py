"""Write-back of a feed as sinks for ``foreachBatch``, so that a batch that is run again changes nothing.

A table is a folder of Parquet files, partitioned by the id of the batch that wrote them. A batch looks at what earlier batches
have stored, never at its own or later ones, and overwrites its own partition; run again, it writes the same rows to
the same place. What holds of a key is what its latest batch says. ``compacted`` folds the past into one partition of a new folder.

Defined results: of rows of one batch with equal keys the first in the order of ``order`` counts; rows with a null in a key can't be
told apart, so ``insert_new`` stores each of them and the others drop them; an empty batch leaves an empty partition or none.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BATCH = "batch_id"


@dataclass(frozen=True)
class Table:
    """``schema``: the columns of a row, without the batch's id. ``order``: columns that say which of a batch's rows of one key is the first."""

    path: str
    schema: StructType
    keys: list[str]
    order: list[str] = field(default_factory=list)

    def history(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """All stored rows with the id of their batch, or those of batches before one."""
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        whole = StructType([*self.schema.fields, StructField(BATCH, LongType())])
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], whole)
        rows = spark.read.schema(whole).parquet(self.path)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """For each key the rows of the latest batch that has it."""
        rows = self.history(spark, before)
        latest = F.max(BATCH).over(Window.partitionBy(*self.keys))
        return rows.withColumn("__latest", latest).where(F.col(BATCH) == F.col("__latest")).drop("__latest")

    def first_of_key(self, batch: DataFrame) -> DataFrame:
        rows = batch.select(*self.schema.fieldNames())
        if not self.order:
            return rows.dropDuplicates(self.keys)
        nth = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*self.order))
        return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")

    def store(self, rows: DataFrame, batch_id: int) -> None:
        """Overwrites the batch's partition, and no other."""
        out = rows.select(*self.schema.fieldNames(), F.lit(batch_id).cast("long").alias(BATCH))
        out.write.partitionBy(BATCH).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)

    def insert_new(self, batch: DataFrame, batch_id: int) -> None:
        """Rows whose key no earlier batch has stored; the others are left as they are."""
        has_key = " AND ".join(f"`{k}` IS NOT NULL" for k in self.keys)
        known = self.history(batch.sparkSession, batch_id).select(*self.keys)
        fresh = self.first_of_key(batch.where(has_key)).join(known, self.keys, "left_anti")
        self.store(fresh.unionByName(batch.where(f"NOT ({has_key})").select(*fresh.columns)), batch_id)

    def merge(self, batch: DataFrame, batch_id: int, kept: tuple[str, ...] = ()) -> None:
        """The batch's row of each key takes the place of the stored one; in columns of ``kept`` a null leaves what was there."""
        rows = self.first_of_key(batch.dropna(subset=self.keys))
        old = self.current(batch.sparkSession, batch_id).select(*self.keys, *(F.col(c).alias(f"__{c}") for c in kept))
        value = lambda c: F.coalesce(c, f"__{c}").alias(c) if c in kept else F.col(c)
        self.store(rows.join(old, self.keys, "left").select(*(value(c) for c in self.schema.fieldNames())), batch_id)

    def replace_rows(self, batch: DataFrame, batch_id: int) -> None:
        """All of the batch's rows of a key (of a parent, say) take the place of all stored ones."""
        self.store(batch.dropna(subset=self.keys), batch_id)

    def compacted(self, spark: SparkSession, path: str, upto: int) -> Table:
        """The same table in another folder, with the batches before ``upto`` as one partition and later ones as they are."""
        past = self.current(spark, upto).withColumn(BATCH, F.lit(upto - 1).cast("long"))
        past.unionByName(self.history(spark).where(F.col(BATCH) >= upto)).write.partitionBy(BATCH).parquet(path)
        return Table(path, self.schema, self.keys, self.order)


@dataclass(frozen=True)
class WriteBack:
    """Results of messages: a batch's row for each message replaces the stored one, and its attachments replace the message's, both under one batch id.

    Attachments are written first. A message shows those of the batch that its own row is of, so it is never seen with half of them."""

    messages: Table
    attachments: Table

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropna(subset=self.messages.keys).dropDuplicates(self.messages.keys).persist()
        try:
            rows = batch.select(*self.messages.keys, F.explode("attachments").alias("a")).select(*self.messages.keys, "a.*")
            self.attachments.replace_rows(rows, batch_id)
            self.messages.merge(batch, batch_id)
        finally:
            batch.unpersist()

    def current(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """Messages, and the attachments that belong to them now."""
        messages = self.messages.current(spark)
        return messages, self.attachments.history(spark).join(messages.select(*self.messages.keys, BATCH), [*self.messages.keys, BATCH], "left_semi")

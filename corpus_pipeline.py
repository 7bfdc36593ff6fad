"""A corpus pipeline over the table ``documents``: five stages, each written and read again by the next.

Every stage but the last returns the columns of its input. Stages work on all rows that their
predecessors kept: toxic documents go, one document of each near-duplicate group stays, contaminated
documents go, secrets in texts are masked, and the last stage says how many words the mix takes of
each document.

Defined results: nulls, empty texts, repeated rows and empty tables are treated as the operators
in ``postmill.llm`` state. Texts that aren't near-duplicates all stay, whether or not they share an id.
A stage's intermediate tables and its input go once its output is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm import decontamination, mixing, secrets, simhash, toxicity
from postmill.llm._shared import fresh_path, mark, sweep, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model of the labelled documents finds toxic."""
    model = toxicity.train_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id (null last) of each group of texts that are similar on five-word shingles.

    Rows are told apart by id and text, so unrelated texts under one id each count; of equal ones, one stays."""
    row = F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")
    groups = written(spark, simhash.similar_groups(docs), "groups")
    first = groups.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("n"))
    first = first.select(F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash"), F.col("n").alias("__n"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    kept = docs.join(first.hint("shuffle_hash"), same)  # sorting the texts for a merge join would spill
    twice = written(spark, groups.groupBy("id", "text_hash").count().where("count > 1"), "repeated")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    equal = F.struct(*docs.columns)
    again = kept.where("__n > 1").groupBy("__id", "__hash").agg(F.min_by(equal, F.to_json(equal)).alias("row"))
    return kept.where("__n = 1").select(*docs.columns).unionByName(again.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in a text replaced by a mark, and n_chars as it then is."""
    found = secrets.scan_versions(docs.select("doc_id", "text"), fresh_path(spark, "ledger")).where(F.size("spans") > 0)
    found = found.select(F.col("path").alias("__path"), F.col("blob").alias("__blob"), F.col("spans").alias("__spans")).dropDuplicates(["__path", "__blob"])
    body = F.coalesce(F.col("text"), F.lit(""))
    same = F.col("doc_id").eqNullSafe(F.col("__path")) & (F.sha2(body, 256) == F.col("__blob"))
    joined = docs.join(found.hint("shuffle_hash"), same, "left")
    hit = F.col("__spans").isNotNull()
    joined = joined.withColumn("text", F.when(hit, secrets.redacted(body, F.col("__spans"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: the words that the mix takes of it, repeats counted."""
    return mixing.taken_words(docs.select("doc_id", "text", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("mixing", mix),
]

#: The toxicity model and SimHash can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(spark, docs, f"stage{n + 1}")
            sweep(spark, since, keep=docs)
    return docs

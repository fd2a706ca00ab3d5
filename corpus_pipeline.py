"""Corpus pipeline: toxicity, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; ``n_chars`` follows the text where lines are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from creditflow.llm import bag_minhash, decontaminate, line_dedup, packing, toxicity
from creditflow.llm.storage import broadcast_if_small, stored

#: SQL has no tokenizer, so it can't state the packed rows; tests hold every stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, learned as in op8."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out("doc_id", 3, 1))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that repeat an earlier one; a text may become empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    gone = line_dedup.lines_by_row(line_dedup.duplicate_lines(rows.where("id is not null and text is not null")))
    row = docs.select(F.struct("*").alias("row"))  # whatever its columns are called
    kept = row.join(gone, (F.col("row.doc_id") == F.col("id")) & (F.hash("row.text") == F.col("tag")), "left")
    text = line_dedup.without_lines(F.col("row.text"), F.col("gone"))
    new = {"text": text, "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text).cast("long"))}
    return kept.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates."""
    classes = bag_minhash.near_duplicates(docs)
    later = stored(classes.where("doc_id <> class_id").select("doc_id").distinct(), "later")
    return docs.join(broadcast_if_small(later), "doc_id", "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 ids."""
    return packing.pack(docs, packing.public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what lies between them is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

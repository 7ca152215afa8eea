"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the
last return the columns of `documents`.  The driver of a job writes each stage's rows as Parquet
and reads them again; run() cuts the lineage between stages in the shared folder instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, packing, quality, secret_scan
from tessera.llm.cutting import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a probability of at least one half of being good, learned from `labels`."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs.select(*COLUMNS), labels, least=0.5, label="quality")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows that repeat a doc_id are copies too, and one of them stays; rows without doc_id all stay.
    """
    groups = jaccard.jaccard_components(docs, n=5, num=80, den=100)
    kept = groups.where("component_id = doc_id").select("doc_id").distinct()
    one = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "source", "lang")))
    first = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumn("nth", one).where("nth = 1").select(*COLUMNS)
    return first.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; n_chars is that of the text that is left."""
    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document 0, 1 or 2 times, so that sources come to their targets."""
    return mixing.take_copies(docs.select(*COLUMNS), mixing.mix(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all documents' pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, length=2048)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs


#: SQL can express no stage whole; the tests hold each against a plain version.
ORACLE_SQL = None

"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

toxicity: documents that the classifier rejects go. lines: boilerplate lines of a site go, copies of
a page counting as one. near_copies: of documents
linked by 5-word shingles at a Jaccard similarity of 0.8, the one with the smallest id stays. passages: words covered by
a passage of 50 words that starts earlier go. packing: what is left is cut and packed into sequences of 1,024 tokens.

Cases: of repeated rows (one id and one text) one stays in near_copies, as of any group of copies; documents with a null or empty text pass every stage, as nothing speaks against them, and are packed as their end
id; documents without an id are never near copies of others; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.llm import jaccard, lines, packing, substring, toxicity
from causeway.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars as the text is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    toxic = scored.where("predicted = 1").select(F.col("doc_id").alias("toxic_id")).distinct()
    return documents(docs.join(toxic, F.col("doc_id") == F.col("toxic_id"), "left_anti"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return documents(lines.line_dedup(docs, ratio=0.05, least_pages=3, copies=0.8))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = jaccard.jaccard_components(docs, jaccard.Rule(n=5, num=80, den=100))
    copies = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id")).distinct()
    kept = docs.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")
    again = docs.groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1 and again_id is not null").select("again_id")
    if not again.isEmpty():
        again = written(again, "again")
        twice = F.col("doc_id") == F.col("again_id")
        kept = kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
    return documents(kept)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return documents(substring.substring_dedup(docs, k=50))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_boilerplate),
    ("near_copies", keep_one_of_near_copies),
    ("passages", drop_passages),
    ("packing", pack),
]

#: A trained classifier is the first stage, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``; columns beyond those that a stage reads are
carried along, whatever their names. An empty table passes through every stage. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import jaccard, packing, quality, substring_dedup, toxicity
from quayside.llm.common import apart, held_out, order_id, read, ship
from quayside.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

SHINGLE = 5  # words


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labelled documents outside the held-out fold. Null and
    empty texts hold no term and stay; repeated rows are scored alike."""
    ship(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out())
    return apart(docs, ["text"], lambda d: toxicity.score(d, model).where(F.col("toxicity") < toxicity.THRESHOLD))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and look like their language. Null and empty texts fail the base rules; a
    document of a null or unlisted language is judged by those alone; repeated rows are judged alike."""
    ship(spark)
    return apart(docs, ["text", "lang"], lambda d: quality.judge(d).where("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id, null ids first; of rows equal in id and text one.
    SimHash and MinHash give candidates, and documents are near duplicates where their sets of five-word shingles have
    a Jaccard similarity of 0.8 or more, compared exactly. Texts without words are duplicates of each other."""
    ship(spark)
    classes = jaccard.near_duplicates(docs, SHINGLE)
    first = classes.groupBy("class_id").agg(F.min(F.struct(order_id().alias("oid"), "rk")).alias("f")).select("f.*")

    def keep(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("oid", order_id()).withColumn("rk", F.hash("doc_id", "text"))
        return keyed.join(first, ["oid", "rk"], "left_semi").dropDuplicates(["oid", "rk"])

    return apart(docs, ["doc_id", "text"], keep)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier one holds; their texts' other words are joined by
    one space, and texts without such passages stay as they are. Documents with nothing left go."""
    ship(spark)
    return apart(docs, ["doc_id", "text"], substring_dedup.without_passages)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences; a null or empty text is one end token."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

# Learned weights and components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""From raw documents to packed sequences: toxic documents go, one of each near-duplicate group stays, passages that
repeat earlier ones are cut out, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoquilt.llm import chunkdedup, neardup, packing, toxicity
from genoquilt.llm.common import cut, table
from genoquilt.llm.queries import WORDS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.7; the model is fitted on the labelled rows outside the held-out third. Null and empty texts score
    like texts without toxic words and stay, as do repeated rows and null ids; an empty table stays empty."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at five-word shingles and 0.8, that with the smallest id. Rows are told apart by id and
    text, so a shared id loses no text; of rows that repeat both one stays. Texts without words all stay."""
    return neardup.keep_one(docs, k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; n_chars follows. All rows stay; null texts and rows with
    a null id stay as they are."""
    out = chunkdedup.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, from every row: null and empty texts are their end id alone, repeated rows and null
    ids are packed each, an empty table gives no rows."""
    return packing.pack_documents(docs, WORDS, capacity=4096, end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: Tokenising and hashing go beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name, by_spark=True)  # stages end in Python workers
    return docs

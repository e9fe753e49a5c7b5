"""A training corpus from raw documents: five stages over tables of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next stage's docs. All but the
last return the columns of documents. A stage that filters drops whole rows and
leaves all others as they are; line dedup changes text and n_chars only.

Rows are judged by id and text together, so that two texts of one doc_id are two
documents. Near duplicates keep one row of each group: the smallest id, then the smallest
hash of its text, then the smallest columns in their order; repeated rows are a group.
Rows without a doc_id pass that stage, as nothing says which of them came first, and are
judged like others by the rest. Rows with null or empty text fall to the quality rules;
texts of any length are read whole. Empty tables give empty results of the same columns.
Extra columns are kept to the last stage; their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import decontaminate, linededup, ngram_join, packing, quality
from meshloom.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of policy v1 rejects."""
    return quality.keep_passing(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites."""
    out = linededup.strip_boilerplate(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard
    similarity of 0.8 or more), that with the smallest id."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 ids."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Packing is not expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: quality, exact copies, near copies, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.exact_dedup import exact_dedup
from ledgerloom.llm.mixing import mixed
from ledgerloom.llm.near_dedup import near_dedup
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.quality import fit_quality, held_out, keep_good
from ledgerloom.session import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least 0.3 stay; held-out labels are not learned from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out())
    return keep_good(docs, fit_quality(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per normalised text stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return mixed(docs)


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences, which follow the written order of the mixture."""
    return pack_documents(docs, order=[F.col("_metadata.file_name"), F.col("_metadata.row_index")])


STAGES = [
    ("quality classifier", quality), ("exact dedup", exact), ("minhash near dedup", near),
    ("mixing to target weights", mix), ("best-fit packing", packs),
]

#: SQL expresses neither the classifier nor the packing; tests hold the stages' operators, one by one, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

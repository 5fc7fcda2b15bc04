"""The corpus pipeline: its stages in order, and their composition.

Every stage takes nulls in any column, empty and very long texts, ties, repeated
rows, empty tables and further columns of any name; an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions.session import drop_written, written
from meshwright.llm.mixing import mixture
from meshwright.llm.neardup import without_near_duplicates
from meshwright.llm.packing import packs
from meshwright.llm.secrets import without_secrets
from meshwright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go.

    Null and wordless texts score 0 and stay, rows without a doc_id and repeated
    rows are judged each; without labels of both kinds nothing goes.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least doc_id.

    Null texts are near nothing, wordless ones near equal ones alone; rows without
    a doc_id stay; rows of a doc_id that are equal in all columns become one.
    """
    return without_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, and n_chars follows; no document goes.

    Null and empty texts and null n_chars stay as they are; rows without a doc_id
    and repeated rows are masked each.
    """
    masked = without_secrets(docs)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample brings the sources to their target weights.

    A document is a doc_id: its repeated rows stay or go together, rows without
    one go; a null source is a source, and texts without tokens count as documents.
    """
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the documents that stayed is in one packed sequence.

    Null, empty and blank texts have no tokens and are in none; repeated rows and
    rows without a doc_id are packed each; long texts fill sequences of their own.
    """
    return packs(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near-duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("source mix", source_mix),
    ("packing", packing),
]

#: The stages learn, search and draw at random; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what its predecessor wrote, which then goes."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        made.append(docs)
        for superseded in made[:-1]:
            drop_written(superseded)
        del made[:-1]
    packs = STAGES[-1][1](spark, docs, sf_dir)  # has read the documents' lengths, and needs no more of them
    drop_written(docs)
    return packs

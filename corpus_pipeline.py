"""Training-data pipeline over ``documents``: quality rules, quality classifier, exact deduplication, near-duplicates, packing.

Each stage is one operator of :mod:`tempolane.llm`; its decisions take effect on the rows that the stage before it kept, and its
result is written as Parquet and read again as the next one's documents. All but the last return the columns of documents.

Decisions belong to rows, not to ids: see :func:`tempolane.llm.shared.keyed`. Defined results: a null text is an empty one and
goes with the quality rules; null and repeated ids are kept apart row by row; of rows equal in every column one stays; an empty
table gives an empty result; additional columns pass through to the packing, where they are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempolane.llm.classifier import classify
from tempolane.llm.exact import exact_duplicates
from tempolane.llm.near import near_duplicates
from tempolane.llm.packing import best_fit
from tempolane.llm.queries import BYTE_PATTERN, BYTE_RANKS
from tempolane.llm.rules import quality_rules
from tempolane.llm.shared import delete, keep_rows, keyed, materialise, noted, read, small_batches

#: A stage's function takes (spark, docs, sf_dir) and returns a DataFrame.


def stage_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    with small_batches(spark):
        rows = keyed(docs)
        return keep_rows(rows, quality_rules(rows, id_col="_key"))


def stage_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of the rows at hand, predicts to be good."""
    with small_batches(spark):
        rows = keyed(docs)
        return keep_rows(rows, classify(rows, read(spark, sf_dir, "labels"), carry="_key"), kept_col="predicted")


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    with small_batches(spark):
        rows = keyed(docs)
        return keep_rows(rows, exact_duplicates(rows, id_col="_key"), single=True)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    with small_batches(spark):
        rows = keyed(docs)
        return keep_rows(rows, near_duplicates(rows, id_col="_key"), single=True)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and the bins that hold them."""
    with small_batches(spark):
        return best_fit(docs, BYTE_RANKS, BYTE_PATTERN)


STAGES = [
    ("quality rules", stage_rules),
    ("quality classifier", stage_classifier),
    ("exact dedup", stage_exact),
    ("near duplicates", stage_near),
    ("best-fit packing", stage_packing),
]

#: The classifier, the sketches and the packing are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's own tables are deleted when its result is written; the result stays."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with noted() as made:
            kept = stage(spark, docs, sf_dir)
        docs = materialise(kept, "stage-" + name.replace(" ", "-"))
        delete(spark, made)
    return STAGES[-1][1](spark, docs, sf_dir)

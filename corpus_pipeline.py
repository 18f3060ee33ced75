"""A corpus from documents: five stages, each a table of all that the one before kept.

toxicity          documents whose restored text scores at least a half go
line_dedup        passages, then multi-line chunks, that an earlier place has go from the texts;
                  documents that would keep less than LEAST_LEFT of their characters go whole
near_duplicates   of documents linked by similar five-word shingles one stays
decontamination   documents in which a benchmark window occurs go
packing           what is left is packed into sequences of 2048 tokens

A stage defines its results for null, empty, repeated and very long rows as its
operator does; an empty table passes through as an empty one. Columns beyond those of
`documents` pass through the first four stages untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coppice.llm import decontamination, line_dedup, near_copies, packing, toxicity
from coppice.plans.storage import drop, materialize, table

#: The share of its characters that a document keeps at least when passages are taken out.
LEAST_LEFT = 0.25


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(materialize(line_dedup.without_passages(docs, LEAST_LEFT), "without-passages"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained toxicity model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage has read is deleted once its own table is there."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
            if k > 1:
                drop(before)
    return docs

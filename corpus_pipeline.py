"""From documents to packed sequences: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstack.llm import mixing, packing, pii, simhash, toxicity
from quillstack.llm.common import freed, stored, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores under the threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), held_out=toxicity.is_held_out()))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates."""
    return simhash.keep_first(docs)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document and pass that takes words of it, its text those words."""
    return mixing.mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids. Workers that other stages share remember fewer words than packing alone would."""
    return packing.pack(docs, remembered=300_000, with_ids=True)


STAGES = [("toxicity", _toxicity), ("simhash_near_dedup", _near_dedup), ("pii", _pii), ("mixing", _mixing), ("packing", _packing)]

#: A trained classifier, a fixpoint over links and tokenizer ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before has written: packed pieces with their ids.

    Rows with a null text or id pass through as the stages say; an empty table gives an empty one. Repeated rows are one document after near-dedup, as are near copies, of which the smallest id stays (of rows of one id the one
    of the least text hash); rows with a null id all stay. Long texts are worked on whole. Columns pass through whatever their names; the stages look only at doc_id, text and source, and at n_chars where a text changes.
    What a stage stores on its way is removed when it is done.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with freed(spark):
            docs = stored(stage(spark, docs, sf_dir), name)
    return docs

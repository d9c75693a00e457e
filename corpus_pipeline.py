"""The corpus pipeline: documents to packed token sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the columns of documents; the last one
returns the packed pieces.  run() writes each result as Parquet to shared storage and reads it again, so that a stage never
recomputes an earlier one.

The stages share one session, whose executors and Python workers keep much of what the largest batch of texts took.  So the stages that use Python bound
their batches to BATCH_BYTES, for the session: the last step of a stage runs only when the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import common, jaccard_join, packing, quality, secrets, toxicity

#: Bytes of rows that a Python worker gets at once; a longer row goes alone.
BATCH_BYTES = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep.

    A null or empty text has no words and goes; a null source counts as the empty one; repeated rows stay or go together; other columns stay as they are, whatever they
    are called; an empty table stays empty.  A text of any length is counted whole."""
    return quality.keep_good(docs)


def toxic_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic, by a field fitted on labelled documents among `docs`.

    Labels are known but for held-out ids.  Without labelled documents of both classes all score alike and stay.  A null or empty text has the lowest score and stays;
    repeated rows stay or go together; other columns stay as they are; an empty table stays empty.  A text of any length is scored whole."""
    common.bound_batches(spark, BATCH_BYTES)
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id.

    Of rows that share a doc_id and a text one stays; rows without a doc_id, and texts without words, are alike with nothing and stay; other columns stay as they are;
    an empty table stays empty."""
    common.bound_batches(spark, BATCH_BYTES)
    return jaccard_join.keep_heads(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark; n_chars follows where a text has changed.

    A null text stays null; repeated rows change alike; other columns stay as they are; an empty table stays empty.  A text of any length is scanned whole."""
    return secrets.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences: op1's rows.

    A null or empty text is a piece of the end id alone; repeated rows are packed one by one; a null doc_id stays null; an empty table gives none."""
    common.bound_batches(spark, BATCH_BYTES)
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_spans),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the field, the join's scale or the packing; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

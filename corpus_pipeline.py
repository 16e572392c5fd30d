"""Cleans the table of documents: toxic texts, near copies and benchmark leaks go, secrets are masked, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next stage's docs. All but the last
return the columns of ``documents``. Null and empty texts pass every stage (as far as
they are not copies of one another), repeated rows share their fate but for the one that
near copies leave, an empty table passes as one, and further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakecairn.llm import bpe, decontaminate, secrets, simhash, toxicity
from lakecairn.llm.common import drop_written, only_result, table, written

#: Stages judge by learned models, fingerprints and token ids, which SQL cannot express; brute-force versions test them.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression-distance model, fitted on the labelled rows of docs, doesn't take for toxic."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked fingerprints."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a full benchmark window and with less than a twentieth of their words in windows of short items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets of few repositories and owners masked in their texts."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every remaining text."""
    return bpe.encode(docs, *bpe.vocabulary(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with only_result() as keep:
            out = keep(written(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if k:  # what the stage has read, a table of its predecessor
            drop_written(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)

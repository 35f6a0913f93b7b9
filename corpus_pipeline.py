"""A training corpus from documents, in stages that each call one operator.

toxicity        documents that the classifier holds toxic go
exact_dedup     one row of each group of equal texts stays
ngram_join      one row of each group of near duplicates stays
curriculum_mix  documents that the mix takes stay, range-sorted by training position; one that it takes
                several times occurs as often
sentencepiece   the documents' token ids

Defined results, in each stage: a null text counts as empty; rows that repeat whole are copies, of which one stays in
exact_dedup; null ids lose against others where one row of a group stays; further columns are kept as they are, whatever their
names; an empty table gives an empty result.

Each stage reads all that the stage before has kept and returns the columns of documents, but for the
last, which returns doc_id, source, n_tokens, token_ids, round_trip and parity. The labels of the first stage
come from the tables' directory. run() writes each stage as Parquet to the shared folder and reads it
again, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from egresslake.llm.common import stored
from egresslake.llm.exact_dedup import drop_copies
from egresslake.llm.mixing import mixed_documents
from egresslake.llm.ngram_join import drop_near_copies
from egresslake.llm.sentencepieces import encode, read_model
from egresslake.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under the threshold; an empty text has the intercept's score, and stays unless labels say that most texts are toxic."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest, then the least id; all empty texts are one group."""
    return drop_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id; a text of under five words is near only to itself."""
    return drop_near_copies(docs)


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes, as often as it takes them, by position; a document without words is never taken; null is a source of its own."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row; round_trip is false where a text holds the marker itself, parity where the sentencepiece library differs."""
    return encode(docs, read_model(), also=["source"]).select("doc_id", "source", "n_tokens", "token_ids", "round_trip", "parity")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("ngram_join", ngram_join),
    ("curriculum_mix", curriculum_mix),
    ("sentencepiece", sentencepiece),
]

#: The classifier, the min-hashes and the tokenizer cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

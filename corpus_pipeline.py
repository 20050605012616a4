"""From raw documents to packed training sequences.

Each stage takes what the one before it kept: the quality classifier drops documents it rejects; of each group of SimHash near
copies the one with the least id stays, if any has one; documents that a benchmark contaminates go; secrets are replaced in the texts that
remain; and these are packed into sequences.

The near-copy stage takes texts whose five-word shingles have a Jaccard similarity of 0.8 or more as near copies.

Nulls and edge cases, in every stage: null texts count as empty, null and repeated ids are carried along and never decide alone; empty
tables give no rows. `n_chars` is counted anew for texts that a stage changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionweave.llm import decontamination, packing, quality_classifier, secret_scan, similarity
from sessionweave.llm.common import table, written
from sessionweave.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CARRIED = COLUMNS[1:]
REDACTED = "[REDACTED]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    scored = quality_classifier.score_quality(docs, table(spark, sf_dir, "labels"), carry=CARRIED)
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id (nulls last), then hash of the text.

    Groups are of texts, not of ids: where ids are null or repeat, each row stays or goes by its own text; of equal rows any one stays.
    """
    return similarity.one_of_each_group(docs, carry=("lang", "source", "n_chars")).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=CARRIED)
    return judged.where("not contaminated").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, private keys to their END line."""
    scanned = secret_scan.scan_secrets(docs, rules=secret_scan.REDACTED_RULES, redact=REDACTED, carry=("lang", "source", "n_chars"))
    changed = F.size("spans") > 0
    return scanned.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", clean_of_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: A fitted classifier and a tokenizer aren't expressible in SQL; tests/llm compares the stages with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents, writing each result and reading it as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

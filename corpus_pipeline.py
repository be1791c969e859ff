"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens.

Every stage takes all rows of the one before, with whatever columns they have;
null and empty texts pass or fail as its operator's docstring says (they fail
the quality rules, lose no lines, are copies of each other, stay in the mix
once and have no tokens), and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replayframe.llm.bpe import bpe_round_trip
from replayframe.llm.common import discard, materialize, small_batches, steps
from replayframe.llm.line_templates import without_recurring_lines
from replayframe.llm.mixing import mixed_documents
from replayframe.llm.near_copies import drop_near_copies
from replayframe.llm.quality_rules import keep_good


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules keep, unchanged; without labels only the base rules decide."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that recur across them.

    Near copies lose no lines to each other: the next stage drops them as a
    whole, and not all but a few lines of them.  No row is dropped.
    """
    with small_batches(spark):
        return without_recurring_lines(docs, spare_copies=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group linked by a similarity of 0.8 in five-word shingles."""
    with small_batches(spark):
        return drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them; those without words once."""
    return mixed_documents(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it in the tokenizer's own spelling."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_round_trip(docs.select("doc_id", "source", "text"), path, keep_text=False).select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("bpe", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.  Tables of a stage's steps are deleted when it is written, and its own when the next one is."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with steps():
            docs = materialize(stage(spark, docs, sf_dir), name, kept=True)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: The rules and the fingerprints aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None

"""Curation of a corpus: quality rules, toxicity, near copies, benchmark passages, pieces.

Every stage takes (spark, docs, sf_dir), reads all of ``docs``, and hands on the columns of
documents, whatever other columns there are; the last one adds the pieces.  Rows without a
doc_id go in the first stage, null and empty texts too (they fail its rules); rows that repeat
an id are kept or go together, when one of them is kept; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.decontaminate import decontaminate
from foliant.llm.neardup import near_duplicates
from foliant.llm.pieces import encode_pieces
from foliant.llm.queries import vocabulary
from foliant.llm.rules import quality_rules
from foliant.llm.toxicity import toxicity_scores
from foliant.tables import Scratch

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "doc_id", "left_semi").select(*DOCUMENT)


def pass_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their group go."""
    return _only(docs, quality_rules(docs).where("kept"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by the threshold of their language go; it learns from this stage's own labelled rows."""
    return _only(docs, toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("not rejected"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays: five-word shingles, similarity 0.8."""
    return _only(docs, near_duplicates(docs, words=5, similarity=(80, 100)).where("kept"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages of test items in the others are cut out."""
    found = decontaminate(docs.select(*DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    clean = F.coalesce("decontamination.clean", "text")
    kept = found.where("not decontamination.contaminated").withColumns({
        "text": clean, "n_chars": F.when(F.col("decontamination.clean").isNotNull(), F.char_length(clean).cast("long")).otherwise(F.col("n_chars")),
    })
    return kept.select(*DOCUMENT)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of the best segmentation, and the text as decoded from them."""
    found = encode_pieces(docs.select(*DOCUMENT), vocabulary("piece_bpe_32k.model"), n=2)
    return found.select(
        "doc_id", F.when(F.col("text").isNotNull(), F.col("pieces.decoded")).alias("text"), "lang", "source", "n_chars",
        F.col("pieces.ids").alias("piece_ids"), F.col("pieces.n_pieces").alias("n_pieces"), F.col("pieces.scores").alias("scores"),
    )


STAGES = [
    ("quality rules", pass_quality),
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("pieces", to_pieces),
]
#: A convolutional classifier is among the stages, which SQL can't express; a test holds the
#: stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each table between stages goes when the next one is written."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

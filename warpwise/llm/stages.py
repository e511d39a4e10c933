"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what it keeps.

All but the last return the columns of ``documents``. Defined cases: stages keep documents with null or
empty texts as their operators judge them; repeated rows are judged alike, and near-duplicate removal
leaves one of them; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, line_dedup, near_copies, quality_trees, sentencepiece_bpe, simhash
from .columns import free
from .queries import table, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    forest = quality_trees.fitted(docs, table(spark, sf_dir, "labels"))
    score = free(docs, "__score")
    return quality_trees.scored_texts(docs, forest, out=score).where(F.col(score) >= quality_trees.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place holds; those that lost lines and have no word left go."""
    lines, removed = free(docs, "__lines"), free(docs, "__gone")
    cut = line_dedup.deduplicated(docs, lines_as=lines, removed_as=removed)
    left = cut.where((F.col(removed) == 0) | F.col("text").rlike(line_dedup.WORD))
    length = F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return left.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: those that operator 8 links, and those of a similarity of 0.8 or more.

    Operator 8 links fingerprints of three-word shingles that differ in at most three bits. Near copies of a similarity of 0.8
    differ in some eight bits, so pairs of that similarity on five-word shingles are sought as well, and the links of both
    together make the groups.
    """
    return near_copies.one_of_each(docs, groups=simhash.copies(docs)).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept text, and the text they decode to."""
    coded = sentencepiece_bpe.encode(docs, tokenizer_path("piece_bpe_32k.model"), decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality-classifier", quality),
    ("line-dedup", lines),
    ("near-dedup", near_duplicates),
    ("benchmark-decontamination", benchmark),
    ("sentencepiece", encode),
]

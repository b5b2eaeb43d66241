"""A corpus pipeline of five operators of gridloom.llm: what is good, once, and clean of benchmarks, as token ids.

Each stage takes (spark, docs, sf_dir), docs being what the stage before has written, and returns a DataFrame with
the columns of documents; the last returns token ids.

Null and empty texts, which the classifier scores like any others, keep their rows until they are one text of one group
of near copies; null ids are kept and come first where an id decides; of rows with equal id and text one stays; a text of
any length is one unit; texts that tie are told apart by their hash; columns beyond those of documents pass through,
but those named as results of line dedup, to the last stage, which has its own; empty tables give empty results, and without labels of both
classes nothing is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common as c
from gridloom.llm import sentencepiece_fst
from gridloom.llm.decontaminate import decontaminate
from gridloom.llm.line_dedup import RESULTS, line_dedup
from gridloom.llm.quality_qda import keep_good
from gridloom.llm.simhash_dedup import one_of_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    return keep_good(docs, c.table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of windows that stand in an earlier document; a document that loses every line with words goes."""
    out = line_dedup(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.filter(left | F.col("text").isNull()).drop(*RESULTS).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*(x for x in docs.columns if x not in RESULTS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, c.table(spark, sf_dir, "benchmark"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and round_trip of each document."""
    return sentencepiece_fst.encode(docs, sentencepiece_fst.read_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", lines_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: SQL has neither the classifier nor the pieces; a test holds run() against a plain version of every stage, all pairs compared.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = c.cut(docs, f"stage-{i}")
    return docs

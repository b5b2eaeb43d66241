"""The registered queries of the corpus operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common as c
from . import sql
from . import sentencepiece_fst, token_alignment, token_shards
from .decontaminate import find_leaks
from .html_blocks import extract
from .line_dedup import line_dedup
from .lm_scoring import lm_score
from .minhash_dedup import near_duplicates as near_copies
from .prefix_trie import family_trie
from .quality_qda import quality
from .quality_rules import quality_rules
from .simhash_dedup import near_duplicates
from .url_filter import url_filter

#: (verdict, host, path) of the url rules, and the hosts that the list blocks elsewhere.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(c.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(c.table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode(c.table(spark, sf_dir, "documents"), sentencepiece_fst.read_model())


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "host string")
    return url_filter(c.table(spark, sf_dir, "pages"), rules, listed)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{c.shared_dir(spark)}/llm-shards-{uuid.uuid4().hex}"
    return token_shards.write_shards(c.table(spark, sf_dir, "documents"), folder, sentencepiece_fst.read_model(token_shards.VOCABULARY))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(c.table(spark, sf_dir, "documents")).drop("host", "text", "removed")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return family_trie(c.table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = (sentencepiece_fst.read_model(x) for x in (token_alignment.BYTE_LEVEL, token_alignment.PIECES))
    return token_alignment.alignment(c.table(spark, sf_dir, "documents"), *models)


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(c.table(spark, sf_dir, "documents"))


QUERIES = (
    op1_line_dedup, op2_html_blocks, op3_lm_scoring, op4_sentencepiece, op5_decontaminate,
    op6_url_filter, op7_token_shards, op8_quality_qda, op9_quality_rules, op10_simhash_dedup,
    op11_prefix_trie, op12_token_alignment, op13_minhash_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": sql.OP1, "op6_url_filter": sql.OP6, "op9_quality_rules": sql.OP9, "op11_prefix_trie": sql.OP11, "op13_minhash_dedup": sql.OP13}

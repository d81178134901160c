"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import bpe, chat, lines, maxscore, packing, pfp, pii, quality_rules, setsketch, warc


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.classes(table(spark, sf_dir, "documents"), percent=85)


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op5_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages(table(spark, sf_dir, "conversations"))


def op2_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_prefix_free_dedup": op2_prefix_free_dedup,
    "op5_tool_linking": op5_tool_linking,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op3_setsketch_dedup": op3_setsketch_dedup,
    "op1_pii_spans": op1_pii_spans,
    "op10_maxscore_topk": op10_maxscore_topk,
    "op8_warc_chunks": op8_warc_chunks,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op9_byte_bpe": op9_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
}

SQL: dict[str, str] = {
    "op2_prefix_free_dedup": pfp.SQL,
    "op3_setsketch_dedup": setsketch.SQL,
    "op10_maxscore_topk": maxscore.SQL,
    "op8_warc_chunks": warc.SQL,
}

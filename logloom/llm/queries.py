"""The registered queries of this folder, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import (
    bpe,
    chat,
    collocations,
    exact_dedup,
    fingerprints,
    line_dedup,
    packing,
    quality,
    runs,
    secrets,
    toxicity,
    url_filter,
)
from logloom.llm.near_dedup import Likeness, near_duplicates
from logloom.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _query(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


@_query("op1_minhash_near_dedup")
def _near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), Likeness(words=3, percent=85))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@_query("op2_packing")
def _packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)
    return packed.withColumnRenamed("id", "doc_id")


@_query("op3_toxicity")
def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


@_query("op4_chat_formatting")
def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    linked = chat.link(chat.messages_of(conversations), chat.REPLY)
    return linked.withColumn("role", F.when(F.col("role") == "tool", "assistant").otherwise(F.col("role"))).select(
        "conv_id", "turn", "role", "call_id", *chat.ADDED
    )


ORACLES["op4_chat_formatting"] = chat.ORACLE


@_query("op5_secret_scan")
def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query("op6_document_fingerprints")
def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.compare_with_next(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


@_query("op7_exact_dedup")
def _exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("text_key")


ORACLES["op7_exact_dedup"] = exact_dedup.ORACLE


@_query("op8_url_filter")
def _url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    judged = url_filter.judge(pages, url_filter.listed_hosts(pages))
    return judged.withColumnRenamed("id", "page_id")


ORACLES["op8_url_filter"] = url_filter.ORACLE


@_query("op9_byte_bpe")
def _byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), RANKS).withColumnRenamed("id", "doc_id")


@_query("op10_quality_classifier")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id").drop("text_key")


@_query("op11_periodic_runs")
def _periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = runs.with_planted_runs(read(spark, sf_dir, "documents"))
    return runs.report(runs.find_runs(planted)).withColumnRenamed("id", "doc_id")


@_query("op12_line_dedup")
def _line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLES["op12_line_dedup"] = line_dedup.ORACLE


@_query("op13_collocations")
def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = collocations.ORACLE

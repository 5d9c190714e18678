"""The registered queries of this package: thin functions over its operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.quality import held_out, score_documents, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), digests=True)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.decontaminate import hits

    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.pii import pseudonymise, session_key

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), count_col="n_replaced")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.urls import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dunlin.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality, op2_embeddings, op3_bpe, op4_decontaminate, op5_substrings, op6_pii, op7_urls, op8_html, op9_chat, op10_minhash)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can express; a model, a tokenizer, a tree of tags and a Feistel network are tested otherwise."""
    from dunlin.llm import oracles

    return {"op2_embeddings": oracles.op2(), "op5_substrings": oracles.op5(), "op7_urls": oracles.op7(), "op10_minhash": oracles.op10()}

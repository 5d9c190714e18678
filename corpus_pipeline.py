"""A corpus pipeline over documents: quality, near-duplicates, contamination, private data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame
that is written as Parquet and read again for the next. All but the last return the columns of
documents, extra ones too.

An empty table gives an empty one at every stage. A null or empty text is a document with one empty line to the
classifier, has no near-duplicates, holds no benchmark item and no private value, and has no tokens. Rows
that repeat id and text are one document of which one row stays; of a group of near-duplicates a row with a
null id stays only if no other has an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunlin.llm import bpe, decontaminate, minhash, pii, quality
from dunlin.llm.common import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier does not reject."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five words, 0.8)."""
    return minhash.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, private values replaced by pseudonyms."""
    out = pii.pseudonymise(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the text decoded from them."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("private", hide_private),
    ("tokens", tokenize),
]
#: Not SQL: a trained classifier and a tokenizer; tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

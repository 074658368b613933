"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._tables import discard_since, exists, shared_dir, tables_made
from tessella.llm.exact_dedup import without_copies
from tessella.llm.language_id import fit_language_id, held_out, keep_known_language
from tessella.llm.mixing import mixed_documents
from tessella.llm.near_dedup import one_of_each
from tessella.llm.packing import pack
from tessella.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter and a language told with a score of 0.35 or more stay.

    Null, empty and letterless texts go; without labelled training rows every text
    with a letter stays. A null id is a training row. Repeated rows stay or go
    together, very long texts are read whole, further columns whatever their names
    pass through, and an empty table gives an empty one.
    """
    return keep_known_language(docs, fit_language_id(docs.filter(~held_out(F.col("doc_id")))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being the empty one, the document with the largest doc_id stays, null ids last.

    Of rows equal in id and text one stays, chosen by all its columns; an empty
    table gives an empty one, further columns pass through.
    """
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the documents with the least doc_id stay.

    Texts without words are linked with nothing and stay, as do rows of null id;
    rows that share the least id all stay. An empty table gives an empty one,
    further columns pass through.
    """
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order.

    The null source is one of its own; texts without words are never taken. Rows
    equal in id and text are taken together, an empty table gives an empty one,
    further columns pass through.
    """
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the training stream with their places in sequences of 2048 tokens.

    A null or empty text is its closing id alone; longer texts are cut, repeated
    rows packed each; an empty table gives no rows. Other columns are not read.
    """
    return pack(docs, tokenizer_path())


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", packed)]
ORACLE_SQL = None  # training, sketches and tokens have no SQL; tests/llm/test_pipeline.py has the brute force


def run(spark: SparkSession, sf_dir: str, run_id: str | None = None) -> DataFrame:
    """The last stage's rows. A run that broke goes on behind its last whole stage when called again with its run_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/tessella/pipeline-{run_id or uuid.uuid4().hex}"
    for name, stage in STAGES:
        if not exists(spark, f"{base}/{name}/_SUCCESS"):
            made = tables_made()
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{base}/{name}")
            discard_since(spark, made)
        docs = spark.read.parquet(f"{base}/{name}")
    return docs

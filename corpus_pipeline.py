"""A corpus pipeline over `documents`: quality rules, line dedup, MinHash near-dedup, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import lines, minhash, packing, quality
from tidewell.session import scratch_dir


def _hidden(docs: DataFrame) -> DataFrame:
    """`docs` with its columns but `doc_id` and `text` under names that no operator makes."""
    return docs.withColumnsRenamed({c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")})


def _shown(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again, from rows of its hidden form."""
    return rows.select(*(F.col(h).alias(c) for h, c in zip(_hidden(docs).columns, docs.columns, strict=True)))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; null and empty texts are among them. The columns stay as they are."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _shown(quality.judge(_hidden(docs), labels).where("kept"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more go, and documents of which only blanks remain.

    `n_chars`, where it exists, follows the changed texts.
    """
    deduped = lines.drop_repeated_lines(_hidden(docs), extend=True)
    rest = deduped.where((F.col("n_deleted") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    if "n_chars" in docs.columns:
        own = f"own_{docs.columns.index('n_chars')}"
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        rest = rest.withColumn(own, F.when(F.col("n_deleted") > 0, length).otherwise(F.col(own)))
    return _shown(rest, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    found = minhash.near_duplicates(_hidden(docs), minhash.Rule(words=5, percent=80))
    return _shown(found.where("first_of_group"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of 2048 ids, one row per piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: Packing has no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

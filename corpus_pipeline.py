"""From raw documents to token ids: five stages, each stored as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, exact, near, quality
from riskloom.llm.queries import vocabulary
from riskloom.session import run_folder


def _held(docs: DataFrame) -> DataFrame:
    """The documents with all columns but the text in a struct, so that no column an operator adds can clash with them."""
    return docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("others"))


def _given_back(docs: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `docs` as they are in `_held(docs)`."""
    return [F.col(c) if c == "text" else F.col("others")[c].alias(c) for c in docs.columns if c not in but]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier, fitted on the labels, does not reject."""
    scored = quality.with_scores(_held(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(scored["_score"] >= quality.CUT_OFF).select(*_given_back(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one that stays."""
    return exact.only_kept(docs, exact.exact_groups(docs))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return exact.only_kept(docs, near.near_classes(docs))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.with_hits(_held(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(found["_n_hit"] == 0).select(*_given_back(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, their number, and digests of the ids and of the text decoded from them.

    They replace the text and columns of their names.
    """
    added = ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "text")
    return bpe.with_tokens(_held(docs), vocabulary()).select(*_given_back(docs, added), *bpe.digests(), F.col("_ids").alias("ids"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("MinHash near-dedup", no_near_copies),
    ("benchmark decontamination", not_in_benchmark),
    ("BPE encoding", token_ids),
]

# A trained network and sampled signatures can't be said in SQL; the tests compare with a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs

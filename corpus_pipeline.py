"""From raw documents to token files: five stages, each written as Parquet before the next.

Counted as part of ``tidemark.llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, langid, mixing, neardup, tokenfile
from tidemark.llm.common import read_table, staged

TOKENIZER = "byte_bpe_50k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the codes tell; those undetermined or between two languages go."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = langid.identify(docs.select(row.alias("row"), "text"), langid.train_on_fold(docs))
    return found.where(~F.col("ambiguous")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, in the order of id (null last), then text.

    Where ids are missing or repeated, rows are told apart by their place in that order, so different texts of one id are
    different documents and equal rows are copies of each other.
    """
    told = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if told["rows"] == told["ids"]:
        groups = neardup.near_duplicates(docs)
        first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept"))
        return docs.join(first, docs["doc_id"] == first["_kept"], "left_semi")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_last()]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = staged(packed.repartitionByRange(*order).sortWithinPartitions(*order)
                    .select(F.monotonically_increasing_id().alias("place"), "row"), "placed")
    groups = neardup.near_duplicates(placed.select(F.col("place").alias("doc_id"), "row.text"))
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept"))
    return placed.join(first, placed["place"] == first["kept"], "left_semi").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    params = tokenfile.TokenFileParams(public_tokenizers.path(TOKENIZER))
    return tokenfile.token_output(spark, docs, params)


STAGES = [
    ("language ID", known_language),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokens),
]

#: SQL can express neither the language codes nor the tokenizer; tests compute what each stage must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs

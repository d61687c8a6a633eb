"""One query per operator, with the digest columns of its contract, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontamination, fingerprint, langid, licenses, linededup, mixing, neardup, oracle, periodic, secrets, spelling,
    tokenfile, warc, wrapper,
)
from tidemark.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_50k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.planned(read_table(spark, sf_dir, "documents"))
    return mixing.with_copies(taken.sized, taken.plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train_on_fold(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(read_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = tokenfile.TokenFileParams(public_tokenizers.path(TOKENIZER))
    return tokenfile.token_output(spark, read_table(spark, sf_dir, "documents"), params)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair of which the document holds a copy of the item."""
    found = decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("tag")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.next_and_edited(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return spelling.variants(spelling.word_counts(docs, edit=spelling.one_letter_less))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.scan(read_table(spark, sf_dir, "documents"), edit=periodic.repeated_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    found = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.col2")).alias("start"), "best.length",
        (-F.col("best.col3")).alias("period"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))
    return found.withColumn("exponent_milli", F.expr("1000 * length div period"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(read_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_files": op5_token_files,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_secret_scan": op8_secret_scan,
    "op9_warc": op9_warc,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_html_extraction": op13_html_extraction,
}

#: The others learn, tokenize or hash in ways SQL has no words for; tests hold them against brute force.
SQL: dict[str, str] = {
    "op2_mix_sources": oracle.OP2,
    "op4_line_dedup": oracle.OP4,
    "op6_near_duplicates": oracle.OP6,
    "op9_warc": oracle.OP9,
    "op11_spelling_variants": oracle.OP11,
    "op12_periodic_runs": oracle.OP12,
    "op13_html_extraction": oracle.OP13,
}

"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import bpe, class_model, html_text, lines, mixing, neighbours, quality, ranked, secrets, sharding, simhash, vector_codes, winnowing
from riskflow.llm.tables import table
from riskflow.session import staging_path

#: The vocabulary is part of the installation on every machine; another path may be given to the operator.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, with_text=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", "vec_id", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, the lines that went (first:count) and the ids that keep them."""
    found = lines.remove_repeated(table(spark, sf_dir, "documents"), details=True)
    lost = F.aggregate("cuts", F.lit(0), lambda s, c: s + c["n_lines"]).cast("long")
    cuts = F.array_join(F.transform("cuts", lambda c: F.concat_ws(":", c["first_line"].cast("string"), c["n_lines"].cast("string"))), ",")
    return found.select("doc_id", "text", lost.alias("n_lines_removed"), cuts.alias("cuts"), F.array_join(F.col("copied_from").cast("array<string>"), ",").alias("copied_from"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans with one ledger, which starts empty in the shared folder: the first takes every blob, the second, of the
    table as it is read then, only blobs it has not seen."""
    ledger = staging_path(spark, "secret-ledger")
    secrets.scan_versions(table(spark, sf_dir, "documents"), ledger)
    found = secrets.scan_versions(table(spark, sf_dir, "documents"), ledger)
    base = ["assign", "access", "hex"]
    return found.select(
        "doc_id", *[secrets.count_kind(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.joined_spans(base), 256).alias("base_sha256"), secrets.joined_spans().alias("spans"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.compare_neighbours(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), winnowing.printed(F.col("prints")).alias("fingerprint"),
        winnowing.printed(F.col("edited_prints")).alias("edited_fingerprint"), "near_edited", "near_next")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_with_errors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_shard_documents": op2_shard_documents,
    "op3_mix_sources": op3_mix_sources,
    "op4_quality": op4_quality,
    "op5_nearest": op5_nearest,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_secret_scan": op8_secret_scan,
    "op9_winnowing": op9_winnowing,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_class_model": op11_class_model,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_codes": op13_vector_codes,
}
#: The other operators rest on hashes, patterns, parsers or fits that SQL does not have.
ORACLES: dict[str, str] = {"op3_mix_sources": mixing.TAKEN_SQL, "op6_line_dedup": lines.REMOVED_SQL, "op12_ranked_search": ranked.SEARCH_SQL, "op13_vector_codes": vector_codes.CODES_SQL}

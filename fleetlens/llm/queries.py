"""Registered queries of the operators: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe import bpe_round_trip
from fleetlens.llm.embeddings import near_duplicate_vectors
from fleetlens.llm.licenses import scan_licenses
from fleetlens.llm.merkle import merkle_manifest, proof_digest
from fleetlens.llm.ngramjoin import near_duplicates
from fleetlens.llm.packing import pack_documents
from fleetlens.llm.quality import quality_rules
from fleetlens.llm.resampling import importance_resample
from fleetlens.llm.shipping import ship
from fleetlens.llm.storage import shared_folder
from fleetlens.llm.substring import remove_repeats
from fleetlens.llm.suffixarray import remove_repeated_bytes
from fleetlens.llm.toxicity import score_toxicity
from fleetlens.llm.urlfilter import judge_urls
from fleetlens.llm.warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = "word_bpe_49k.json"
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def _registered(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[name] = run
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_registered("op6_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


@_registered("op8_warc")
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_registered("op9_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits")


@_registered("op2_quality_rules")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents"), keep_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@_registered("op4_best_fit_packing")
def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@_registered("op7_bpe")
def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, public_tokenizers.path(TOKENIZER))


@_registered("op10_toxicity")
def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, _table(spark, sf_dir, "labels")).drop("text")


@_registered("op1_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@_registered("op5_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_registered("op3_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "paragraph", "family", "probability", "template", "overlap")


@_registered("op11_importance_resampling")
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance_resample(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)


@_registered("op12_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeated_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@_registered("op13_merkle_manifest")
def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = {"text": F.when(picked, F.translate("text", "\n", "")).otherwise(F.col("text"))}
    manifest = merkle_manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], altered)
    return manifest.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified"
    )

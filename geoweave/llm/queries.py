"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import (
    collocations, embedding_dedup, fm_index, importance, language_id, mixing, oracles, phrase_dedup, quality_rules, sentencepiece_codec, simhash, suffix_dedup,
    toxicity, warc_archive,
)
from geoweave.llm.common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, texts_out=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.array_join("spans", ",").alias("spans"), "kept_text")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (toxicity.fold("doc_id", 4) == 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(toxicity.fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = sentencepiece_codec.MODEL_PATH) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepiece_codec.encode(docs, sentencepiece_codec.load(model_path), with_ids=False)
    return out.select("doc_id", "n_tokens", "n_byte_pieces", "ids_sha256", "round_trip")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_chars"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs, texts_out=False).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc_archive.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc_archive.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.near_duplicates(rows).select("vec_id", "n_links", "component_id", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(toxicity.fold("doc_id", 3) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_dedup.remove_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text")
    return importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    return collocations.mine(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    out = fm_index.decontaminate(docs, items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

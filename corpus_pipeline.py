"""The corpus pipeline: identify languages, drop near-duplicates, remove repeats, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result is written as
Parquet to the shared folder and read again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import language_id, mixing, sentencepiece_codec, simhash, suffix_dedup
from geoweave.llm.common import materialize, table

DOC = "__gw_doc"
#: Bytes of a repeated string that the third stage cuts out: 51 words have more in 99 of 100 places of such texts. The 400 bytes
#: of the registered query op1 are that query's own.
PASSAGE_BYTES = 240
#: A document whose words give this share of their weight to a language other than its own is mislabelled.
OTHER_LANGUAGE = 0.5


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """Some columns of docs by name, and the others as one struct column, so that results cannot clash with them."""
    rest = [c for c in docs.columns if c not in columns]
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias(DOC) if rest else F.lit(None).alias(DOC), *columns)


def _unwrapped(wrapped: DataFrame, docs: DataFrame, new: dict[str, Column]) -> DataFrame:
    """The columns of docs again; new: those that are not in the struct or change."""
    return wrapped.select(*[new.get(c, F.col(f"{DOC}.`{c}`")).alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (no letters) and those written in another than they claim.

    Null and empty texts have no language and go; a null lang claims none, so such rows stay if they have letters. Texts of any
    length are read whole, ties go to the first language in order, repeated rows fare alike, an empty table gives an empty result,
    and columns of any name pass through.
    """
    model = language_id.fit(docs)
    named = language_id.identify(_wrapped(docs, "text"), model)
    other = (F.col("lang_pred") != F.col(f"{DOC}.lang")) & (F.col("score") >= OTHER_LANGUAGE)
    kept = named.where((F.col("lang_pred") != language_id.UNKNOWN) & ~F.coalesce(other, F.lit(False)))
    return _unwrapped(kept, docs, {"text": F.col("text")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those connected by pairs whose five-word shingles have a Jaccard similarity >= 0.8.

    The least doc_id stays; of rows that repeat it one, and a null id only if there is no other. Texts without words (null ones
    too) are alike, shorter texts than a shingle are one shingle, texts of any length are read whole, an empty table gives an
    empty result, and columns of any name pass through.
    """
    return simhash.keep_one_similar(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of PASSAGE_BYTES that occur twice out of the texts; documents of which nothing but space is left go.

    Null and short texts lose nothing; texts of any length are read whole; of ties all places are cut, repeated rows too (they are
    repeats of each other); an empty table gives an empty result; text and n_chars are set anew, other columns pass through.
    """
    cut = suffix_dedup.remove_repeats(_wrapped(docs, "text"), window=PASSAGE_BYTES, texts_out=True)
    left = cut.where((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(f"{DOC}.n_chars"))
    return _unwrapped(left, docs, {"text": text, "n_chars": size})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics meet their target weights.

    Null sources and languages are values of their own; texts without words (null ones too) weigh nothing; texts of any length
    are counted whole; rows that repeat in id and text share their fate; an empty table gives an empty result; columns of any name pass through.
    """
    used = ("doc_id", "text", "source", "lang")
    return _unwrapped(mixing.mix(_wrapped(docs, *used)).where("kept"), docs, {c: F.col(c) for c in used})


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, checked by decoding them.

    Null and empty texts have no tokens; texts of any length are encoded whole; of segmentations of equal score that with the longest last
    piece is taken; repeated rows give rows each; an empty table gives an empty result; other columns than those named are left out.
    """
    vocab = sentencepiece_codec.load()
    return sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), vocab).select(
        "doc_id", "lang", "source", "n_tokens", "n_byte_pieces", "ids_sha256", "round_trip", "token_ids"
    )


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]

#: SQL can express none of hashing, suffix sorting and segmentation as the stages need them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

"""A corpus pipeline: quality, near copies, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and returns all
that it keeps; ``run`` writes each stage's result as Parquet to the shared folder and reads it back.
Nulls, empty texts, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelake.llm.common import Scratch, ship_package
from wavelake.llm.minhash import drop_near_duplicates
from wavelake.llm.mixing import measured, place_documents, training_order
from wavelake.llm.quality import score_documents
from wavelake.llm.queries import PASSAGE_WORDS, QUALITY_THRESHOLD, REPEAT_BYTES, model_path, quality_model
from wavelake.llm.repeats import pack_texts, remove_repeats, unpack_texts
from wavelake.llm.sentencepiece_codec import encode_documents


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def carrying(stage):
    """Run a stage on the columns of documents; any others ride along in one struct, so no name can clash."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        extra = [c for c in docs.columns if c not in COLUMNS]
        if not extra:
            return stage(spark, docs, sf_dir)
        core = [c for c in docs.columns if c in COLUMNS]
        packed = docs.select(*core, F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra"))
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col("_extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns])

    return run


@carrying
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of documents that are not held out."""
    model = quality_model(spark, sf_dir, docs.select("doc_id", "text"))
    return score_documents(docs, model, score="_score").where(F.col("_score") >= QUALITY_THRESHOLD).select(*docs.columns)


@carrying
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return drop_near_duplicates(docs)


@carrying
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of over 50 words or of 400 bytes that occur more than once; n_chars follows the text.

    A document that loses everything stays as an empty text (the mix then takes no words of it)."""
    out = remove_repeats(docs, REPEAT_BYTES, as_text=True, words=PASSAGE_WORDS).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@carrying
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each reading of a document, in training order; documents that the mix does not reach go."""
    placed = training_order(place_documents(pack_texts(measured(docs))))
    return unpack_texts(placed.select(*[c for c in docs.columns if c != "text"], "z")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the text that they decode to."""
    ship_package(spark)
    out = encode_documents(docs.select("doc_id", "lang", "source", "text"), model_path())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_u32", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mix", mix), ("encode", encode)]

#: No stage but the mix can be stated in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: quality, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept. The first three return the columns of ``documents``; the last returns
the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stereolith.llm import common, minhash, packing, private, quality
from stereolith.llm.queries import vocabulary

KEEP_FROM = 0.3  # documents whose quality is less probable than this go


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; of an empty table none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 0
    rest = tuple(c for c in docs.columns if c != "doc_id")
    score = common.fresh(docs.columns, "score")
    scored = quality.score_quality(docs, labels, learn_from=learn, carry=rest, score_col=score)
    return scored.where(F.col(score) >= KEEP_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar to 0.8 or more; of an empty table none."""
    return minhash.deduplicate(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked in their text; of an empty table none."""
    masked = private.mask(docs, private.discover(docs))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; of an empty table none."""
    return packing.pack(docs, vocabulary=vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("private", mask_private),
    ("packing", pack_tokens),
]

#: Fingerprints, fitted networks and subword ids are beyond SQL; tests hold the rows against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, kept = docs, stage(spark, docs, sf_dir)
        docs = common.materialize(kept, f"stage-{name}")
        common.release(kept, before)
    return STAGES[-1][1](spark, docs, sf_dir)

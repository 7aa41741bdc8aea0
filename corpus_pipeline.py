"""A training corpus from raw documents: quality, near-dedup, substring dedup, mixing, BPE ids.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last
return the columns of documents. `run` writes each stage as a Parquet table in the shared folder and reads
it again, so that a lost executor never costs more than one stage.

Defined results: null and blank texts have no words and go with the first stage, as the classifier judges
them; repeated rows are copies of each other, of which the second stage keeps one; a null doc_id takes part
as the last one, a null source as the last source; other columns of the input are left behind; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lavra.llm import bpe, minhash, mixing, quality, substrings
from lavra.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, rejects go."""
    return quality.judge(docs, quality.fit(docs)).filter("keep").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id stays."""
    return minhash.dedup(docs).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 13-word windows that an earlier document holds go; all documents stay."""
    return substrings.clean(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(mixing.sized(docs)).filter("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that they give back."""
    got = bpe.encode(docs.select("doc_id", "source", "text"), bpe.vocabulary_path(bpe.VOCABULARY), decoded=True)
    n_tokens, digest = F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return got.select("doc_id", "source", n_tokens, "token_ids", digest)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

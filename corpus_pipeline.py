"""From raw documents to token ids: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage gets what its predecessor kept, written as Parquet and read again, and returns whole rows; all but the last keep the columns
of documents. Nulls, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import stage
from tesserae.llm.exact_dedup import drop_exact_duplicates
from tesserae.llm.mixing import take_mix
from tesserae.llm.quality import drop_low_quality
from tesserae.llm.queries import PIECES
from tesserae.llm.sentencepiece_codec import load_model, round_trip
from tesserae.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row of the largest doc_id stays."""
    return drop_exact_duplicates(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles, directly or by others, that of the smallest doc_id stays."""
    return drop_near_duplicates(docs, width=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: sources weigh 3, 1, 2, repeating, and share 150% of all words, at most 2 epochs each."""
    return take_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces, and whether decoding gives the text back. Each row of the mix is a row."""
    model = load_model(PIECES)
    coded = round_trip(docs.select("doc_id", "source", "text"), model)
    same = F.col("decoded").eqNullSafe(F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" ")))
    return coded.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), same.alias("round_trip"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("tokens", tokens)]

#: Not SQL: the forest, the Hamming search and the encoding. tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

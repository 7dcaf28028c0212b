"""From raw documents to sampled token sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.langid import keep_identified
from tidemark.llm.lines import Rule, drop_lines
from tidemark.llm.mixing import repeated
from tidemark.llm.segment import segmentations
from tidemark.llm.shared import cut, ship
from tidemark.llm.simhash import drop_near_duplicates


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language the model rejects: without letters (null and empty texts too), less sure than held-back texts, or of unfamiliar subwords.

    Repeated rows, null ids, other columns and empty tables: see keep_identified.
    """
    return keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier line is equal or near to; documents of which nothing is left go, those without words stay (see drop_lines)."""
    out = drop_lines(docs, Rule(equal=1))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose texts share 0.8 of their five-word shingles or more (see simhash.drop_near_duplicates)."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its slots; those without words go (see mixing.repeated)."""
    return repeated(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, one of texts that have no other, and the digest of what they decode to (see segmentations)."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return segmentations(docs, model)


STAGES = [("language", languages), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]

#: Training and sampling by numpy's generator can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

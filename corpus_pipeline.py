"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir); docs has the columns of ``documents``,
and what a stage returns is written and read again as the next one's docs.
Rows are judged as rows: ids may be null or shared.  Null texts are empty ones.
Further columns are kept until the last stage.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, gam, near_copies, secrets
from quillspark.llm.store import save, spread


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.7) go; it learns from labels.quality.

    Without labels, or with one label alone, every score is the same constant.
    Empty and null texts have a score like others; repeated rows are judged alike.
    """
    model = gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return gam.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id.

    Classes are those of the SimHash operator over 5-word shingles, completed to a
    Jaccard similarity of 0.8 or more.
    """
    return near_copies.keep_first_of_similar(docs, width=5, least=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go, within a fifth of the item's words as edits; empty ones stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay, and n_chars follows the text where it changes.

    Null and empty texts stay as they are; without documents the models rest on samples made by rule.
    """
    found = secrets.find_secrets(docs, secrets.train(secrets.labelled(docs)))
    clean = secrets.redact(found)
    n_chars = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and the text that they decode to; null texts are empty and have no ids."""
    return bpe.encode_texts(docs, _tokenizer(), carry=("lang", "source"), as_array=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: The classifier and the fingerprints have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage's result is written to the shared folder."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs

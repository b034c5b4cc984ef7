"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet
and gives it to the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, mixing, quality, secrets, simhash
from sluice.llm.common import Staging, table, where_made
from sluice.session import configure

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor the likelihood ratio rejects.

    Null and empty texts go, as they have fewer than 50 words. Repeated rows are judged each on
    their own text.
    """
    trusted = quality.trusted_rows(table(spark, sf_dir, "labels"))
    return where_made(quality.quality_rules(docs, trusted), "kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate class.

    Near duplicates share 0.8 of their distinct five-word shingles or more. Null and empty texts
    are one class; rows with a null id stay, and rows that share an id share their fate.
    """
    configure(spark)
    return simhash.one_of_each(docs, simhash.similar_documents(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text. Texts without words stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets found in their texts masked and sizes adjusted.

    Null texts stay null, and their size too.
    """
    configure(spark)
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with how many words it takes of each.

    Adds ``size``, ``source_size``, ``target`` and ``taken``, which replace columns of the input
    that have these names. Texts without words are not in the mix.
    """
    configure(spark)
    mixed = mixing.mix(docs, carry_text=True).where("taken > 0")
    own = ("size", "source_size", "target", "taken")
    return mixed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in own], *own)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("mixing", mix_sources),
]

# Likelihoods, fingerprints and matches are not SQL: the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it.

    A stage's table is deleted once the next one is written.
    """
    docs, staging, before = table(spark, sf_dir, "documents"), Staging(spark, "pipeline"), []
    for name, stage in STAGES[:-1]:
        docs = staging.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        staging.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

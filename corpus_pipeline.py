"""The corpus pipeline: quality rules, toxicity, SimHash near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet in the shared folder
and rereads it as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itemloom.llm import packing, pii, quality_rules, simhash, toxicity
from itemloom.llm.common import remove, work_path
from itemloom.sources import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; so do documents that fail the base rules or lose too much text."""
    return quality_rules.clean_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model learns from the labelled documents of the whole table."""
    model = toxicity.fit_from_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more stays, that of the smallest id."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents, packed into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near duplicates", near_duplicates), ("personal data", personal_data), ("packing", pack)]
#: The toxicity network, the fingerprints' groups and the tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        found, path = stage(spark, docs, sf_dir), work_path(spark, "pipeline")
        found.write.parquet(path)
        if last:
            remove(spark, last)  # read by this stage alone
        docs, last = spark.read.schema(found.schema).parquet(path), path
    return docs

"""The training-data pipeline over ``documents``: five stages, each on what the last one kept.

1. quality rules: rejected documents go;
2. MinHash near-dedup: of each group of near copies (five-word shingles, similarity of 0.8
   or more) the document with the smallest id stays;
3. secret scans: secrets are replaced in the text, documents stay;
4. mixing sources to target weights: documents occur as often as the mix takes them;
5. best-fit packing: the pieces of all documents and their places in sequences.

Defined results: a null or empty text has too few words and goes in the first stage; a null
language or source is a language or source of its own; a null id is kept and mixed by its text;
rows that repeat an id are documents of their own, rows that also repeat the text are copies;
other columns come through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import dedup, mixing, packing, quality, scratch, secrets, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(spark))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokens.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: Shingle sets, the forest and the tokenizer are beyond SQL: tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.materialize(docs, f"stage{k + 1}")
    return docs

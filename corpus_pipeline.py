"""From raw documents to token ids, in five stages; each works on all that the one before it kept.

The last stage returns the ids of each document; all others return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import byte_bpe, decontamination, language_id, line_dedup, simhash
from veilframe.llm.common import discard, every, scratch_path, table
from veilframe.llm.queries import PATTERN, RANKS


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: no letters, or a score under what calibration allows."""
    return language_id.keep_identified(docs, language_id.train(docs))


def remove_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out lines that very many sites share, but for their first occurrence; n_chars follows the text. Keeps every document."""
    cleaned = line_dedup.remove_boilerplate(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*every(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, with the shingles and the distance of the operator's contract."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of the benchmark."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    decoded = byte_bpe.round_trip(docs, RANKS, PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("bytes", "utf-8").alias("text"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_shared_lines),
    ("SimHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenize),
]

#: XXH64, star contraction, stochastic gradient descent and BPE are not to be had in SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet (in the shared folder) and read again; what a stage has read is then deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs

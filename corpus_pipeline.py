"""A corpus pipeline: documents without toxic ones, near copies and benchmark passages, with pseudonyms for personal
data, as token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmatch.llm import decontaminate, pii, sentencepiece_bpe, simhash, toxicity
from driftmatch.llm.common import written
from driftmatch.llm.queries import PII_KEY, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: rejects documents that are likelier toxic than not; fitted on the labels of the documents at hand."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.expr("int(toxic > 0)"), levels=3)
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each group of copies and near copies (five words, 0.8) the smallest doc_id stays."""
    return simhash.without_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rejects documents that hold a benchmark passage."""
    return decontaminate.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: pseudonyms in ``text``; ``n_chars`` follows."""
    new = pii.pseudonymise(docs, PII_KEY, count_col=None)
    return new.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: (doc_id, lang, source, n_tokens, ids) with the end id."""
    import public_tokenizers

    return sentencepiece_bpe.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source")).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_copies),
    ("decontamination", drop_benchmark),
    ("pii", replace_pii),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The operators' queries over whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmatch.llm.licenses import scan_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PII_KEY = "a key for tests"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op2_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm import ngram_lm as lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(lm.held_out(), F.lit(False))
    model = lm.train(docs.where(~held), order=2)
    return lm.score(docs, model).withColumn("held_out", held).withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.expr("int(toxic > 0)"), levels=3)
    return toxicity.score(docs, model)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.repeats import remove

    return remove(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from driftmatch.llm.sentencepiece_bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.decontaminate import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftmatch.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_ngram_lm, op3_toxicity, op4_simhash, op5_ann, op6_repeats, op7_sentencepiece, op8_licenses, op9_decontaminate, op10_html_text)}
ORACLE: dict[str, str] = {"op8_licenses": scan_sql()}

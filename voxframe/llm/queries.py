"""The operators as queries over the whole tables, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import codes, decontaminate, extract, hmm, jaccard, licences, line_dedup, mixing, quality, secrets, spelling, topk, warc
from voxframe.llm.oracles import ORACLE_SQL  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of mixing all documents to target weights."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents by a hidden Markov model of the training ones."""
    return hmm.score_texts(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and looked up again through the capture index."""
    return warc.warc_report(table(spark, sf_dir, "pages"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and base places of all whole documents."""
    return licences.licence_report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of the benchmark in all whole documents."""
    return decontaminate.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all whole documents, and how widely the corpus owns them."""
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all whole documents by the labels that may be learnt."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by four-word shingles at 85 in 100."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped and kept of all whole documents."""
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth id, over all vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors after two Lloyd rounds, and what they lose."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all whole documents with their near words, forms and roots."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all whole pages."""
    return extract.extract_report(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_lm_score, op3_warc, op4_licence_scan, op5_decontaminate, op6_secret_scan, op7_quality, op8_jaccard_join, op9_line_dedup, op10_top_k, op11_vector_codes, op12_spelling_variants, op13_page_text)}

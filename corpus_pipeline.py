"""The corpus pipeline: documents through five of the training-data operators, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm import decontaminate, jaccard, line_dedup, mixing, quality
from voxframe.llm.common import materialise


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below the threshold go.

    Null and empty texts score by the bias alone; repeated rows stay or go together; a score at the threshold stays; an
    empty table gives no rows; columns of any name stay as they are.
    """
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: texts lose the lines that another document keeps; n_chars, if there, follows the text.

    Null text stays null; a text that loses all its lines is empty and its row stays; rows that repeat an id are one
    document, each loses the same lines; a null id is never the one that keeps a line; an empty table gives no rows;
    columns of any name stay as they are.
    """
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five words at 0.8: of each group of near copies the document of smallest id stays.

    Rows that repeat are copies, and one stays; of rows that share id and text the one whose JSON has the smallest hash;
    null ids come last; texts without words are no copies and stay; an empty table gives no rows; columns of any name stay.
    """
    return jaccard.drop_near_copies(docs, n=5, num=80, den=100)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents whose hit words make a twentieth of theirs or more go.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark takes nothing; columns of any name stay.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as it is taken, numbered by ``copy``.

    Null texts have no words; a null source is one of its own, ranked last; rows that repeat an id share its luck; an
    empty table gives no rows; a column of docs named ``copy`` gives way to the number, all others stay.
    """
    return mixing.mix_sources(docs)


STAGES = [("quality", keep_quality), ("line dedup", dedup_lines), ("near copies", drop_near_copies), ("decontamination", decontaminate_docs), ("mix", mix)]
#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

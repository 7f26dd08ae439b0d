"""Submissions, manifests and resumable outputs."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store(uri: str):
    """A file system and the path in it, on an executor as on the driver."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def files(df: DataFrame, path: str) -> int:
    """Writes each row (name, content) as a file below a path, folders included; gives their number.

    A task that runs again writes under other names first and takes their places, so no half files stay.
    """

    def run(batches):
        fs, base = store(path)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, mark = f"{base}/{name}", f"{base}/.{uuid.uuid4().hex}"
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(mark) as out:
                    out.write(content)
                fs.move(mark, at)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    rows = df.select(F.col("name").cast("string"), F.col("content").cast("binary"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def csv(df: DataFrame, path: str) -> None:
    """A CSV that any reader of quoted fields takes: a header, all fields quoted, quotes doubled."""
    df.write.options(header=True, quoteAll=True, escape='"').csv(path)


def submission(form: DataFrame, preds: DataFrame, key: str = "utterance_id", strict: bool = False) -> DataFrame:
    """The format's rows with predictions; what is missing is empty, or an error at run time if ``strict``."""
    out = form.join(preds, key, "left")
    missing = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key))).cast("string") if strict else F.lit("")
    return out.withColumn("prediction", F.coalesce("prediction", missing))


def submission_inner(form: DataFrame, preds: DataFrame, key: str = "utterance_id") -> DataFrame:
    return form.join(preds, key)


def append_new(df: DataFrame, done: DataFrame | None, path: str, key: str = "utterance_id") -> DataFrame:
    """Writes the rows whose key is not done yet behind those that are; corrupt lines of what is there are ignored."""
    fresh = df if done is None else df.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    fresh.write.mode("append").json(path)
    return fresh


def summary(df: DataFrame, column: str = "prediction") -> DataFrame:
    full = F.trim(column) != ""
    return df.agg(F.count("*").alias("n"), F.count_if(full).alias("n_filled"), F.round(F.avg(F.when(full, F.length(column))), 6).alias("mean_chars"))

"""Manifests and model outputs from files."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions import signals
from voxframe.functions.batched import flat_map_rows, map_rows


def jsonl(spark: SparkSession, paths, schema: str, exclude: tuple[str, ...] = (), limit: int | None = None, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One object per line with a given schema; blank lines are skipped. ``hook`` changes the rows that are left."""
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").json(paths).drop(*exclude)
    df = df if limit is None else df.limit(limit)
    return hook(df) if hook else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What writers.csv writes: line breaks within quotes belong to their field."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', enforceSchema=True)


def jsonl_first(spark: SparkSession, paths: list[str], schema: str, key: str) -> DataFrame:
    """Several files in order of precedence: the first row of a key wins, ``source`` is the stem of its file."""
    parts = [spark.read.schema(schema).json(p).select("*", F.lit(i).alias("_rank"), F.lit(p.rstrip("/").rpartition("/")[2].removesuffix(".jsonl")).alias("source"), F.monotonically_increasing_id().alias("_row")) for i, p in enumerate(paths)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_rank", "_row"))).where("_k = 1").drop("_k", "_rank", "_row")


def json_dir(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file; ``stem`` is the file's name without its ending."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1))


def ctm(spark: SparkSession, path: str) -> DataFrame:
    """Word alignments: lines of five fields or more give file, start, duration, word."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 5).select(F.get("p", F.lit(0)).alias("file"), F.get("p", F.lit(2)).cast("double").alias("start"), F.get("p", F.lit(3)).cast("double").alias("duration"), F.get("p", F.lit(4)).alias("word"))


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar files: stem, size and content; one archive is one task's row."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def members(content):
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            return [(m.name.rpartition("/")[2].rpartition(".")[0] or m.name, m.size, tar.extractfile(m).read()) for m in tar if m.isfile()]

    return flat_map_rows(files, members, "stem string, size long, content binary")


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Stems, paths and sizes of files anywhere below a folder that match a pattern; contents are not read. Empty files are passed over."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), "path", F.col("length").alias("size"))


def waves(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Properties and md5 of all WAV files below a folder; a file that can't be read has null properties and its error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    names = ("stereo", "rate", "bits", "samples", "clipped", "crossings", "centroid", "f0")

    def look(name, content):
        md5 = hashlib.md5(content).hexdigest()
        try:
            p = signals.properties(content)
        except ValueError as e:
            return (name, md5, *[None] * len(names), str(e))
        return (name, md5, *[p[n] for n in names], None)

    stem = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)
    return map_rows(found.select(stem.alias("stem"), "content"), look, "stem string, md5 string, stereo boolean, rate int, bits int, samples long, clipped long, crossings double, centroid double, f0 double, error string")


def model_list(spark: SparkSession, path: str) -> DataFrame:
    """``name[:max_seconds]`` a line; comments and blank lines are skipped."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("l")).where("l <> ''").select(F.get(F.split("l", ":"), F.lit(0)).alias("name"), F.get(F.split("l", ":"), F.lit(1)).try_cast("double").alias("max_seconds"))


def log_ids(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Ids packed in a log: lines between two marks that are base64 alone, joined, decoded, eight bytes an id.

    A log is read whole, one file a row, since the range of lines needs their order.
    """
    body = F.regexp_extract("value", f"(?s){begin}\\s*\\n(.*?)\\n[^\\n]*{end}", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[A-Za-z0-9+/=]+$"))
    raw = spark.read.text(path, wholetext=True).select(F.hex(F.unbase64(F.array_join(lines, ""))).alias("h")).where(F.length("h") >= 16)
    pieces = F.explode(F.sequence(F.lit(0), F.floor(F.length("h") / 16).cast("int") - 1)).alias("i")
    return raw.select("h", pieces).select(F.concat(F.lit("U_"), F.lower(F.substr("h", 1 + 16 * F.col("i"), F.lit(16)))).alias("utterance_id"))

"""Sources and sinks: what is written in a format is read from it again."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import functions as F

from voxframe.functions.batched import map_rows
from voxframe.plans.registered import query
from voxframe.plans.tables import U, table, utterances
from voxframe.sources import readers, writers
from voxframe.sources.workdir import new_path

MANIFEST = "utterance_id string, child_id string, text string, duration double"
M = f"WITH {U} SELECT utterance_id, child_id, text, duration FROM u"


def manifest(spark, d):
    return utterances(spark, d).select("utterance_id", "child_id", "text", "duration")


def stored(spark, df, label, how, **options):
    path = new_path(spark, label)
    df.write.options(**options).format(how).save(path)
    return path


@query(M)
def scan_jsonl(spark, d):
    return readers.jsonl(spark, stored(spark, manifest(spark, d), "jsonl", "json"), MANIFEST)


@query(f"WITH {U} SELECT utterance_id, duration, CAST(round(duration * 1000) AS BIGINT) AS ms FROM u")
def scan_jsonl_opts(spark, d):
    """Columns left out, and a hook that changes rows. Every row is read: the reader's limit is for callers who ask for one."""
    hook = lambda df: df.withColumn("ms", F.round(F.col("duration") * 1000).cast("long"))
    return readers.jsonl(spark, stored(spark, manifest(spark, d), "jsonl", "json"), MANIFEST, exclude=("text", "child_id"), hook=hook)


@query(f"WITH {U} SELECT utterance_id, child_id, text, duration, CASE WHEN ord < 5 THEN 'a' ELSE 'b' END AS source FROM u WHERE ord < 5 OR ord >= 3")
def scan_jsonl_multi_dedup(spark, d):
    path = new_path(spark, "multi")
    u = utterances(spark, d)
    cols = ["utterance_id", "child_id", "text", "duration"]
    u.where("ord < 5").select(cols).write.json(f"{path}/a.jsonl")
    u.where("ord >= 3").select(cols).write.json(f"{path}/b.jsonl")
    return readers.jsonl_first(spark, [f"{path}/a.jsonl", f"{path}/b.jsonl"], MANIFEST, "utterance_id")


@query(f"WITH {U} SELECT utterance_id, child_id, text, duration, CASE WHEN ord < 5 THEN 'a' ELSE 'b' END AS source FROM u WHERE ord % 2 = 0")
def scan_jsonl_dedup_audio(spark, d):
    """Rows of several manifests whose audio is found in a listing of files."""
    path = new_path(spark, "audio")
    there = utterances(spark, d).where("ord % 2 = 0").select(F.concat("child_id", F.lit("/"), "utterance_id", F.lit(".wav")).alias("name"), F.lit("RIFF").alias("content"))
    writers.files(there, path)
    found = readers.listing(spark, path, "*.wav").select(F.col("stem").alias("utterance_id"))
    return scan_jsonl_multi_dedup(spark, d).join(found, "utterance_id", "left_semi")


@query(M)
def scan_csv(spark, d):
    path = new_path(spark, "csv")
    writers.csv(manifest(spark, d), path)
    return readers.csv(spark, path, MANIFEST)


@query(M)
def scan_parquet(spark, d):
    return spark.read.parquet(stored(spark, manifest(spark, d), "parquet", "parquet"))


@query(M + " UNION ALL " + M.replace(f"WITH {U} ", ""))
def scan_ndjson(spark, d):
    path = stored(spark, manifest(spark, d), "ndjson", "json")
    return readers.jsonl(spark, [path, path], MANIFEST)


@query("SELECT CAST(page_id AS VARCHAR) AS stem, page_id, url FROM pages")
def scan_json_dir(spark, d):
    """One JSON document per file, over several lines; the key is the file's stem."""
    path = new_path(spark, "json-dir")
    document = F.to_json(F.struct("page_id", "url"), {"pretty": "true"})
    writers.files(table(spark, d, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".json")).alias("name"), document.alias("content")), path)
    return readers.json_dir(spark, path, "page_id long, url string").select("stem", "page_id", "url")


@query(f"WITH {U} SELECT utterance_id AS file, round(CAST(ord AS DOUBLE), 3) AS start, round(duration, 3) AS duration, role AS word FROM u")
def scan_ctm(spark, d):
    line = F.format_string("%s 1 %.3f %.3f %s 1.0", "utterance_id", F.col("ord").cast("double"), "duration", "role")
    return readers.ctm(spark, stored(spark, utterances(spark, d).select(line.alias("value")), "ctm", "text"))


@query("SELECT CAST(page_id AS VARCHAR) AS stem, octet_length(encode(html)) AS size, sha256(html) AS sha FROM pages")
def scan_tar_members(spark, d):
    """Tar files of some pages each, written and read again member by member."""
    pages = table(spark, d, "pages").select(F.col("page_id"), F.col("html").cast("binary").alias("html"))
    groups = pages.groupBy(F.floor(F.col("page_id") / 16).alias("g")).agg(F.collect_list(F.struct("page_id", "html")).alias("r"))

    def pack(g, rows):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in rows:
                info = tarfile.TarInfo(f"audio/{r['page_id']}.html")
                info.size = len(r["html"])
                tar.addfile(info, io.BytesIO(r["html"]))
        return f"{g}.tar", out.getvalue()

    path = new_path(spark, "tar")
    writers.files(map_rows(groups, pack, "name string, content binary"), path)
    return readers.tar_members(spark, path).select("stem", "size", F.sha2("content", 256).alias("sha"))


@query("SELECT CAST(page_id AS VARCHAR) AS stem, octet_length(encode(url)) AS size FROM pages WHERE page_id % 3 < 2")
def scan_glob_audio(spark, d):
    """Files of two kinds in folders of several depths; those of a third are passed over."""
    folder = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("a/b/"), (F.col("page_id") % 5).cast("string"), F.lit("/"))).otherwise("")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".flac", ".txt")]), (F.col("page_id") % 3).cast("int") + 1)
    path = new_path(spark, "glob")
    writers.files(table(spark, d, "pages").select(F.concat(folder, F.col("page_id").cast("string"), ending).alias("name"), F.col("url").alias("content")), path)
    return readers.listing(spark, path, "*.{wav,flac}").select("stem", "size")


@query("SELECT 'U_' || lower(printf('%016x', doc_id)) AS utterance_id FROM labels")
def scan_log_b64(spark, d):
    """Logs of ids: eight bytes each, in lines of base64 between two marks, among other lines."""
    ids = table(spark, d, "labels").select(F.lpad(F.hex("doc_id"), 16, "0").alias("h"), F.floor(F.col("doc_id") / 512).alias("g"))
    packed = F.regexp_replace(F.base64(F.unhex(F.array_join(F.collect_list("h"), ""))), r"\s", "")
    lines = F.regexp_replace(packed, "(.{60})", "$1\n")
    logs = ids.groupBy("g").agg(F.concat_ws("\n", F.lit("start"), F.lit("BEGIN IDS"), lines, F.lit("[not base64]"), F.lit("-- END IDS"), F.lit("done")).alias("content"))
    path = new_path(spark, "log")
    writers.files(logs.select(F.concat(F.col("g").cast("string"), F.lit(".log")).alias("name"), "content"), path)
    return readers.log_ids(spark, path, "BEGIN IDS", "END IDS")


@query("SELECT * FROM (VALUES ('large', 20.0::DOUBLE), ('small', NULL), ('mid', 7.5)) t(name, max_seconds)")
def scan_model_list(spark, d):
    path = new_path(spark, "models")
    spark.createDataFrame([("# models",), ("large:20",), ("",), ("small  # any length",), ("mid:7.5",)], "value string").write.text(path)
    return readers.model_list(spark, path)


# ---- sinks


@query(M)
def sink_jsonl(spark, d):
    return spark.read.schema(MANIFEST).json(stored(spark, manifest(spark, d), "sink", "json"))


@query(f"SELECT *, 'csv' AS how FROM ({M}) UNION ALL SELECT *, 'parquet' AS how FROM ({M})")
def sink_csv_parquet(spark, d):
    """Both sinks, read back."""
    path = new_path(spark, "sink")
    writers.csv(manifest(spark, d), path)
    back = spark.read.parquet(stored(spark, manifest(spark, d), "sink", "parquet", compression="zstd"))
    return readers.csv(spark, path, MANIFEST).withColumn("how", F.lit("csv")).unionByName(back.withColumn("how", F.lit("parquet")))


def made(spark, d):
    return utterances(spark, d).where("ord % 3 <> 0").select("utterance_id", F.upper("role").alias("prediction"))


@query(f"WITH {U} SELECT utterance_id, CASE WHEN ord % 3 <> 0 THEN upper(role) ELSE '' END AS prediction FROM u")
def sink_submission(spark, d):
    return writers.submission(utterances(spark, d).select("utterance_id"), made(spark, d))


@query(f"WITH {U} SELECT utterance_id, upper(role) AS prediction FROM u WHERE ord % 3 <> 0")
def sink_submission_strict(spark, d):
    return writers.submission(utterances(spark, d).where("ord % 3 <> 0").select("utterance_id"), made(spark, d), strict=True)


@query(f"WITH {U} SELECT utterance_id, upper(role) AS prediction FROM u WHERE ord % 3 <> 0")
def sink_submission_inner(spark, d):
    return writers.submission_inner(utterances(spark, d).select("utterance_id"), made(spark, d))


@query(f"WITH {U} SELECT utterance_id, upper(role) AS prediction FROM u")
def append_resume(spark, d):
    path = new_path(spark, "resume")
    schema = "utterance_id string, prediction string"
    everything = utterances(spark, d).select("utterance_id", F.upper("role").alias("prediction"))
    writers.append_new(made(spark, d), None, path)
    writers.append_new(everything, spark.read.schema(schema).json(path), path)
    return spark.read.schema(schema).json(path)


@query(f"WITH {U}, s AS (SELECT CASE WHEN ord % 3 <> 0 THEN upper(role) ELSE '' END AS prediction FROM u) SELECT count(*) AS n, count(*) FILTER (WHERE trim(prediction) <> '') AS n_filled, round(avg(CASE WHEN trim(prediction) <> '' THEN length(prediction) END), 6) AS mean_chars FROM s")
def summary_after_write(spark, d):
    return writers.summary(sink_submission(spark, d))

"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host key. Each task writes one archive, one compressed record after another, and beside
it the archive's part of the index: blocks of sorted entries, compressed, and a sparse directory with the first key
and the place of each block. A look-up goes by binary search over the archives' first keys, then over one
directory, reads the range of one block, and from its entry the range of one record.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import cut, new_path

#: Entries in a block of the index.
BLOCK = 512
#: Payloads smaller than this are stored again rather than revisited.
LEAST = 0
DATE = "2024-01-01T00:00:00Z"


def sort_key(url: str | None) -> str:
    """Reversed host, then the rest: http://a.example.com:80/x becomes com,example,a)/x. Null: empty."""
    rest = (url or "").split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].lower()
    name, colon, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if colon and port not in ("80", "443") else "") + ")" + slash + path


def index_key(url: str | None) -> str:
    """The key as the index holds it, for writing and look-up alike: escaped, so that an entry stays on one line."""
    return _line(sort_key(url))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit with the HTTP header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Refers-To-Target-URI: {_line(refers_url)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _line(url: str | None) -> str:
    """A URL or key on one line: control characters and spaces as percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _page(urn: str | None) -> int | None:
    value = (urn or "").rpartition(":")[2].rstrip(">")
    return None if value in ("", "null") else int(value)


def captured(headers: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record read back."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"record {headers['warc-record-id']} is damaged")
    return _page(headers["warc-record-id"]), size, said, kind, _page(headers.get("warc-refers-to")), payload if kind == "response" else None


def _store(uri: str):
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) and the index; returns (shard, first_key, n) per archive.

    The payload is html in UTF-8 (null: empty). Of records with equal payloads of at least ``least_bytes`` bytes the
    one with the largest page_id is the response and the others revisit it; smaller ones are all responses. Rows that
    repeat that id are responses too; in a group of null ids alone all are responses. Equal payloads are found by
    SHA-256, summed before the shuffle; a payload that many pages share is spread by Spark's skew join. Rows are
    dealt by ranges of (key, page_id), so a common host, or one URL captured often, spreads over archives. A task that
    runs again writes under a name of its own and then takes its place, so lost executors leave no half archives.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(_key_column(F.col("url").cast("string")).alias("key"), F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(payload, 256)).alias("same"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    groups = cut(rows.where(F.length("payload") >= least_bytes).groupBy("same").agg(F.max(F.struct("page_id", "url")).alias("m"), F.count("*").alias("c")).where("c > 1 AND m.page_id IS NOT NULL").select(F.col("same").alias("_s"), F.col("m.page_id").alias("to"), F.col("m.url").alias("to_url")))
    # what a row revisits travels in a short row of the same place in the order, so payloads are shuffled once
    revisits = rows.select("key", "page_id", "same").join(groups, F.col("same") == F.col("_s")).where(~F.col("page_id").eqNullSafe(F.col("to")))
    revisits = revisits.select("key", "page_id", "same", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "to", "to_url")
    rows = rows.select("*", F.lit(None).cast("long").alias("to"), F.lit(None).cast("string").alias("to_url")).unionAll(revisits)
    place = ["key", "page_id", "same"]
    rows = rows.repartitionByRange(*place).sortWithinPartitions(*place, F.col("to").desc_nulls_last())
    spark = pages.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def run(batches):
        from pyspark import TaskContext

        shard = f"{TaskContext.get().partitionId():06d}"
        fs, base = _store(folder)
        mark = uuid.uuid4().hex
        names = {x: f"{base}/{shard}.{x}" for x in ("warc.gz", "index", "directory")}
        entries, directory, first, n, offset, placed, revisit = [], [], None, 0, 0, 0, (None, None)
        with fs.open_output_stream(f"{names['warc.gz']}.{mark}", compression=None) as archive, fs.open_output_stream(f"{names['index']}.{mark}", compression=None) as index:

            def close():
                nonlocal placed
                packed = gzip.compress("\n".join(entries).encode(), 6, mtime=0)
                directory.append(json.dumps([entries[0].split(" ", 1)[0], placed, len(packed)]))
                index.write(packed)
                placed += len(packed)
                entries.clear()

            for batch in batches:
                for key, page, same, url, payload, to, to_url in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "same", "url", "payload", "to", "to_url")), strict=True):
                    if to is not None:
                        revisit = (key, page, same), (to, to_url)
                        continue
                    target = revisit[1] if revisit[0] == (key, page, same) else (None, None)
                    packed = gzip.compress(record(page, url, payload, *target), 6, mtime=0)
                    first = key if first is None else first
                    entries.append(f"{key} {json.dumps([page, offset, len(packed)])}")
                    archive.write(packed)
                    offset, n = offset + len(packed), n + 1
                    if len(entries) >= block:
                        close()
            if entries:
                close()
        with fs.open_output_stream(f"{names['directory']}.{mark}", compression=None) as out:
            out.write("\n".join(directory).encode())
        for name in names.values():
            fs.move(f"{name}.{mark}", name)
        yield pa.RecordBatch.from_arrays([pa.array([shard] if n else []), pa.array([first] if n else [], pa.string()), pa.array([n] if n else [], pa.int64())], names=["shard", "first_key", "n"])

    return cut(rows.mapInArrow(run, "shard string, first_key string, n long"))


def _key_column(url):
    """index_key as a column."""

    @F.arrow_udf(T.StringType())
    def keys(urls: pa.Array) -> pa.Array:
        return pa.array([index_key(u) for u in urls.to_pylist()], pa.string())

    return keys(url)


def directory_of(fs, base: str, shard: str) -> list[tuple[str, int, int]]:
    with fs.open_input_file(f"{base}/{shard}.directory") as f:
        return [tuple(json.loads(x)) for x in f.read().decode().split("\n") if x]


def _run(firsts: list[str], key: str) -> range:
    """Places of sorted parts, known by their first keys, that may hold a key: it may have begun in the part before."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


class Archive:
    """One archive open for look-ups, with its sparse directory and the block of its index read last."""

    def __init__(self, fs, base: str, shard: str):
        self.shard, self.directory = shard, directory_of(fs, base, shard)
        self.firsts = [k for k, _, _ in self.directory]
        self.index, self.records = fs.open_input_file(f"{base}/{shard}.index"), fs.open_input_file(f"{base}/{shard}.warc.gz")
        self.held, self.keys, self.places = -1, [], []

    def block(self, i: int) -> None:
        if i != self.held:
            _, at, size = self.directory[i]
            self.index.seek(at)
            entries = [x.partition(" ") for x in gzip.decompress(self.index.read(size)).decode().split("\n")]
            self.held, self.keys, self.places = i, [k for k, _, _ in entries], [x for _, _, x in entries]

    def captures(self, key: str) -> Iterator[tuple]:
        """The records of a key: a binary search over the directory and one in each block it names, then one range each."""
        for i in _run(self.firsts, key):
            self.block(i)
            for j in range(bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)):
                _, offset, length = json.loads(self.places[j])
                self.records.seek(offset)
                yield captured(*parse(gzip.decompress(self.records.read(length))))

    def close(self) -> None:
        self.index.close()
        self.records.close()


def look_up(folder: str, shards: list[tuple[str, str]], url: str) -> list[tuple]:
    """The captures of the URLs that share one URL's key. ``shards``: (first key, shard), sorted; there is one per archive.

    Two binary searches name the blocks that may hold the key; a key captured often runs on over blocks and archives.
    """
    fs, base = _store(folder)
    key, found = index_key(url), []
    for i in _run([k for k, _ in shards], key):
        archive = Archive(fs, base, shards[i][1])
        found += archive.captures(key)
        archive.close()
    return found


def look_up_all(urls: DataFrame, folder: str, shards: DataFrame, url_col: str = "url", payloads: bool = False) -> DataFrame:
    """All captures of the URLs of a table, each once however often its URL stands there: (page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]).

    Each distinct key is searched for among the archives' first keys, of which there is one per archive, and goes to
    every archive that may hold it, so a key captured very often is looked up in each of its archives by another task.
    A task takes an archive's keys in their order, so it reads each block of the index once.
    """
    tops = sorted((r[1], r[0]) for r in shards.select("shard", "first_key").collect())
    sent = urls.sparkSession.sparkContext.broadcast(([k for k, _ in tops], [x for _, x in tops]))
    keys = urls.select(_key_column(F.col(url_col).cast("string")).alias("key")).distinct()

    def name(batches):
        firsts, names = sent.value
        for batch in batches:
            out = [(names[i], k) for k in batch.column("key").to_pylist() for i in _run(firsts, k)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([k for _, k in out], pa.string())], names=["shard", "key"])

    def read(batches):
        fs, base = _store(folder)
        archive, out = None, []
        for batch in batches:
            for shard, key in zip(batch.column("shard").to_pylist(), batch.column("key").to_pylist(), strict=True):
                if archive is None or archive.shard != shard:
                    if archive is not None:
                        archive.close()
                    archive = Archive(fs, base, shard)
                for row in archive.captures(key):
                    out.append(row)
                    if len(out) >= 200:
                        yield told(out)
                        out = []
        if archive is not None:
            archive.close()
        yield told(out)

    def told(rows):
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        n = 6 if payloads else 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds, strict=True))[:n]], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][:n])

    # one archive is one unit of reading, and there are as many as tasks wrote them
    asked = keys.mapInArrow(name, "shard string, key string").repartition(max(1, len(tops)), "shard").sortWithinPartitions("shard", "key")
    return asked.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else ""))


def warc_report(pages: DataFrame) -> DataFrame:
    """The digest of op3: page_id, payload_bytes, payload_digest, record_type, refers_to, as looked up in the archives.

    Every URL of pages is looked up through the index. Null html is an empty payload, null url an empty key, null ids are read back as null; an empty table writes no
    archive and gives no rows; other columns may have any name.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    return look_up_all(pages, folder, write_archives(pages, folder))

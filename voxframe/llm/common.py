"""What several operators share: the shared folder, materialised cuts of lineage, checked broadcasts, tokenisers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: 20, 09-0D.
SPACES = " \t\n\x0b\f\r"
#: A word between white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps bytes of UTF-8: ASCII letters to lower case, other ASCII but digits to a space, the rest as it is.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: A broadcast that a plan asks for holds at most so many rows; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder that is set.

    On one machine it is a temporary folder where neither is; on a cluster that is an error. What is written here goes
    when the application ends. (The rest of the library, which stands without this subpackage, has the same for itself.)
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/voxframe/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later plans start from there, whichever executors are lost."""
    spark = df.sparkSession
    return stored(df, new_path(spark, label))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df to a path of the shared folder, closely packed, and reads it again."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that no later step reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of each finished step go at once, not when the driver next collects its garbage.

    For steps that end in a table or a checkpoint: no later step reads their shuffles, and a retry within one is as ever.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for tables without texts. Those of an application stand in a folder of its own, which goes with it."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    sc = df.sparkSession.sparkContext
    own = sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    own.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(own)
    return out


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marks df for broadcast if it is short enough (counted unless ``rows`` is known); else joins shuffle it."""
    rows = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: str | Column, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n; null ids count as the text 'null'."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")) % n


def text_key(c: Column) -> list[Column]:
    """Two hashes that, with the id, tell a row's text from another's."""
    text = F.coalesce(c, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def bounded_batches(spark: SparkSession) -> None:
    """Lets texts go to Python in batches of a few MB where the session has Spark's own bound: long texts bring short batches.

    It stays so for the session, since results are lazy and run later; it bears on memory, never on results.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, str(BATCH_BYTES))


def as_bytes(column) -> list[bytes]:
    """The values of an Arrow binary column; null: empty."""
    return [x or b"" for x in column.to_pylist()]


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of largest count, at most so many: whole bins of a sixteenth of a doubling, from the top while they fit.

    Unlike a sort with a limit, no task and not the driver gets that many rows from every partition.
    """
    size = F.floor(F.log2(count) * 16).cast("int")
    least, taken = None, 0
    for b, c in sorted(((r[0], r[1]) for r in df.groupBy(size.alias("b")).count().collect()), reverse=True):
        taken += c
        if taken > most:
            break
        least = b
    return df.where(F.lit(False) if least is None else size >= least)


def exactly_most_frequent(df: DataFrame, count: str, key: str, most: int) -> DataFrame:
    """The ``most`` rows of largest count, or all if there are fewer; of equal counts those whose keys have the smallest md5.

    Bins of counts, then the counts of one bin, then bins of hashes narrow down where the last row stands, so no task
    gathers more than a small part of the rows. Keys are distinct.
    """
    size, digest = F.floor(F.log2(count) * 16).cast("int"), F.md5(F.col(key).cast("binary"))

    def cut_at(rows: DataFrame, what: Column, room: int, largest: bool) -> tuple[int | None, int]:
        """The value that the room ends in (None: all fit), and the room left when it begins."""
        for v, c in sorted(((r[0], r[1]) for r in rows.groupBy(what.alias("v")).count().collect()), reverse=largest):
            if c > room:
                return v, room
            room -= c
        return None, room

    edge, room = cut_at(df, size, most, True)
    if edge is None:
        return df
    out, rest = df.where(size > edge), df.where(size == edge)
    # a bin holds few different counts, or counts so large that few rows have them
    last, room = cut_at(rest, F.col(count), room, True)
    out, rest = out.unionAll(rest.where(F.col(count) > last)), rest.where(F.col(count) == last)
    part, room = cut_at(rest, F.substring(digest, 1, 4), room, False)
    here = F.substring(digest, 1, 4)
    return out.unionAll(rest.where(here < part)).unionAll(rest.where(here == part).orderBy(digest, key).limit(room))


def chunks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes add to about ``most``; a single larger one stands alone."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)

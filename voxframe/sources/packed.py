"""Packed sequences in files: all frames end to end in one array, with offsets, lengths and keys, read by ranges.

A file is an uncompressed .npz of ``logits`` (frames by symbols), ``offsets`` and ``lengths`` (in frames) and
``utterance_ids``, as numpy writes and loads it.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.writers import store

#: Bytes of a file's frames, about, and of what a reader holds at a time (a longer sequence stands alone).
FILE_BYTES, BATCH_BYTES = 128_000_000, 8_000_000


def write_packed(df: DataFrame, path: str, key: str, values: str, symbols: int, dtype: str = "<f4", file_bytes: int = FILE_BYTES) -> int:
    """Writes sequences (flat arrays of frames of ``symbols`` numbers) to files below a path; gives the number of files.

    Keys are dealt to as many files as their bytes need; a file's frames are counted first, so that it is written in one
    pass with one batch in memory. A null array has length -1; rows of null keys are left out.
    """
    size = np.dtype(dtype).itemsize
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(values).alias("v"))
    cells = rows.agg(F.sum(F.size("v"))).first()[0] or 0
    n = max(1, -(-max(0, cells) * size // file_bytes))
    shard = F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    frames = rows.groupBy(shard.alias("s")).agg(F.sum(F.greatest(F.size("v"), F.lit(0))).alias("total"))
    rows = rows.withColumn("s", shard).join(F.broadcast(frames) if n <= 100_000 else frames, "s").select("s", "total", "k", "v")
    dealt = rows.repartition(n, "s").sortWithinPartitions("s", "k")

    def run(batches):
        fs, base = store(path)
        now, made = None, 0

        def begin(s, total):
            mark = f"{base}/.{uuid.uuid4().hex}"
            out = fs.open_output_stream(mark)
            archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
            member = archive.open("logits.npy", "w", force_zip64=True)
            np.lib.format.write_array_header_1_0(member, {"descr": dtype, "fortran_order": False, "shape": (total // symbols, symbols)})
            return {"s": s, "mark": mark, "out": out, "archive": archive, "member": member, "offsets": [], "lengths": [], "keys": [], "at": 0}

        def end(f):
            f["member"].close()
            for name, array in (("offsets", np.array(f["offsets"], np.int64)), ("lengths", np.array(f["lengths"], np.int32)), ("utterance_ids", np.array(f["keys"]))):
                with f["archive"].open(f"{name}.npy", "w") as member:
                    np.save(member, array)
            f["archive"].close()
            f["out"].close()
            fs.move(f["mark"], f"{base}/{f['s']:06d}.npz")

        for batch in batches:
            arrays = batch.column("v")
            at, flat = arrays.offsets.to_numpy(), arrays.values.to_numpy(zero_copy_only=False)
            for i, (s, total, k) in enumerate(zip(batch.column("s").to_pylist(), batch.column("total").to_pylist(), batch.column("k").to_pylist(), strict=True)):
                if now is None or now["s"] != s:
                    if now:
                        end(now)
                    now, made = begin(s, total), made + 1
                there = arrays[i].is_valid
                x = flat[at[i] : at[i + 1]].astype(dtype) if there else np.zeros(0, dtype)
                if len(x) % symbols:
                    raise ValueError(f"sequence {k} has no whole number of frames")
                now["member"].write(x.tobytes())
                now["keys"].append(k)
                now["offsets"].append(now["at"])
                now["lengths"].append(len(x) // symbols if there else -1)
                now["at"] += len(x) // symbols
        if now:
            end(now)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["n"])

    at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _header(handle, member: zipfile.ZipInfo) -> tuple[int, np.dtype, tuple]:
    """Where an uncompressed array's data begin in the file, its type and its shape."""
    if member.compress_type != zipfile.ZIP_STORED:
        raise ValueError("compressed arrays can't be read by ranges")
    handle.seek(member.header_offset + 26)
    name, extra = struct.unpack("<HH", handle.read(4))
    begin = member.header_offset + 30 + name + extra
    handle.seek(begin)
    head = io.BytesIO(handle.read(4096))
    version = np.lib.format.read_magic(head)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if fortran:
        raise ValueError("frames must be stored one after another")
    return begin + head.tell(), kind, shape


INDEX = "path string, first long, dtype string, symbols int, keys array<string>, offsets array<long>, lengths array<int>"


def index_of(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each range of frames of at most ``batch_bytes``: where it begins, and whose frames it holds. No frames
    are read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path")

    def run(batches):
        for batch in batches:
            out = []
            for p in batch.column("path").to_pylist():
                fs, at = store(p)
                with fs.open_input_file(at) as handle:
                    archive = zipfile.ZipFile(handle)
                    begin, kind, shape = _header(handle, archive.getinfo("logits.npy"))
                    offsets, lengths, keys = (np.load(io.BytesIO(archive.read(f"{n}.npy")), allow_pickle=False) for n in ("offsets", "lengths", "utterance_ids"))
                frame = kind.itemsize * shape[1]
                held: list[int] = []
                for i in [*np.argsort(offsets, kind="stable").tolist(), None]:
                    if held and (i is None or (offsets[i] + max(lengths[i], 0) - offsets[held[0]]) * frame > batch_bytes):
                        first = int(offsets[held[0]])
                        out.append((p, begin + first * frame, kind.str, shape[1], [str(keys[j]) for j in held], [int(offsets[j]) - first for j in held], [int(lengths[j]) for j in held]))
                        held = []
                    if i is not None:
                        held.append(i)
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    return listed.mapInArrow(run, INDEX)


def read_packed(index: DataFrame) -> DataFrame:
    """(key, frames, symbols, dtype, values) of every sequence of an index: each row of it is one range read."""
    dealt = index.repartition(max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.sparkSession.sparkContext.defaultParallelism), "path", "first")

    def run(batches):
        for batch in batches:
            for p, first, kind, symbols, keys, offsets, lengths in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, at = store(p)
                end = max((o + max(n, 0) for o, n in zip(offsets, lengths, strict=True)), default=0)
                with fs.open_input_file(at) as handle:
                    handle.seek(first)
                    data = np.frombuffer(handle.read(end * symbols * np.dtype(kind).itemsize), kind).astype(np.float32)
                values = [data[o * symbols : (o + n) * symbols] if n >= 0 else None for o, n in zip(offsets, lengths, strict=True)]
                rows = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([n if n >= 0 else None for n in lengths], pa.int32()), pa.array([symbols] * rows, pa.int32()), pa.array([kind] * rows), pa.array(values, pa.list_(pa.float32()))], names=["key", "frames", "symbols", "dtype", "values"])

    return dealt.mapInArrow(run, "key string, frames int, symbols int, dtype string, values array<float>")

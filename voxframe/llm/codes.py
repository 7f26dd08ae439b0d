"""Vector codes: product codebooks by Lloyd rounds that keep running sums and shuffle only what changed its entry."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import discard, materialise, new_path, small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Sums travel in digits of so many bits, so that they are exact whatever the components and the number of rows.
DIGIT = 40
LONG = 2**63 - 1


def finite(column: str) -> F.Column:
    """Whether a vector and all its components are there and finite, once scaled too."""
    x = F.col(column)
    return F.coalesce(x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < float("inf")), F.lit(False))), F.lit(False))


class Grid:
    """Whole-number components of a batch, parts by place: int64 where no squared distance can leave 53 bits, else Python's."""

    def __init__(self, column: pa.ListArray, width: int):
        at, flat = column.offsets.to_numpy(), column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        lengths = np.diff(at)
        self.cells = np.zeros((len(lengths), PARTS * width))
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            self.cells[rows[:, None], np.arange(n)[None, :]] = flat[at[rows][:, None] + np.arange(n)[None, :]]
        self.width = width
        self.top = float(np.abs(self.cells).max(initial=0.0))

    def part(self, p: int) -> np.ndarray:
        return self.cells[:, p * self.width : (p + 1) * self.width]


def whole(cells: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers as Python's integers."""
    out = np.empty(cells.shape, object)
    out[...] = [[int(x) for x in row] for row in cells.tolist()]
    return out


def nearest(cells: np.ndarray, entries: list[list[int]], top: float) -> tuple[np.ndarray, list[int]]:
    """The nearest entry of each row (the lowest on ties) and the squared distance to it, exactly."""
    reach = max(top, max((abs(v) for e in entries for v in e), default=0))
    if 4.0 * reach * reach * max(1, cells.shape[1]) < 2.0**52:
        book = np.array(entries, np.float64).reshape(len(entries), cells.shape[1])
        square = (cells**2).sum(1)[:, None] - 2.0 * cells @ book.T + (book**2).sum(1)[None, :]
        best = square.argmin(1)
        return best, square[np.arange(len(best)), best].astype(np.int64).tolist()
    best, far = [], []
    for row in whole(cells):
        each = [sum((a - b) ** 2 for a, b in zip(row, e, strict=True)) for e in entries]
        best.append(each.index(min(each)))
        far.append(min(each))
    return np.array(best, np.int64), far


def _assigner(books, width: int, errors: bool):
    """Rows with their former code and the one by these codebooks; with the squared distances if asked for."""

    def run(batches):
        for batch in batches:
            grid = Grid(batch.column("v"), width)
            codes, far = np.zeros((batch.num_rows, PARTS), np.uint8), [0] * batch.num_rows
            for p, entries in enumerate(books.value):
                best, square = nearest(grid.part(p), entries, grid.top)
                codes[:, p] = best
                if errors:
                    far = [a + b for a, b in zip(far, square, strict=True)]
            new = pa.array([c.tobytes() for c in codes], pa.binary())
            if errors:
                digits = [[f & (2**DIGIT - 1), f >> DIGIT & (2**DIGIT - 1), min(f >> 2 * DIGIT, LONG)] for f in far]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), new, pa.array(digits, pa.list_(pa.int64()))], names=["id", "label", "code", "far"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), batch.column("code"), new], names=["id", "label", "v", "old", "code"])

    return run


def digits_of(x: int) -> list[int]:
    """Digits of a whole number, lowest first; all but the highest are positive."""
    out = []
    while not -(2**DIGIT) <= x < 2**DIGIT:
        out.append(x & (2**DIGIT - 1))
        x >>= DIGIT
    return [*out, x]


def _deltas(width: int):
    """What a task's changed parts take from their former entries and give to their new ones, summed within the task."""

    def run(batches):
        counts = np.zeros(PARTS * 256, np.int64)
        sums = np.zeros((PARTS * 256, width), object)
        for batch in batches:
            grid = Grid(batch.column("v"), width)
            new = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            former = batch.column("old").to_pylist()
            had = np.array([c is not None for c in former], bool)
            old = np.frombuffer(b"".join(c or bytes(PARTS) for c in former), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                changed = ~had | (old[:, p] != new[:, p])
                cells = grid.part(p)
                for codes, rows, sign in ((new, changed, 1), (old, changed & had, -1)):
                    if not rows.any():
                        continue
                    slot = p * 256 + codes[rows, p].astype(np.int64)
                    np.add.at(counts, slot, sign)
                    if grid.top * batch.num_rows < 2.0**52:
                        part = np.zeros((PARTS * 256, width))
                        np.add.at(part, slot, sign * cells[rows])
                        used = np.unique(slot)
                        sums[used] += whole(part[used])
                    else:
                        np.add.at(sums, slot, sign * whole(cells[rows]))
        rows = [(s, -1, 0, int(counts[s])) for s in np.flatnonzero(counts).tolist()]
        rows += [(s, j, k, d) for s in range(PARTS * 256) for j in range(width) if sums[s, j] for k, d in enumerate(digits_of(int(sums[s, j]))) if d]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["slot", "place", "digit", "change"])

    return run


def first_entries(rows: DataFrame, n: int = ENTRIES) -> list[tuple[int, list[float]]]:
    """The rows of the n smallest ids, ascending; of rows that repeat an id the smallest vector. A task sends n ids on."""

    def least(batches):
        best = np.zeros(0, np.int64)
        for batch in batches:
            best = np.unique(np.concatenate([best, batch.column(0).drop_null().to_numpy()]))[:n]
        yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64())], names=["id"])

    ids = [r[0] for r in rows.select("id").mapInArrow(least, "id long").distinct().orderBy("id").limit(n).collect()]
    if not ids:
        return []
    found = rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v")).collect()
    return sorted((r[0], list(r[1])) for r in found)


class Codebooks:
    """The entries, and the running sums and counts that they follow from; a round adds changes alone."""

    def __init__(self, first: list[list[float]], width: int):
        rows = [[int(x) for x in v] + [0] * (PARTS * width - len(v)) for v in first]
        self.width = width
        self.entries = [[r[p * width : (p + 1) * width] for r in rows] for p in range(PARTS)]
        self.counts: dict[int, int] = {}
        self.sums: dict[tuple[int, int], int] = {}

    def add(self, changes) -> None:
        """Takes (slot, place, digit, change); entries with parts become the floor of their mean, the others stay."""
        for slot, place, digit, change in changes:
            if place < 0:
                self.counts[slot] = self.counts.get(slot, 0) + change
            else:
                self.sums[slot, place] = self.sums.get((slot, place), 0) + (change << DIGIT * digit)
        for slot, n in self.counts.items():
            if n:
                self.entries[slot // 256][slot % 256] = [self.sums.get((slot, j), 0) // n for j in range(self.width)]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for e in part for v in e).encode()).hexdigest()


def train(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, far): each kept vector's code and squared distance by the final codebooks, and these.

    A round stores the rows with the code they had and the one they get; from that table, the parts whose code changed
    are subtracted from their former entry's sum and added to the new one's: a task shuffles at most one number for each
    entry's component. Former rounds' tables are deleted.
    """
    spark = vectors.sparkSession
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col)
    kept = vectors.where(finite(vector_col)).select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.transform(F.col(vector_col), lambda x: _floor(x.cast("double") * SCALE)).alias("v"))
    size = kept.agg(F.max(F.size("v"))).collect()[0][0]
    width = max(1, -(-(size or 0) // PARTS))
    first = first_entries(kept)
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", kept.schema["label"].dataType)])
    if not first:
        return kept.limit(0).select("id", "label", F.lit(b"").alias("code"), F.array().cast("array<long>").alias("far")), None
    books = Codebooks([v for _, v in first], width)
    binary, table, path = T.BinaryType(), kept.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        schema = T.StructType([*kind, kept.schema["v"], T.StructField("old", binary), T.StructField("code", binary)])
        sent, at = spark.sparkContext.broadcast(books.entries), new_path(spark, "codes")
        out = stored(table.mapInArrow(_assigner(sent, width, False), schema), at)
        moved = out.where("old IS NULL OR old <> code").select("v", "old", "code").mapInArrow(_deltas(width), "slot long, place long, digit long, change long")
        books.add(tuple(r) for r in moved.groupBy("slot", "place", "digit").agg(F.sum("change")).collect())
        if path:
            discard(spark, path)
        table, path = out.select("id", "label", "v", "code"), at
    sent = spark.sparkContext.broadcast(books.entries)
    schema = T.StructType([*kind, T.StructField("code", binary), T.StructField("far", T.ArrayType(T.LongType()))])
    done = materialise(table.mapInArrow(_assigner(sent, width, True), schema), "coded")
    if path:
        discard(spark, path)
    return done, books


def _floor(x: F.Column) -> F.Column:
    """The floor of a double as a double: beyond 2^52 it is whole as it is."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _long(lo: F.Column, mid: F.Column, hi: F.Column) -> F.Column:
    """A number of three digits (of any size) as a long; the largest long if none holds it."""
    carried = mid + F.shiftright(lo, DIGIT)
    top = hi + F.shiftright(carried, DIGIT)
    middle = carried.bitwiseAND(F.lit(2**DIGIT - 1))
    return F.when((top > 0) | (middle >= 2 ** (63 - DIGIT)), F.lit(LONG)).otherwise(F.shiftleft(middle, DIGIT) + lo.bitwiseAND(F.lit(2**DIGIT - 1)))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that is there and finite.

    Components become floor(256 x). A vector is cut into 16 equal parts; one of another length than the longest, or of
    no multiple of 16, counts as ended by zeros. Codebooks begin with the vectors of the 64 smallest ids (fewer, if there
    are fewer; null ids are none of them; of rows that repeat an id the smallest vector). Ties go to the lower index;
    entries without parts stay. Every row is coded, repeated ones and those of null ids too; null labels are one label.
    Codes, sums and distances are exact at any size; an error that no long holds is returned as the largest long.
    An empty table gives no rows; other columns may have any name. Without any id nothing can begin: no rows.
    """
    coded, books = train(vectors, id_col, vector_col, label_col, rounds)
    far = [F.col("far")[i] for i in range(3)]
    rows = coded.select(F.col("id").alias("vec_id"), "label", F.lower(F.hex("code")).alias("code"), *[f.alias(f"_f{i}") for i, f in enumerate(far)])
    sums = rows.groupBy(F.col("label").alias("_l")).agg(*[F.sum(f"_f{i}").alias(f"_s{i}") for i in range(3)])
    total = sums.select("_l", _long(*[F.col(f"_s{i}") for i in range(3)]).alias("label_error"))
    out = rows.join(small(materialise(total, "labels")), F.col("label").eqNullSafe(F.col("_l")))
    error = _long(*[F.col(f"_f{i}") for i in range(3)])
    return out.select("vec_id", "code", error.alias("error"), "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))

"""Exact top-k search by inner product: a precomputed table of distances to pivots bounds every candidate from above."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.llm.common import cut, materialise

#: Pivots of each length of vectors, chosen among a sample of so many rows: those whose ids have the smallest hashes.
#: Both are fixed whatever the input. The sample bears on speed alone: any pivots give right bounds.
PIVOTS, SAMPLE = 128, 4096
#: Queries in one pass over the table: the bound of what is broadcast.
BLOCK = 8192
#: One row in so many is searched first, so that the k-th scores found there spare the rest.
FIRST = 16
#: Table cells held at once, and candidates evaluated at a time, in bound order.
CELLS, STEP = 4_000_000, 64
#: Where the pivots nearest to a query leave more than this share, the others are not asked: scores cost no more than bounds.
MANY = 0.8
#: Bytes of queries in one pass at most.
BLOCK_BYTES = 64_000_000
LONG = 2**63 - 1


def quantised(column: str) -> F.Column:
    """floor(1024 x) of each component, a whole number held as a double: beyond 2^52 doubles are whole as they are.

    Null where the vector or a component is null or not finite (1024 times a component beyond 2^1013 is not).
    """
    x = F.transform(F.col(column), lambda v: v.cast("double") * 1024.0)
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v))
    return F.when(F.col(column).isNotNull() & good, whole)


def sortable(score: int) -> str:
    """A text that sorts as the whole number does, whatever its size."""
    digits = f"{abs(score):x}"
    if score >= 0:
        return f"1{len(digits):04x}{digits}"
    return f"0{0xFFFF - len(digits):04x}" + "".join("fedcba9876543210"[int(c, 16)] for c in digits)


def score_of(text: str) -> int:
    """The whole number of a sortable text."""
    if text[0] == "1":
        return int(text[5:], 16)
    return -int("".join("fedcba9876543210"[int(c, 16)] for c in text[5:]), 16)


def as_float(x: int | float) -> float:
    try:
        return float(x)
    except OverflowError:
        return np.inf if x > 0 else -np.inf


def _vectors(batch: pa.RecordBatch):
    """For each length of a batch's vectors: the places of its rows, and the vectors as a matrix."""
    column = batch.column("v")
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    lengths = np.diff(at)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), rows, flat[at[rows][:, None] + np.arange(n)[None, :]].astype(np.float64)


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: each next one is the vector farthest from those before (first on ties)."""
    chosen = [0]
    far = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def inner(vectors: np.ndarray, query: np.ndarray, exact: bool) -> list[int]:
    """Inner products as whole numbers: by floats where none can exceed 53 bits, else by integers of any size."""
    if exact:
        return (vectors @ query).astype(np.int64).tolist()
    mine = [int(x) for x in query]
    return [sum(int(a) * b for a, b in zip(v, mine, strict=True)) for v in vectors.tolist()]


class Slab:
    """Candidates of one length: ids, vectors, squared norms, and the table with a pivot's distances in a row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, table: np.ndarray):
        self.ids, self.vectors, self.norms = ids, vectors, norms
        self.table = np.ascontiguousarray(table.T)
        self.longest = float(np.sqrt(norms.max(initial=0.0)))

    def search(self, query: np.ndarray, norm: float, to_pivots: np.ndarray, query_id: int, k: int, floor: int | None, found: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
        """The best k of found and of these candidates that reach the floor, as (-score, id), and how many were evaluated.

        Query and candidate are at least as far apart as their distances to any pivot differ, and 2 q.x is
        |q|^2 + |x|^2 - d^2, so a score is bounded from above. Pivots near the query come first, and only what they
        leave meets the rest, if they spare a fair share at all. Candidates are evaluated in bound order until the bound falls below the k-th score or
        the floor; equal bounds are still evaluated, since ties go to the smaller id.
        """
        both = norm + self.norms

        def least():
            known = [x for x in (floor, -found[-1][0] if len(found) >= k else None) if x is not None]
            return max(known) if known else -np.inf

        # what rounding may take from a score or a distance: stored distances are floats of 32 bits
        slack = 1e-9 * both + 1.0
        live, far = np.arange(len(self.ids)), np.zeros(len(self.ids))
        order = np.argsort(to_pivots, kind="stable")
        bound = np.full(len(live), np.inf)
        for lo, hi in ((0, 8), (8, 32), (32, None)):
            if lo == 32 and len(live) > MANY * len(self.ids):
                break
            for p in order[lo:hi]:
                np.maximum(far, np.abs(self.table[p][live] - to_pivots[p]), out=far)
            lower = np.maximum(far - 1e-6 * (np.sqrt(both[live]) + far), 0.0)
            bound = (both[live] - lower**2) / 2.0 + slack[live]
            bound[~np.isfinite(bound)] = np.inf  # squares that no double holds bound nothing
            keep = bound >= as_float(least())
            live, far, bound = live[keep], far[keep], bound[keep]
        turn = np.argsort(-bound, kind="stable")
        live, bound = live[turn], bound[turn]
        exact = self.longest * np.sqrt(norm) < 2.0**52
        done, step = 0, STEP
        while done < len(live) and bound[done] >= as_float(least()):
            part = live[done : done + step]
            done += len(part)
            worst = least()
            more = [(-s, i) for s, i in zip(inner(self.vectors[part], query, exact), self.ids[part].tolist(), strict=True) if s >= worst and i != query_id]
            found = sorted([*found, *more])[:k]
            step = min(2 * step, 4096)
        return found, done


def _tabled(pivots):
    """Rows with their squared norms and distances to the pivots of their length."""

    def run(batches):
        of = pivots.value
        for batch in batches:
            norms, tables = np.zeros(batch.num_rows), [b""] * batch.num_rows
            for n, rows, vectors in _vectors(batch):
                norms[rows] = (vectors**2).sum(1)
                if n in of:
                    for i, row in zip(rows.tolist(), distances(vectors, of[n]).astype(np.float32), strict=True):
                        tables[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("first"), batch.column("v"), pa.array(norms), pa.array(tables, pa.binary())], names=["id", "first", "v", "norm", "t"])

    return run


def _tables(column, rows: np.ndarray) -> np.ndarray:
    flat = [column[int(i)].as_py() for i in rows]
    return np.frombuffer(b"".join(flat), np.float32).reshape(len(flat), -1)


def _searcher(asked, k: int):
    """Candidates of a table's rows for each query of a block: at most k rows a query, none below its floor."""

    def run(batches):
        queries = asked.value
        best: dict[int, list] = {}
        seen = 0
        for batch in batches:
            ids, all_norms = batch.column("id").to_numpy(), batch.column("norm").to_numpy()
            for n, rows, vectors in _vectors(batch):
                mine = queries.get(n)
                if not mine:
                    continue
                table = _tables(batch.column("t"), rows)
                size = max(256, CELLS // (n + table.shape[1] + 1))
                for lo in range(0, len(rows), size):
                    part = rows[lo : lo + size]
                    slab = Slab(ids[part], vectors[lo : lo + size], all_norms[part], table[lo : lo + size])
                    for q, vector, norm, to, floor in mine:
                        best[q], done = slab.search(vector, norm, to, q, k, floor, best.get(q, []))
                        seen += done
        out = [(q, i, sortable(-s), max(-LONG - 1, min(LONG, -s)), 0) for q, found in best.items() for s, i in found]
        out.append((None, None, None, 0, seen))
        cols = list(zip(*out, strict=True))
        kinds = [pa.string() if k == 2 else pa.int64() for k in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["query_id", "vec_id", "place", "score", "seen"])

    return run


def pivot_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The table (id, first, v, norm, t), stored once for all queries, and the sample that its pivots come from.

    ``t`` holds a row's distances to the pivots of its length; rows of a length that the sample lacks have none and are
    bounded by norms alone. ``first`` marks the share of the rows that is searched first.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    hashed = F.xxhash64("id", "v")
    # hashes are even, so a share of their range holds the smallest ones: no task gathers more than about twice the sample
    share = min(1.0, 2.0 * SAMPLE / max(1, rows.count()))
    near = rows.where(F.shiftrightunsigned(hashed, 32) <= int(share * 0xFFFFFFFF)).orderBy(hashed, "id").limit(SAMPLE)
    sample: dict[int, list] = {}
    for r in near.collect():
        sample.setdefault(len(r[1]), []).append((r[0], r[1]))
    held = {n: (np.array([i for i, _ in x]), np.array([v for _, v in x], np.float64).reshape(len(x), n)) for n, x in sample.items()}
    chosen = {n: choose_pivots(v, pivots) for n, (_, v) in held.items()}
    sent = spark.sparkContext.broadcast(chosen)
    first = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(FIRST)) == 0
    table = rows.select("id", first.alias("first"), "v").mapInArrow(_tabled(sent), "id long, first boolean, v array<double>, norm double, t binary")
    return materialise(table, "pivots"), held


def search_table(table: DataFrame, sample: dict, every: int = 100, k: int = 10, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Ranked results, and per pass how many candidates were evaluated, of all rows whose id divides by ``every``.

    A pass takes ``block`` queries (or BLOCK_BYTES of them) to executors, with a floor for each: first the k-th score among the sample, then the
    k-th among the rows searched first. So a task sends on only what may be in the result, however many tasks there are.
    """
    spark = table.sparkSession
    asked = table.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("v", "norm", "t")).alias("q"))
    n, size = asked.agg(F.count("*"), F.max(8 * F.size("q.v") + F.octet_length("q.t"))).first()
    blocks = max(1, -(-n // max(1, min(block, BLOCK_BYTES // max(1, size or 1)))))
    asked = asked if blocks == 1 else cut(asked)
    order = W.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    found = seen = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(blocks)) == b)
        queries: dict[int, list] = {}
        for r in part.orderBy("id").collect():
            v = np.array(r[1][0], np.float64)
            queries.setdefault(len(v), []).append([r[0], v, r[1][1], np.frombuffer(bytes(r[1][2]), np.float32).astype(np.float64), None])
        for n, mine in queries.items():
            ids, vectors = sample.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
            slab = Slab(ids, vectors, (vectors**2).sum(1), np.zeros((len(ids), 0)))
            for q in mine:
                got, _ = slab.search(q[1], q[2], np.zeros(0), q[0], k, None, [])
                q[4] = -got[-1][0] if len(got) == k else None
        schema = "query_id long, vec_id long, place string, score long, seen long"
        sent = spark.sparkContext.broadcast(queries)
        early = cut(table.where("first").mapInArrow(_searcher(sent, k), schema))
        ranked = early.where("query_id IS NOT NULL").withColumn("rank", F.row_number().over(order))
        floors = {r[0]: score_of(r[1]) for r in ranked.where(F.col("rank") == k).select("query_id", "place").collect()}
        for mine in queries.values():
            for q in mine:
                known = [x for x in (q[4], floors.get(q[0])) if x is not None]
                q[4] = max(known) if known else None
        late = cut(table.where("NOT first").mapInArrow(_searcher(spark.sparkContext.broadcast(queries), k), schema))
        both = early.unionAll(late)
        top = both.where("query_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top, work = cut(top) if blocks > 1 else top, both.agg(F.sum("seen").alias("evaluated"))
        found, seen = (top, work) if found is None else (found.unionAll(top), seen.unionAll(work))
    return found.select("query_id", "rank", "vec_id", "score"), seen


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id divides by ``every``, its k best other rows, exactly.

    Scores are integer inner products of floor(1024 x); ties go to the smaller id. Null ids and null vectors, and such
    with null or non-finite components, take no part; vectors of another length than the query's share no score with
    it. Ranks follow exact scores of any size; a score that no long holds is returned as the nearest long. Rows that repeat an id are candidates each (never for their own id) and one query:
    the first by components. Empty tables give no rows; other columns may have any name. The table of distances is
    stored once; a pass over it serves ``block`` queries, or as many as are BLOCK_BYTES.
    """
    table, sample = pivot_table(vectors, id_col, vector_col, pivots)
    return search_table(table, sample, every, k, block)[0]

"""Ordered folds with a reset: session packs and batches under a budget.

The state of a fold depends on where it last reset, which no window frame can say. Rows are dealt by group and sorted, and
a running state of a few numbers walks over them in Arrow batches, so no group is ever held whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold_groups(df: DataFrame, group: list[str], order: list[str], cost: str, budget: float, running_max: bool = False, guard: bool = True) -> DataFrame:
    """Adds ``pack`` (from 0 in each group): a new pack starts where the cost would exceed the budget.

    With ``running_max`` the cost of a pack is its largest cost times its size. Without ``guard`` an empty pack is
    closed too, so a first row above the budget starts at pack 1. Null costs count as 0.
    """

    def run(batches):
        key, held, size, pack = None, 0.0, 0, 0
        for batch in batches:
            packs = []
            for this, c in zip(zip(*[batch.column(g).to_pylist() for g in group], strict=True), batch.column(cost).to_pylist(), strict=True):
                if this != key:
                    key, held, size, pack = this, 0.0, 0, 0
                c = float(c or 0.0)
                most = max(held, c)
                if (most * (size + 1) if running_max else held + c) > budget and (size or not guard):
                    held, size, pack = c, 1, pack + 1
                else:
                    held, size = (most if running_max else held + c), size + 1
                packs.append(pack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int32())], names=[*batch.schema.names, "pack"])

    rows = df.repartition(*group).sortWithinPartitions(*group, *order)
    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("pack", T.IntegerType())]))


def pack_sessions(u: DataFrame, limit: float = 30.0) -> DataFrame:
    """Packs of a child's session in order, at most ``limit`` seconds each unless one utterance is longer."""
    packed = fold_groups(u.select("child_id", "session_id", "utterance_id", "text", "duration"), ["child_id", "session_id"], ["utterance_id"], "duration", limit)
    rows = F.array_sort(F.collect_list(F.struct("utterance_id", "text", "duration")))
    out = packed.groupBy("child_id", "session_id", "pack").agg(rows.alias("r"))
    return out.select(
        F.substring(F.md5(F.concat_ws("_", "child_id", F.col("session_id").cast("string"), F.col("pack").cast("string")).cast("binary")), 1, 10).alias("id"),
        "child_id", "session_id", "pack", F.size("r").alias("n"), F.aggregate("r", F.lit(0.0), lambda a, x: a + x["duration"]).alias("duration"), F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"), F.array_join(F.transform("r", lambda x: x["utterance_id"]), ",").alias("source_ids"),
    )

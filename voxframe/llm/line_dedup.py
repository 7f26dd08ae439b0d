"""Line dedup (native): lines that several documents hold stay in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import SPACES, ascii_lower, cut, text_key


def _rows(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    a, b = text_key(text)
    return docs.select(F.col(id_col).alias("_id"), a.alias("_a"), b.alias("_b"), F.split(text, "\n", -1).alias("_lines"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Per (id, text): the positions of the lines that go, as an array.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. The count of distinct documents per
    key is summed before the shuffle; the key's lines go with 128 bits of hash in place of the line. Lines of a very
    common key are spread by Spark's skew join.
    """
    rows = _rows(docs, id_col, text_col, []).select("_id", "_a", "_b", F.posexplode("_lines").alias("_pos", "_line"))
    key = F.trim(ascii_lower(F.col("_line")), F.lit(SPACES))
    rows = rows.select("_id", "_a", "_b", "_pos", key.alias("_key")).where(F.length("_key") >= min_chars)
    rows = rows.select("_id", "_a", "_b", "_pos", F.xxhash64("_key").alias("_k"), F.xxhash64(F.lit(11), "_key").alias("_l"))
    if min_docs == 2:  # two distinct ids: the smallest differs from the largest
        counts = rows.groupBy("_k", "_l").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most"), F.max(F.col("_id").isNull()).alias("_null"))
        counts = counts.where((F.col("_least") < F.col("_most")) | (F.col("_least").isNotNull() & F.col("_null")))
    else:
        counts = rows.groupBy("_k", "_l", "_id").agg(F.lit(1).alias("_one")).groupBy("_k", "_l").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
        counts = counts.where(F.col("_n") >= min_docs)
    # cut: read from a table, both sides of the join are plain shuffles, of which Spark can split the skewed ones
    found = rows.join(cut(counts.select("_k", "_l", "_least")), ["_k", "_l"]).where(~F.col("_id").eqNullSafe(F.col("_least")))
    return found.groupBy("_id", "_a", "_b").agg(F.collect_set("_pos").alias("_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All rows of docs with ``kept_text``, ``n_lines`` (before) and ``n_dropped``; other columns in the struct ``row``.

    Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines except in
    the document of smallest id. Null or empty text is one empty line. A null id counts as one document that is never
    the smallest. Rows that repeat an id are one document: each is read as that document's lines. An empty table gives
    no rows. Any other columns, whatever their names, stay in ``row``. Keys repeated inside one document only stay.
    """
    rows = _rows(docs, id_col, text_col, docs.columns)
    drops = dropped_lines(docs, id_col, text_col, min_chars, min_docs).select(F.col("_id").alias("_i"), F.col("_a").alias("_x"), F.col("_b").alias("_y"), "_drop")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))
    n = F.size("_lines")
    numbered = rows.join(drops, same, "left").select("_row", "_lines", n.alias("_n"), F.coalesce(F.size("_drop"), F.lit(0)).alias("_gone"), F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("_drop", F.array().cast("array<int>"))).alias("_kept"))
    text = F.when(F.col("_gone") == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    return numbered.select(F.col("_row").alias("row"), text.alias("kept_text"), F.col("_n").cast("long").alias("n_lines"), F.greatest("_gone", F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """The digest of op9: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

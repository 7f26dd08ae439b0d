"""Benchmark decontamination: token windows of test items looked for in all training texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.llm.common import ALNUM, as_bytes, ascii_lower, bounded_batches, chunks, cut, materialise, small, text_key

#: Words in a window.
WINDOW = 13
#: Bytes of benchmark text in one broadcast; a larger benchmark is scanned in several blocks, one after another.
BLOCK_BYTES = 16_000_000
#: Words of an item that stand together in a block; longer items are cut into parts that overlap by a window less one.
PART = 50_000
#: Words scanned at once.
SLAB = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words of letters, digits and what lies above ASCII, with A-Z lower-cased."""
    return text.translate(ALNUM).split()


def _rolling(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(starts), np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _P + ids[starts + k].astype(np.uint64)
    return h


class Windows:
    """The distinct windows of some items as arrays: hashes sorted for search, words for proof, and who holds each.

    A window is kept by its place in the words of all items end to end, so a word of an item costs a few numbers.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        flat: list[np.ndarray] = []
        by: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        at = 0
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32)
            n = min(window, len(ids))
            if n:
                starts, who = by[n]
                starts.append(at + np.arange(len(ids) - n + 1))
                who.append(np.full(len(ids) - n + 1, number[item], np.int32))
            flat.append(ids)
            at += len(ids)
        self.words = np.concatenate([*flat, np.zeros(0, np.int32)])
        self.tables = [(n, *self._table(n, np.concatenate(starts), np.concatenate(who))) for n, (starts, who) in sorted(by.items())]

    def _table(self, n: int, starts: np.ndarray, who: np.ndarray):
        """Of each distinct window its hash and one place; and the numbers of its items end to end, with where they begin."""
        h = _rolling(self.words, starts, n)
        order = np.lexsort((who, h))
        h, starts, who = h[order], starts[order], who[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        for k in range(n):
            new[1:] |= self.words[starts[1:] + k] != self.words[starts[:-1] + k]
        first = np.flatnonzero(new)
        return h[first], starts[first], who, np.append(first, len(h))

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """For each window length: places where a window stands in ids, and the items that hold it. Id 0 is no item's word."""
        known = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, hashes, places, who, at in self.tables:
            if len(ids) < n:
                continue
            starts = np.flatnonzero(known[n:] == known[:-n])
            if not len(starts):
                continue
            h = _rolling(ids, starts, n)
            k = np.searchsorted(hashes, h)
            found, windows = [], []
            while True:
                live = np.flatnonzero(k < len(hashes))
                live = live[hashes[k[live]] == h[live]]
                if not len(live):
                    break
                h, k, starts = h[live], k[live], starts[live]
                same = np.ones(len(k), bool)
                for j in range(n):
                    same &= self.words[places[k] + j] == ids[starts + j]
                found.append(starts[same])
                windows.append(k[same])
                # other windows of the same hash
                k = k + 1
            if found:
                yield n, np.concatenate(found), [who[at[w] : at[w + 1]] for w in np.concatenate(windows).tolist()]


def _scan(index):
    """A function of texts that finds the hits and the items of one block of the benchmark."""

    @F.arrow_udf("n_words long, n_hit long, mask binary, items array<string>")
    def run(column: pa.Array) -> pa.Array:
        windows = index.value
        get = windows.vocab.get
        texts = as_bytes(column)
        counts: list[int] = []
        n_hit, masks, items = [0] * len(texts), [None] * len(texts), [None] * len(texts)
        for lo, hi in chunks([len(t) // 6 + 1 for t in texts], SLAB):
            ids, at = [], [0]
            for t in texts[lo:hi]:
                ids += [get(w, 0) for w in words_of(t)]
                ids.append(0)
                at.append(len(ids))
            ids, at = np.array(ids, np.int32), np.array(at)
            counts += (np.diff(at) - 1).tolist()
            step, touched = np.zeros(len(ids) + 1, np.int32), defaultdict(list)
            for n, places, who in windows.hits(ids):
                np.add.at(step, places, 1)
                np.add.at(step, places + n, -1)
                for d, holders in zip((np.searchsorted(at, places, "right") - 1).tolist(), who, strict=True):
                    touched[d].append(holders)
            hit = np.cumsum(step[:-1]) > 0
            for d, holders in touched.items():
                mine = hit[at[d] : at[d + 1] - 1]
                n_hit[lo + d], masks[lo + d] = int(mine.sum()), np.packbits(mine).tobytes()
                items[lo + d] = sorted(windows.names[i] for i in np.unique(np.concatenate(holders)).tolist())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(masks, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["n_words", "n_hit", "mask", "items"])

    return run


@F.arrow_udf(T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("mask", T.BinaryType())]))
def _merged(masks: pa.Array) -> pa.Array:
    """The masks of one text, found by several blocks, as one."""
    out = []
    for many in masks.to_pylist():
        mask = np.frombuffer(many[0], np.uint8).copy()
        for other in many[1:]:
            mask |= np.frombuffer(other, np.uint8)
        out.append((int(np.unpackbits(mask).sum()), mask.tobytes()))
    return pa.StructArray.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([m for _, m in out], pa.binary())], names=["n_hit", "mask"])


def _parts(window: int):
    """Items in parts of bounded length; every window of an item stands whole in one of them."""

    def run(batches):
        for batch in batches:
            names, texts = [], []
            for item, text in zip(batch.column("_item").to_pylist(), as_bytes(batch.column("_text")), strict=True):
                words = words_of(text)
                for lo in range(0, max(1, len(words) - window + 1), PART):
                    part = words[lo : lo + PART + window - 1]
                    if part:
                        names.append(item)
                        texts.append(b" ".join(part))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], names=["_item", "_text"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows of docs in ``row``, with n_words, n_hit, items (sorted, whose windows occur) and a mask of hit words.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; an item without words has
    none. A word inside any occurrence of a window is hit. Null texts have no words; null item ids are left out. Rows
    that repeat, columns of any other name, and empty tables on either side are fine. The benchmark's bytes are summed
    first. One block of about ``block_bytes`` is broadcast and meets docs in one pass without a shuffle. A larger
    benchmark goes block by block: each pass stores the hits of the texts that have some and frees its block, so
    neither driver nor executors hold more than one; hits are then merged by text. Hits of a hash are proved word by word.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(id_col).cast("string").alias("_item"), F.col(text_col).cast("binary").alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL")
    items = items.mapInArrow(_parts(window), "_item string, _text binary")
    total = items.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # only the texts go to Python; the other columns wait in the JVM
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    none = F.array().cast("array<string>")
    if blocks == 1:
        index = spark.sparkContext.broadcast(Windows([(r[0], bytes(r[1])) for r in items.toLocalIterator()], window))
        out = rows.select("row", _scan(index)(F.col("row.text").cast("binary")).alias("_x")).select("row", "_x.*")
        return out.select("row", "n_words", "n_hit", F.coalesce("items", none).alias("items"), "mask")
    items, found = cut(items), None
    a, b = text_key(F.col("text"))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == k)
        index = spark.sparkContext.broadcast(Windows([(r[0], bytes(r[1])) for r in part.toLocalIterator()], window))
        hits = docs.select(a.alias("_a"), b.alias("_b"), _scan(index)(F.col("text").cast("binary")).alias("_x")).where("_x.n_hit > 0")
        hits = materialise(hits.select("_a", "_b", "_x.mask", "_x.items").dropDuplicates(["_a", "_b"]), "hits")
        index.destroy()
        found = hits if found is None else found.unionAll(hits)
    # a text has at most one row of each block
    merged = found.groupBy("_a", "_b").agg(F.collect_list("mask").alias("_masks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), _merged("_masks").alias("_m"), "items").select("_x", "_y", "_m.*", "items")
    merged = small(cut(merged))
    a, b = text_key(F.col("row.text"))
    out = rows.withColumns({"_a": a, "_b": b}).join(merged, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
    n_words = F.coalesce(F.regexp_count(ascii_lower(F.col("row.text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    return out.select("row", n_words.alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), "mask")


def contaminated(share: int = 20):
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated: hit words, if any, make less than a twentieth of theirs.

    Null and empty texts stay; repeated rows stay or go together; an empty benchmark takes nothing; columns of any name stay.
    """
    out = contamination(docs, benchmark, **options).where(~contaminated())
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def remove_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All rows of docs, with hit words cut from the texts; the rest of a text stays byte by byte.

    Null texts stay null; repeated rows are cut alike; an empty benchmark cuts nothing; columns of any name stay.
    """

    def run(batches):
        import regex

        word = regex.compile(rb"[0-9A-Za-z\x80-\xff]+")
        for batch in batches:
            texts = []
            for text, mask in zip(batch.column("_text").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                if text and mask:
                    flags = np.unpackbits(np.frombuffer(mask, np.uint8))
                    at, kept = 0, []
                    for i, m in enumerate(word.finditer(text)):
                        if flags[i]:
                            kept.append(text[at : m.start()])
                            at = m.end()
                    text = b"".join([*kept, text[at:]])
                texts.append(None if text is None else text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "_clean"])

    out = contamination(docs, benchmark, **options)
    out = out.select("row", F.col("row.text").cast("binary").alias("_text"), "mask")
    out = out.mapInArrow(run, T.StructType([T.StructField("row", out.schema["row"].dataType), T.StructField("_clean", T.StringType())]))
    return out.select(*[(F.col("_clean") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of op5: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))

"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter, and their usual forms."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import ascii_lower, cut, materialise, small, swept

#: A word's letters, the fewest code points and occurrences, one run in so many that loses a code point, and how much
#: more often a form occurs than its variant. Fixed values.
RUN, LEAST, OFTEN, SLIP, TIMES = r"[A-Za-zÀ-ÿ]{7,}+", 7, 2, 31, 10
#: The index is of pairs of letters. One edit breaks at most two of them, so words of at most n letters share n - 3.
Q = 2
#: A block of more postings than this is divided by its words' rarest pairs; found on one word in so many, for speed alone.
HOT, SEEN = 20_000, 16
#: A block of so few words is verified without an index.
FEW = 6


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n): the words of all whole texts with their slips, of at least 7 code points and at least 2 occurrences."""
    runs = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0)))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), runs.alias("_run")).select("_id", ascii_lower(F.col("_run")).alias("w"))
    h = F.crc32(F.concat("_id", F.lit(":"), "w").cast("binary"))
    slipped = F.expr(f"CASE WHEN h % {SLIP} = 0 THEN concat(substring(w, 1, cast(h % length(w) as int)), substring(w, cast(h % length(w) as int) + 2)) ELSE w END")
    return each.withColumn("h", h).select(slipped.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)


def blocks_of(words: DataFrame) -> DataFrame:
    """Four postings a word: (size, side, chunk, long, word, n).

    Two words one edit apart, the longer of ``size`` letters, share its first or its second half, a long q-gram at a known
    place: the edit is in the other one. A word is the longer (or as long as the other) under its own size and the
    shorter under the next.
    """
    n, w = F.length("word"), F.col("word")
    out = []
    for long in (True, False):
        size = n if long else n + 1
        half = F.floor(size / 2).cast("int")
        begin = half if long else half - 1
        out += [F.struct(size.cast("int").alias("size"), F.lit(side).alias("side"), chunk.alias("chunk"), F.lit(long).alias("long")) for side, chunk in ((0, F.substring(w, F.lit(1), half)), (1, F.substring(w, begin + 1, n)))]
    return words.select(F.explode(F.array(*out)).alias("b"), "word", "n").select("b.*", "word", "n")


def grams(word: str, long: bool) -> list[str]:
    """Pairs of letters with their places in the longer word; a shorter word's stand where they are or one further."""
    own = [chr(p) + word[p : p + Q] for p in range(len(word) - Q + 1)]
    return own if long else own + [chr(ord(g[0]) + 1) + g[1:] for g in own]


def one_edit(a: str, b: str) -> bool:
    """Whether two different words, a not the shorter, differ by one code point put in, lost or replaced."""
    i = 0
    for i, (x, y) in enumerate(zip(a, b, strict=False)):  # noqa: B007
        if x != y:
            break
    else:
        i = len(b)
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def pairs_in(size: int, members: list[tuple[str, bool]]) -> Iterator[tuple[int, int]]:
    """Places of members one edit apart, the first a long one.

    The postings of a word's pairs of letters hold the words before it (long ones) and all short ones that have the pair
    where the length and position limits let it be. A near word stands in size - 3 of size - 1 postings, so in one of
    the three shortest at least: these are merged by a heap. What they name is counted against the bound and verified.
    """
    if len(members) <= FEW:
        for i, (a, long) in enumerate(members):
            if long:
                yield from ((i, j) for j, (b, other) in enumerate(members) if (j < i or not other) and one_edit(a, b))
        return
    bound = size - 1 - Q
    postings: dict[str, list[int]] = {}
    held: dict[int, frozenset[str]] = {}
    for j, (b, long) in enumerate(members):
        if not long:
            held[j] = frozenset(grams(b, False))
            for g in held[j]:
                postings.setdefault(g, []).append(j)
    early: dict[str, list[int]] = {}
    for i, (a, long) in enumerate(members):
        if not long:
            continue
        mine = grams(a, True)
        for found in (postings, early):
            lists = sorted((found.get(g, ()) for g in mine), key=len)
            last = -1
            for j in heapq.merge(*lists[: len(mine) - bound + 1]):
                if j != last and len(held[j].intersection(mine)) >= bound and one_edit(a, members[j][0]):
                    yield i, j
                last = j
        held[i] = frozenset(mine)
        for g in mine:
            early.setdefault(g, []).append(i)


def rare_grams(word: str, size: int, side: int, long: bool, rank: dict[str, int]) -> list[str]:
    """Of the pairs that are not within the shared half, the rarest: three of a long word, two of a short one, with places."""
    half = size // 2
    lo, hi = (half - 1, len(word) - 1) if side == 0 else (0, half if long else half - 1)
    best = sorted(range(lo, hi), key=lambda p: (rank.get(word[p : p + Q], 0), word[p : p + Q], p))[: 3 if long else 2]
    own = [chr(p) + word[p : p + Q] for p in best]
    return own if long else list(dict.fromkeys(own + [chr(ord(g[0]) + 1) + g[1:] for g in own]))


def _divided(rank):
    """Postings of large blocks, once for each of a word's rarest pairs."""

    def run(batches):
        for batch in batches:
            rows = []
            for size, side, chunk, long, word, n in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                rows += [(size, side, chunk, long, word, n, g) for g in rare_grams(word, size, side, long, rank.value)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["size", "side", "chunk", "long", "word", "n", "gram"])

    return run


def _neighbours(rank):
    """Per word of a block: how many words are near it, and the most frequent of them. Rows come sorted by block."""

    def solved(key, block):
        size, side, chunk, gram = key
        found: dict[str, list] = {}
        for i, j in pairs_in(size, [(w, long) for w, long, _ in block]):
            (a, _, n), (b, other, m) = block[i], block[j]
            half = size // 2
            if side == 1 and a[:half] == b[:half]:
                continue  # the pair shares both halves and is told in the other block
            if gram and gram != min(set(rare_grams(a, size, side, True, rank.value)).intersection(rare_grams(b, size, side, other, rank.value))):
                continue
            for x, y, k in ((a, b, m), (b, a, n)):
                entry = found.setdefault(x, [0, 0, ""])
                entry[0] += 1
                if (-k, y) < (-entry[1], entry[2]):
                    entry[1:] = [k, y]
        return found

    def run(batches):
        key, block = None, []
        for batch in batches:
            out = []
            for size, side, chunk, gram, word, long, n in zip(*[batch.column(c).to_pylist() for c in ("size", "side", "chunk", "gram", "word", "long", "n")], strict=True):
                if key != (size, side, chunk, gram):
                    if len(block) > 1:
                        out += [(w, *x) for w, x in solved(key, block).items()]
                    key, block = (size, side, chunk, gram), []
                block.append((word, long, n))
            yield _rows(out)
        yield _rows([(w, *x) for w, x in solved(key, block).items()] if len(block) > 1 else [])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "top_n", "top"])


def neighbours(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n_near, top_n, top): of each word that has words one edit away, their number and the most frequent one."""
    spark = words.sparkSession
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(Q))))
    # pairs of 90 letters: at most 8,100 rows
    rank = spark.sparkContext.broadcast({g: i for i, (g, _) in enumerate(sorted(((r[0], r[1]) for r in words.select(pair.alias("g")).groupBy("g").count().collect()), key=lambda x: (x[1], x[0])))})
    postings = blocks_of(words)
    block = ["size", "side", "chunk"]
    many = blocks_of(words.where(F.pmod(F.xxhash64("word"), F.lit(SEEN)) == 0)).groupBy(*block).count().where(F.col("count") * SEEN > hot).select(*block)
    many = cut(many)
    rows = postings.withColumn("gram", F.lit(""))
    if many.limit(1).count():
        large = postings.join(small(many), block, "left_semi").select(*postings.columns)
        rows = postings.join(small(many), block, "left_anti").select(*postings.columns).withColumn("gram", F.lit(""))
        rows = rows.unionByName(large.mapInArrow(_divided(rank), rows.schema))
    key = [*block, "gram"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key)
    near = dealt.mapInArrow(_neighbours(rank), "word string, near long, top_n long, top string")
    return near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("top_n")).alias("m"), "top")).alias("t")).select("word", "n_near", (-F.col("t.m")).alias("top_n"), "t.top")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round every word takes what its present end leads to, so few rounds do.

    Forms occur ten times as often as their variants, so chains end, and soon.
    """
    ends = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ends.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        further = cut(ends.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_w").isNotNull().alias("_more")))
        ends = further.select("word", "root")
        if not further.where("_more").limit(1).count():
            return ends


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least 7 code points that occurs at least twice.

    All whole texts are read; n counts occurrences over all of them. A word's form is the most frequent word one edit away
    (ties: the first in code-point order), if it occurs ten times as often; the root is where forms lead. Null and empty
    texts have no words; a null id counts as the text 'null'; rows that repeat count each; an empty table gives no rows;
    other columns may have any name. A task holds one block of words that share half their letters at one place; large
    blocks are divided by their words' rarest pairs of letters, so no task compares all words of one.
    """
    spark = docs.sparkSession
    with swept(spark):
        words = materialise(count_words(docs, id_col, text_col), "words")
        near = neighbours(words, hot).select(F.col("word").alias("_word"), "n_near", "top_n", "top")
        known = materialise(words.join(near, F.col("word") == F.col("_word"), "left").drop("_word"), "near")
        good = F.col("top_n") >= TIMES * F.col("n")
        known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("top")).alias("form"), F.when(good, F.col("top_n")).alias("form_n"))
        ends = roots(known.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    out = known.join(ends, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Edit distances and error rates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most edits that a band of the table allows for, one try after another; the last is the whole table.
BANDS = (24, 96, 384, 2**30)


def char_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance in code points; equal texts skip the table.

    Texts that differ little need a band of it only, so bands of growing width are tried until one holds the path.
    """
    tries = F.array(*[F.lit(k) for k in BANDS])
    banded = F.aggregate(tries, F.lit(-1), lambda found, k: F.when(found >= 0, found).otherwise(F.call_function("levenshtein", a, b, k)))
    return F.when(a == b, 0).otherwise(banded)


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays, one row of the table at a time."""
    first = F.sequence(F.lit(0), F.size(b))

    def row(acc, x):
        def cell(left, z):
            best = F.least(F.element_at(left, -1) + 1, z["up"] + 1, z["diagonal"] + F.when(z["y"] == x, 0).otherwise(1))
            return F.concat(left, F.array(best))

        steps = F.arrays_zip(b.alias("y"), F.slice(acc, F.lit(2), F.size(b)).alias("up"), F.slice(acc, F.lit(1), F.size(b)).alias("diagonal"))
        return F.aggregate(steps, F.array(F.element_at(acc, 1) + 1), cell)

    # an empty side makes an empty table, and a sequence of 0 alone
    return F.when(F.size(b) == 0, F.size(a)).otherwise(F.element_at(F.aggregate(a, first, row), -1))


#: Distinct words that can be told apart as characters.
CODES = 1_000_000


def coded(words: Column, vocab: Column) -> Column:
    """Each word as one character: its place in the vocabulary, past the surrogates, in UTF-32."""

    def digits(w: Column) -> Column:
        at = F.array_position(vocab, w) + 256
        return F.lpad(F.hex(at + F.when(at >= 0xD800, 0x800).otherwise(0)), 8, "0")

    return F.decode(F.unhex(F.array_join(F.transform(words, digits), "")), "UTF-32")


def with_word_distance(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the word Levenshtein distance of two array columns.

    Each distinct word of a pair becomes one character, and the built-in distance of characters does the rest; pairs
    of more distinct words than there are such characters go cell by cell.
    """
    out = df.withColumn("_vocab", F.array_distinct(F.concat(a, b)))
    fast = char_distance(coded(F.col(a), F.col("_vocab")), coded(F.col(b), F.col("_vocab")))
    ed = F.when(F.col(a) == F.col(b), 0).when(F.size("_vocab") < CODES, fast).otherwise(word_distance(F.col(a), F.col(b)))
    return out.withColumn(name, ed).drop("_vocab")


def rate(edits: Column, length: Column) -> Column:
    """Errors by reference length; an empty reference gives 0 or 1."""
    return F.when(length > 0, edits / length).otherwise(F.when(edits > 0, 1.0).otherwise(0.0))


def safe_cer(ref: Column, hyp: Column) -> Column:
    return rate(char_distance(ref, hyp), F.length(ref))

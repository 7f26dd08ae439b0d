"""Row filters of manifest preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_quality(df: DataFrame, cer_limits: dict[str, float] | None, wer_limits: dict[str, float] | None, mode: str = "and", bucket: str = "age_bucket") -> DataFrame:
    """Rows whose error rates are within their bucket's limits.

    A bucket without limits passes whole, a missing limit is no test, a null or NaN rate fails its test. ``mode`` says
    whether both tests must hold or either. The limits are literals, so no join is needed.
    """

    def limit(limits):
        pairs = [F.lit(x) for kv in (limits or {}).items() for x in kv]
        return F.element_at(F.create_map(*pairs), F.col(bucket)) if pairs else F.lit(None).cast("double")

    def within(value: str, at: Column) -> Column:
        return F.coalesce((F.col(value) <= at) & ~F.isnan(value), F.lit(False))

    cer, wer = limit(cer_limits), limit(wer_limits)
    both = within("cer", cer) & within("wer", wer) if mode == "and" else within("cer", cer) | within("wer", wer)
    keep = F.when(cer.isNull() & wer.isNull(), True).when(cer.isNull(), within("wer", wer)).when(wer.isNull(), within("cer", cer)).otherwise(both)
    return df.where(F.coalesce(keep, F.lit(True)))


def is_valid_entry(text: Column, duration: Column, bad: Column, longest: float = 30.0, chars_per_second: float = 20.0) -> Column:
    return ~bad & (duration < longest) & ((duration <= 0) | (F.length(text) / duration <= chars_per_second))


def is_ctc_feasible(duration: Column, label_len: Column, rate: int = 16000, hop: int = 320) -> Column:
    frames = F.floor((F.greatest(duration, F.lit(0.0)) * rate).cast("int") / hop)
    return (frames > label_len) & (label_len > 0) & (frames > 0)


def check_ratio(df: DataFrame, bad: Column, most: float = 0.05) -> None:
    """Raises if more than this share of rows is bad; one row of sums comes to the driver."""
    n, k = df.agg(F.count("*"), F.count_if(bad)).first()
    if n and k / n > most:
        raise ValueError(f"{k} of {n} rows are bad")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, with a plan that fails where a key comes twice."""
    twice = df.groupBy(*key).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} is not unique")
    return df

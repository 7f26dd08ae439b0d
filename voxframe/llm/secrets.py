"""Secret scans (native): pattern spans, and how widely the corpus owns each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxframe.llm.common import cut

#: (kind, pattern, group that holds the secret, fewest characters of that group). The first three.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: The method's own candidates: unbroken runs of 20 characters or more that are shaped like a drawn key.
OWNED = ("owned", r"[A-Za-z0-9_+/=-]{20,}+", 0, 20)
#: Beginnings that issuers give to their keys. Fixed values.
ISSUED = r"^(?:gh[pousr]_|github_pat_|glpat-|sk[-_]|[prs]k_(?:live|test)_|xox[abeoprs]-|AIza|npm_|hf_|dop_v1_|shp(?:at|ss)_|pypi-|eyJ)"
#: A place between two letters or digits of different kinds: lower case, upper case, digit.
TURN = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
#: Identifiers that are drawn but open nothing.
UUID = r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: So many different characters make a key; letters of both cases and digits turn at so large a share of its places,
#: letters of one case and digits at so large a one, with so large a share of digits, in so many runs.
DIFFERENT, TURNS, TURNS_ONE, DIGITS_ONE, RUNS_ONE = 10, 0.4, 0.25, 0.15, 3
#: A candidate that more owners or more repositories than these hold is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 10


def drawn(s: Column) -> Column:
    """Whether a run is shaped like a drawn key: its kinds of characters take turns as chance would have them, and vary.

    Words, paths, names and dates keep to one kind of character over whole parts, so they turn seldom. What begins as
    issuers let their keys begin needs only a digit and variety.
    """
    digits, runs, turns = (F.regexp_count(s, F.lit(p)) for p in ("[0-9]", "[0-9]+", TURN))
    n = F.length(s)
    words = n - F.length(F.regexp_replace(s, "[A-Z]?[a-z]{3,}", ""))
    three = s.rlike("[a-z]") & s.rlike("[A-Z]") & (turns >= TURNS * n) & (words * 2 <= n)
    one = ~(s.rlike("[a-z]") & s.rlike("[A-Z]")) & (turns >= TURNS_ONE * n) & (digits >= DIGITS_ONE * n) & (runs >= RUNS_ONE)
    return (digits > 0) & (three | one | s.rlike(ISSUED)) & (F.size(F.array_distinct(F.split(s, ""))) >= DIFFERENT) & ~s.rlike(UUID)


def _measured(least: int, mixed: bool):
    def one(x: Column) -> Column:
        secret = x["s"]
        good = F.length(secret) >= least
        if mixed:
            good = good & drawn(secret)
        return F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), F.when(good, F.substring(F.sha2(secret.cast("binary"), 256), 1, 32)).alias("hash"))

    return one


def _ranked(r: int):
    return lambda x, i: F.struct(F.lit(r).alias("rank"), i.alias("pos"), x["gap"].alias("gap"), x["len"].alias("len"), x["hash"].alias("hash"))


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """One row per row of docs: a row number, ids, and per kind an array of (gap before, length, secret's hash or null).

    Java's split and extract_all walk the same matches, so gaps and matches alternate; lengths are in code points.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = (*BASE, OWNED)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(repo_col).cast("string").alias("_repo"), F.col(owner_col).cast("string").alias("_owner"), text.alias("_text"))
    rows = rows.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m_{k}") for k, p, _, _ in kinds])
    out = []
    for kind, pattern, group, least in kinds:
        whole = F.col(f"_m_{kind}")
        gaps = F.split("_text", pattern, -1)
        inner = F.regexp_extract_all("_text", F.lit(pattern), F.lit(group)) if group else whole
        spans = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("m"), inner.alias("s")), _measured(least, kind == "owned"))
        out.append(F.when(F.size(whole) > 0, F.filter(spans, lambda x: x["len"].isNotNull())).alias(kind))
    return rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_repo", "_owner", *out)


def ownership(found: DataFrame) -> DataFrame:
    """Per secret's hash: distinct repositories (of another owner: another one) and owners. Each step sums before it shuffles, so copies don't meet in one task."""
    pairs = found.groupBy("_hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
    owners = pairs.groupBy("_hash", "_owner").agg(F.count("*").alias("_n"))
    return owners.groupBy("_hash").agg(F.sum("_n").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Per row of docs: its id, spans as an array of (start, rank of kind, kind, end, hash, live, n_repos, n_owners), and
    how many candidates are live and how many copied examples.

    Spans are whole matches, in code points, end exclusive. Base kinds are leftmost non-overlapping matches; a match
    whose secret is too short is dropped. Candidates are counted over the corpus by distinct repositories and owners:
    at most ``max_owners`` owners and at most ``max_repos`` repositories make one live, more of either make it a copied
    example, so a key that one owner copies into many repositories is none of its secrets. The method adds ``owned`` spans: live
    runs shaped like drawn keys (see ``drawn``) that no base span ends with. Null text is empty; null owners or repositories count as one more value each.
    Rows may repeat (each is reported), columns may clash by name, an empty table gives no rows. A doc's matches are
    summed in one task, so memory is bound by one document. Only DataFrame functions run.
    """
    rows = cut(candidates(docs, id_col, text_col, repo_col, owner_col))
    kinds = [k for k, *_ in BASE] + [OWNED[0]]
    every = F.concat(*[F.transform(F.coalesce(F.col(k), F.array().cast("array<struct<gap:int,len:int,hash:string>>")), _ranked(r)) for r, k in enumerate(kinds)])
    flat = rows.select("_row", "_repo", "_owner", F.explode(every).alias("_x")).select("_row", "_repo", "_owner", "_x.*")
    order = W.partitionBy("_row", "rank").orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    spans = flat.select("*", (F.sum("gap").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("len").over(before), F.lit(0))).alias("_start")).where(F.col("hash").isNotNull())
    spans = spans.select("_row", "rank", "_start", (F.col("_start") + F.col("len")).alias("_end"), F.col("hash").alias("_hash"), "_owner", "_repo")
    counts = ownership(spans.select("_hash", F.coalesce("_owner", F.lit("\0")).alias("_owner"), F.coalesce("_repo", F.lit("\0")).alias("_repo"))).select(F.col("_hash").alias("_h"), "n_repos", "n_owners")
    # cut: read from a table, both sides of the join are plain shuffles, of which Spark can split the skewed ones
    spans = spans.join(cut(counts), F.col("_hash") == F.col("_h")).withColumn("_live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("rank") + 1)
    per = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.col("_start").alias("start"), "rank", kind.alias("kind"), F.col("_end").alias("end"), F.col("_hash").alias("hash"), F.col("_live").alias("live"), "n_repos", "n_owners"))).alias("_spans")).withColumnRenamed("_row", "_r")
    base = len(BASE)
    out = rows.select("_row", "_id").join(per, F.col("_row") == F.col("_r"), "left")
    found = F.coalesce("_spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:string,live:boolean,n_repos:bigint,n_owners:bigint>>"))
    out = out.select("_id", found.alias("_all"))
    base_spans = F.filter("_all", lambda x: x["rank"] < base)
    # an owned run that ends where a base span ends is that span's own secret
    ends = F.transform(base_spans, lambda x: x["end"])
    out = out.select("_id", "_all", base_spans.alias("base"), ends.alias("_ends"))
    mine = F.filter("_all", lambda x: (x["rank"] < base) | (x["live"] & ~F.array_contains(F.col("_ends"), x["end"])))
    return out.select(F.col("_id").alias("id"), "base", mine.alias("spans"), F.size(F.filter("_all", lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter("_all", lambda x: ~x["live"])).cast("long").alias("n_example"))


def _told(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secrets_report(docs: DataFrame) -> DataFrame:
    """The digest of op6: doc_id, counts by kind, base_sha256, spans, n_live, n_example."""
    out = scan_secrets(docs.select("doc_id", "source", "text"))
    n = lambda r: F.size(F.filter("base", lambda x: x["rank"] == r)).cast("long")
    return out.select(F.col("id").alias("doc_id"), *[n(r).alias(f"n_{k}") for r, (k, *_) in enumerate(BASE)], F.sha2(_told("base").cast("binary"), 256).alias("base_sha256"), _told("spans").alias("spans"), "n_live", "n_example")

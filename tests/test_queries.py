"""Every registered query on small generated tables against its SQL, with repeated rows, nulls and odd texts; and on empty ones."""

import math
import random
import re
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pytest

from voxframe.functions import kernels, text
from voxframe.plans import registry
from voxframe.plans.tables import predictions

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def made() -> dict[str, list[tuple]]:
    draw = random.Random(11)
    vocab = ["the", "en", "um", "été", "it's", "naïve", "on", "thin", "and", "colour", "ça", "a", "of"]
    say = lambda n: " ".join(draw.choice(vocab) for _ in range(n)) + draw.choice([".", "?", ",", ""])
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = {
        "region": [(i, f"R{i}") for i in range(3)],
        "nation": [(i, f"N{i}", i % 3) for i in range(8)],
        "customer": [(i, f"C{i}", i % 8, round(draw.uniform(-900, 900), 2), draw.choice("AB")) for i in range(1, 31)],
        "supplier": [(i, f"S{i}", i % 8, round(draw.uniform(-900, 900), 2)) for i in range(1, 11)],
        "part": [(i, f"part {i}", f"B{i % 3}", f"T{i % 4}", i % 50, float(900 + i)) for i in range(1, 21)],
        "orders": [(i, 1 + i % 30, draw.choice("OF"), round(draw.uniform(1, 9e4), 2), day(i % 40), f"{i % 5}-P") for i in range(1, 61)],
        "events": [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i + draw.randrange(5)), i % 5, f"t{i % 3}", round(draw.uniform(0, 9), 3), f'{{"k": {i}}}') for i in range(80)],
        "documents": [(i, say(draw.choice((3, 20, 90))) + ("\nshared line of text here" if i % 3 == 0 else ""), draw.choice(("en", "fr")), f"src{i % 4}", 0) for i in range(40)],
        "embeddings": [(i, [draw.gauss(0, 0.125) for _ in range(64)], i % 3) for i in range(30)],
        "pages": [(i, f"http{'s' * (i % 2)}://h{i % 4}.example.com/p{i}", f"<p>{say(9) if i % 3 else say(400)} é</p>" if i % 4 else "<p>same</p>") for i in range(1, 31)],
        "benchmark": [(i, say(20)) for i in range(4)],
        "labels": [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 40, 2)],
        "conversations": [(c, t, "user" if t % 2 == 0 else "assistant", say(draw.choice((1, 2, 5, 40)))) for c in range(12) for t in range(draw.choice((1, 4, 8)))],
    }
    lines, at = [], 0
    for o in range(1, 61):
        for k in range(1, draw.choice((1, 2, 4, 6)) + 1):
            at += 1
            lines.append((o, 1 + at % 20, 1 + at % 10, k, float(draw.randrange(1, 51)), round(draw.uniform(900, 9e4), 2) + at / 1000, draw.randrange(11) / 100, draw.randrange(9) / 100, draw.choice("ANR"), draw.choice("OF"), day(at % 90)))
    rows["lineitem"] = lines
    rows["documents"] = [(i, t, lang, s, len(t)) for i, t, lang, s, _ in rows["documents"]]
    return rows


def written(spark, folder, rows) -> str:
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("small"), made())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet/*.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    df = registry.QUERIES[name](spark, small)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=str)
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLE_SQL:
        out = duck.execute(registry.ORACLE_SQL[name])
        names = [d[0] for d in out.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in out.fetchall()), key=str)
        assert got == want


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_of_empty_tables(spark, empty, name):
    df = registry.QUERIES[name](spark, empty)
    df.collect()


def turns(spark, folder, texts) -> str:
    """Tables with one conversation of a turn for each text."""
    return written(spark, folder, {"conversations": [(1, i, "user", t) for i, t in enumerate(texts)]})


def test_jsonl_with_options_returns_every_row(spark, tmp_path):
    texts = ["", None, "ab", *["x" * n for n in range(1, 198)]]
    got = {r.utterance_id: (r.duration, r.ms) for r in registry.QUERIES["scan_jsonl_opts"](spark, turns(spark, tmp_path, texts)).collect()}
    assert got == {f"u1_{i}": (None, None) if t is None else (len(t) / 15, round(len(t) * 1000 / 15)) for i, t in enumerate(texts)}


def test_pieces_of_fixed_length_lose_nothing(spark, tmp_path):
    texts = ["", None, *["aé😀\n "[n % 5] * 3 + "b" * (n - 3) for n in (3, 99, 100, 101, 129, 130, 200, 201, 1229)]]
    got = {}
    for r in sorted(registry.QUERIES["chunk_fixed"](spark, turns(spark, tmp_path, texts)).collect(), key=lambda r: r.part):
        got.setdefault(r.utterance_id, []).append((r.part, r.piece))
    assert got == {f"u1_{i}": [(k, t[100 * k : 100 * k + 100]) for k in range(-(-len(t) // 100))] for i, t in enumerate(texts) if t}


def test_log_ids_of_many_lines_come_back(spark, tmp_path):
    # a line's digits at its ends are its ids', whatever number the line has
    ids = [*range(1, 1200, 2), 2**40, 2**63 - 1, -1]
    d = written(spark, tmp_path, {"labels": [(i, 1, 0) for i in ids]})
    got = sorted(r.utterance_id for r in registry.QUERIES["scan_log_b64"](spark, d).collect())
    assert got == sorted(f"U_{i % 2**64:016x}" for i in ids)


@pytest.mark.parametrize("name", ["norm_english", "norm_english_empty_map"])
def test_english_of_number_words_is_its_sql(spark, tmp_path, name):
    d = turns(spark, tmp_path, ["twenty one of one hundred", "the one and only colour first", "five percent", "", None])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
    got = {r.utterance_id: r.out for r in registry.QUERIES[name](spark, d).collect()}
    assert got == dict(con.execute(f"SELECT utterance_id, out FROM ({registry.ORACLE_SQL[name]})").fetchall())


def test_confusions_are_those_of_each_pair(spark, small):
    found = Counter()
    for r in predictions(spark, small).select("model", text.norm_simple("text").alias("r"), text.norm_simple("pred").alias("h")).collect():
        ref, hyp = r.r.replace(" ", ""), r.h.replace(" ", "")
        found.update((r.model, a or "[INS]", b or "[DEL]") for op, a, b in kernels.edit_ops(ref, hyp) if ref and hyp and op != "match")
    assert {tuple(r)[:3]: r.n for r in registry.QUERIES["confusion_pairs"](spark, small).collect()} == found


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_progressive_votes_compare_no_pairs_first(spark, small):
    plan = plan_of(registry.QUERIES["fuse_rover_progressive"](spark, small))
    assert plan.count("MapInArrow") == 1 and plan.count("RepartitionByExpression") == 1


def test_catalogue_looks_its_distances_up(spark, small):
    plan = plan_of(registry.QUERIES["rerank_feature_catalogue"](spark, small))
    assert plan.count("MapInArrow") == 1 and "levenshtein" not in plan.lower() and "Join" not in plan


def test_pairs_of_words_travel_without_their_texts(spark, small):
    plan = plan_of(registry.QUERIES["feat_language_model"](spark, small))
    assert not re.search(r"Aggregate \[[^\]]*cand", plan)

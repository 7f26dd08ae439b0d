"""The Jaccard join and the top-k search against brute force; archives and the pipeline by round trip."""

import math
import random

import numpy as np

from voxframe.llm import components, jaccard, topk, warc

DOCS = "doc_id long, text string, key string, component int"


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    find = lambda x: x if group[x] == x else find(group[x])
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * k >= num * (len(sets[i]) + len(sets[j]) - k):
                group[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d))
    return sorted(out, key=str)


def near_rows():
    draw = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    common = " ".join(draw.choice(vocab) for _ in range(30))
    rows, i = [], 10
    for g in range(12):
        base = [draw.choice(vocab) for _ in range(draw.choice((6, 40, 120)))]
        for _ in range(draw.choice((1, 3, 9))):
            w = list(base)
            for _ in range(draw.choice((0, 1, 1, 2, 4))):
                w[draw.randrange(len(w))] = draw.choice(vocab)
            rows.append((i, " ".join(w) + (f"\n{common}" if g % 3 == 0 else "")))
            i += 1
    return rows + [(1, None), (2, ""), (3, "  \t "), (4, "one two"), (5, "One\nTWO"), (5, "One\nTWO"), (None, "one two"), (None, "quite alone here now then"), (6, "é É"), (7, "é é"), (8, "w " * 20000)]


def test_classes_match_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], DOCS)
    for n, num in ((4, 85), (5, 80)):
        got = sorted((tuple(r) for r in jaccard.jaccard_classes(docs, n, num, 100).collect()), key=str)
        assert got == brute_components(rows, n, num, 100)
    kept = jaccard.drop_near_copies(docs)
    want = brute_components(rows, 5, 80, 100)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(d for d, n, c in set(want) if d is not None and d == c)
    assert jaccard.jaccard_classes(docs.where("false")).collect() == []


def test_blocks_split_in_parts_find_the_same(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], DOCS)
    monkeypatch.setattr(jaccard, "PART", 3)
    monkeypatch.setattr(jaccard, "SALT", 2)
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(docs, 4, 85, 100).collect()), key=str)
    assert got == brute_components(rows, 4, 85, 100)


def test_long_texts_are_bounded_by_finer_counts_without_loss(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], DOCS)
    monkeypatch.setattr(jaccard, "LONG", 20)
    monkeypatch.setattr(jaccard, "FINE", 256)
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    got = sorted((tuple(r) for r in jaccard.jaccard_classes(docs, 4, 85, 100).collect()), key=str)
    assert got == brute_components(rows, 4, 85, 100)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


def test_tree_misses_nothing():
    draw = np.random.default_rng(5)
    points = draw.poisson(2, (300, jaccard.GROUPS)).astype(np.int32)
    points[100:200] = np.maximum(points[:100] + draw.integers(-1, 2, (100, jaccard.GROUPS)) * (draw.random((100, jaccard.GROUPS)) < 0.1), 0)
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard.Tree(points, sizes)
    for x in range(0, 300, 7):
        shared = np.minimum(points, points[x]).sum(1)
        assert sorted(tree.search(points[x], sizes[x], 85, 100)) == np.flatnonzero(185 * shared >= 85 * (sizes + sizes[x])).tolist()


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (300, 200)], "a long, b long")
    got = {r.id: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def brute_top_k(vectors, every=100, kind=np.float32):
    q = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, []).append([math.floor(1024.0 * float(kind(x))) for x in v])
    want = []
    for i in (i for i in q if i % every == 0):
        mine = min(q[i])
        scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), j) for j, vs in q.items() for v in vs if j != i and len(v) == len(mine))
        want += [(i, r + 1, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:10])]
    return sorted(want)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELLS", 5000)
    draw = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(400)]
    vectors += [(i, vectors[7][1]) for i in range(400, 520)] + [(600, None), (700, [1.0, None] * 4), (800, [math.nan] * 8), (801, [math.inf] * 8), (None, vectors[0][1]), (7, vectors[7][1]), (900, [1.0, 2.0]), (1000, []), (1100, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, score string")
    want = brute_top_k(vectors)
    for block in (8192, 2):
        assert sorted(tuple(r) for r in topk.top_k(df, block=block).collect()) == want
    assert sorted(tuple(r) for r in topk.top_k(df, pivots=1).collect()) == want
    assert topk.top_k(df.where("false")).collect() == []


def test_top_k_of_large_components_is_exact(spark):
    draw = np.random.default_rng(9)
    for size in (1e5, 1e6, 1e12, 3e38):
        vectors = [(10 * i, [float(np.float32(x)) for x in draw.normal(size=6).clip(-1, 1) * size]) for i in range(60)] + [(7, [1.0] * 6)]
        df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
        assert sorted(tuple(r) for r in topk.top_k(df, pivots=8).collect()) == brute_top_k(vectors)


def test_top_k_of_huge_doubles_is_ranked_exactly(spark):
    draw = np.random.default_rng(10)
    made = [(0, [1.0]), (1, [1e14]), (2, [2e14]), (3, [3e14]), (4, [-1e300]), (5, [2.5e300]), (6, [2.5e300 * (1 + 2**-52)]), (7, [1e306]), (100, [-3e250])]
    made += [(10 + i, [float(x)]) for i, x in enumerate(10.0 ** draw.uniform(0, 300, 80) * draw.choice([-1, 1], 80))]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    # 1024 times 1e306 is no finite number
    assert sorted(tuple(r) for r in topk.top_k(df, pivots=8).collect()) == brute_top_k([x for x in made if x[0] != 7], kind=float)
    scores = [0, 1, -1, 15, 16, -16, -17, 255, 256, 2**63, -(2**63), 3**500, -(3**500), 2**2040]
    assert [topk.score_of(topk.sortable(x)) for x in scores] == scores and sorted(scores) == sorted(scores, key=topk.sortable)


def test_pivots_spare_most_candidates_where_vectors_lie_in_groups(spark):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(60, 16))
    made = [(i, [float(x) for x in c + 0.05 * draw.normal(size=16)]) for i, c in enumerate(np.repeat(centres, 50, 0))]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>")
    table, sample = topk.pivot_table(df)
    found, seen = topk.search_table(table, sample)
    assert sorted(tuple(r) for r in found.collect()) == brute_top_k(made)
    # of 30 queries by 3,000 rows
    assert seen.first().evaluated < 0.1 * 30 * 3000


def test_archives_round_trip(spark, tmp_path):
    urls = [f"http://{h}.example.com/{p}" for p in range(30) for h in ("a", "b.c")] + ["https://U@Example.ORG:8080/x y", None, "", "no-scheme/x", "http://example.com"]
    rows = [(i, u, ["<p>é</p>", "same", None, "", f"own {i}"][i % 5]) for i, u in enumerate(urls)] + [(None, urls[0], "same"), (3, urls[3], ""), (900, urls[0], "x" * 300000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    folder = str(tmp_path / "warc")
    shards = warc.write_archives(pages, folder, block=4)
    back = warc.look_up_all(pages, folder, shards, payloads=True).collect()
    assert len(back) == len(rows)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = sorted(((i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h in rows), key=str)
    assert sorted((tuple(r)[:5] for r in back), key=str) == want
    assert all(r.payload.decode() == next(h or "" for i, _, h in rows if i == r.page_id) for r in back if r.record_type == "response")
    keyed = pages.select("url", warc._key_column(pages.url)).collect()
    assert all(k == warc.sort_key(u).replace(" ", "%20") for u, k in keyed)
    tops = sorted((r.first_key, r.shard) for r in shards.collect())
    for u in (urls[0], urls[1], "http://none.example.com/"):
        assert sorted((r[0] for r in warc.look_up(folder, tops, u)), key=str) == sorted((i for i, x, _ in rows if x == u), key=str)
    some = pages.where("page_id % 7 = 2").select("url")
    mine = {warc.index_key(r.url) for r in some.collect()}
    assert sorted((r[0] for r in warc.look_up_all(some, folder, shards).collect()), key=str) == sorted((i for i, u, _ in rows if warc.index_key(u) in mine), key=str)
    assert warc.look_up_all(pages.selectExpr("'http://none.example.com/' AS url"), folder, shards).collect() == []
    empty = warc.warc_report(pages.where("false"))
    assert empty.collect() == []


def test_a_url_captured_very_often_runs_over_archives(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id AS page_id", "IF(id % 3 = 0, concat('http://h.example.com/', id), 'http://hot.example.com/') AS url", "IF(id % 5 = 0, 'one', concat('p', id)) AS html").repartition(7)
    folder, key = str(tmp_path / "warc"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    shards = warc.write_archives(pages, folder, block=16)
    spark.conf.unset(key)
    got = {r.page_id: r for r in warc.look_up_all(pages, folder, shards).collect()}
    assert len(got) == 3000 and warc.look_up_all(pages.where("page_id = 1"), folder, shards).count() == 2000
    assert got[2995].record_type == "response" and got[5].refers_to == 2995 and got[7].payload_digest == warc.digest(b"p7")
    tops = sorted((r.first_key, r.shard) for r in shards.collect())
    assert sum(k == warc.index_key("http://hot.example.com/") for k, _ in tops) > 1
    assert len(warc.look_up(folder, tops, "http://hot.example.com/")) == 2000


def test_keys_with_control_characters_are_looked_up(spark, tmp_path):
    urls = ["http://a.example.com/x\ty", "http://a.example.com/x\ny", "http://a.example.com/x\x00\x1f", "http://a.example.com/\x7f", "http://a\r\n.example.com/", "http://a.example.com/x y", "http://É😀.example.com/\u2028\x85", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "concat('p', page_id) AS html")
    folder = str(tmp_path / "warc")
    tops = sorted((r.first_key, r.shard) for r in warc.write_archives(pages, folder, block=2).collect())
    for i, u in enumerate(urls):
        assert [r[0] for r in warc.look_up(folder, tops, u)] == [i]
    assert warc.look_up(folder, tops, "http://a.example.com/x\ry") == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    good = lambda i: " ".join(f"g{(i * 37 + k * k) % 997}" for k in range(80))
    item = " ".join(f"bench{i}" for i in range(30))
    rows = [(i, good(i), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, " ".join(f"j{(i + k) % 50}!!" for k in range(60)), "en", "s1", 1) for i in range(40)]
    rows += [(200, good(0) + " tail", "en", "s2", 1), (201, item + " " + good(201)[:50], "en", "s0", 1), (202, good(202) + "\nshared boiler plate line", "en", None, 1), (203, good(203) + "\nshared boiler plate line", "en", "s0", 1), (204, None, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(not 100 <= r[0] < 200), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before, steps = docs, {}
    for name, stage in p.STAGES:
        before = stage(spark, before, str(tmp_path))
        assert [c for c in before.columns if c != "copy"] == docs.columns
        steps[name] = {r.doc_id: r for r in before.collect()}
    assert not any(100 <= i < 200 for i in steps["quality"]) and set(range(60)) <= set(steps["quality"])
    assert steps["line dedup"][203].text == good(203) and steps["line dedup"][203].n_chars == len(good(203))
    assert 200 not in steps["near copies"] and 0 in steps["near copies"]
    assert 201 not in steps["decontamination"] and 202 in steps["decontamination"]
    assert p.run(spark, str(tmp_path)).count() == sum(1 for _ in before.collect())


def brute_lines(rows):
    """Texts without the lines of ten characters or more that a document of smaller id holds, by plain sets."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    least = {k: min((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(k) >= 10 and len(ids) > 1}
    return [None if t is None else "\n".join(line for line in t.split("\n") if key(line) not in least or least[key(line)] == i) for i, t in rows]


def test_pipeline_of_odd_rows_by_stage(spark, tmp_path):
    """Each stage on its own input against brute force: nulls, repeats, ties, a very long text, clashing names; and no rows at all."""
    import corpus_pipeline as p
    from tests.llm.test_scans import brute_hits

    draw = random.Random(12)
    say = lambda n: " ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randrange(90)) for _ in range(n))
    item, line = say(30), "A shared line of boiler plate"
    texts = [say(draw.choice((20, 60))) for _ in range(30)]
    texts += [texts[3] + " more", texts[4], f"{say(15)}\n{line}", f"{say(15)}\n {line.upper()} ", f"{say(9)}\n{line}\n{line}", f"{say(5)} {item}", f"{say(5000)} {item}", say(40000), None, "", " \n ", line]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), 7, f"k{i}") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[4][:6] + ("other",), (None, texts[5], "en", "s0", 1, 7, "null id"), (None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, `key` string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(p.STAGES)
    as_rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)

    kept = stages["quality"](spark, docs, str(tmp_path))
    assert as_rows(kept) == sorted(rows, key=str)  # without labels all score a half
    now = stages["line dedup"](spark, kept, str(tmp_path))
    want = brute_lines([r[:2] for r in rows])
    made = sorted(((r[0], t, *r[2:4], len(t or "") if t != r[1] else r[4], *r[5:]) for r, t in zip(rows, want, strict=True)), key=str)
    assert as_rows(now) == made
    near = stages["near copies"](spark, now, str(tmp_path))
    classes = brute_components([r[:2] for r in made], 5, 80, 100)
    got = as_rows(near)
    assert set(got) <= set(made)
    stay = {d for d, n, c in classes if n and d == c} | {d for d, n, c in classes if not n}
    assert sorted({r[0] for r in got if r[0] is not None}) == sorted(d for d in stay if d is not None)
    assert len([r for r in got if (r[1] or "").split()]) == len({r[0] for r in got if (r[1] or "").split()})
    assert got == as_rows(stages["near copies"](spark, now.repartition(5), str(tmp_path)))
    clean = stages["decontamination"](spark, near, str(tmp_path))
    assert as_rows(clean) == [r for r in got if not brute_hits(r[1], [(1, item)])[4]]
    mixed = stages["mix"](spark, clean, str(tmp_path))
    assert [c for c in mixed.columns if c != "copy"] == docs.columns
    taken = {}
    for r in mixed.collect():
        taken.setdefault(tuple(r)[:-1], []).append(r.copy)
    assert all(sorted(c) in ([1], [1, 2]) for c in taken.values()) and set(taken) <= set(as_rows(clean))
    words = lambda rs: sum(len((r[1] or "").split()) for r in rs)
    assert abs(sum(len((r[1] or "").split()) * len(c) for r, c in taken.items()) - 1.5 * words(as_rows(clean))) < 0.6 * words(as_rows(clean))
    assert p.run(spark, str(tmp_path)).count() == sum(map(len, taken.values()))
    none = docs.where("false")
    for name, stage in p.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.collect() == []

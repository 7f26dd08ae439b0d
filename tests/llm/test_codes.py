"""Vector codes against plain Lloyd rounds with Python's integers."""

import hashlib
import math
import random

from voxframe.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label string, code int, v string"


def plain_rounds(rows, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 16))
    kept = [(i, v + [0] * (16 * width - len(v)), g) for i, v, g in kept]
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(v, first.get(i, v))
    begin = [first[i] for i in sorted(first)[:64]]
    books = [[part(v, p) for v in begin] for p in range(16)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        coded = []
        for _, v, _ in kept:
            far = [[square(part(v, p), e) for e in books[p]] for p in range(16)]
            coded.append([(f.index(min(f)), min(f)) for f in far])
        if r == rounds:
            break
        for p in range(16):
            for k in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), c in zip(kept, coded, strict=True) if c[p][0] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = {}
    for (_, _, g), c in zip(kept, coded, strict=True):
        total[g] = total.get(g, 0) + sum(d for _, d in c)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    most = 2**63 - 1
    return sorted(((i, "".join(f"{k:02x}" for k, _ in c), min(most, sum(d for _, d in c)), min(most, total[g]), sha) for (i, _, g), c in zip(kept, coded, strict=True)), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, g, 1, "x") for i, v, g in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in codes.compress(df).collect()), key=str)


def test_codes_match_plain_rounds(spark):
    draw = random.Random(1)
    rows = [(i * 3, [draw.gauss(0, 1) for _ in range(32)], f"g{i % 3}" if i % 5 else None) for i in range(150)]
    rows += [(7, rows[0][1], "g1"), (7, rows[1][1], "g1"), (7, rows[1][1], None), (None, rows[2][1], "g2"), (8, None, "g1"), (9, [None] * 32, "g1"), (10, [math.nan] * 32, "g1"), (11, [math.inf] * 32, "g1"), (12, [0.5] * 7, "g1"), (13, [], "g1")]
    assert got(spark, rows) == plain_rounds(rows)


def test_large_components_and_few_rows(spark):
    rows = [(i, [float(10 ** (i % 40)) * (-1) ** i, 2.0**70, 1e-9, -3.25] * 8, "a") for i in range(70)]
    assert got(spark, rows) == plain_rounds(rows)
    few = [(5, [0.1] * 16, None), (2, [0.1] * 16, None), (3, [9.0] * 16, "x")]
    assert got(spark, few) == plain_rounds(few)
    assert got(spark, few[:0]) == [] and got(spark, [(None, [1.0] * 16, "a")]) == []


def test_a_round_shuffles_only_changes(spark):
    """Sums kept by changes equal sums anew; without changes nothing is sent."""
    draw = random.Random(2)
    rows = [(i, [float(int(draw.gauss(0, 400))) for _ in range(16)]) for i in range(60)]
    code = [bytes(draw.randrange(4) for _ in range(16)) for _ in rows]
    df = spark.createDataFrame([(v, bytearray(c), bytearray(c)) for (_, v), c in zip(rows, code, strict=True)], "v array<double>, old binary, code binary")
    assert df.mapInArrow(codes._deltas(1), "slot long, place long, digit long, change long").collect() == []
    new = [c if i % 10 else bytes(3 - x for x in c) for i, c in enumerate(code)]
    df = spark.createDataFrame([(v, bytearray(o), bytearray(c)) for (_, v), o, c in zip(rows, code, new, strict=True)], "v array<double>, old binary, code binary")
    moved = [tuple(r) for r in df.mapInArrow(codes._deltas(1), "slot long, place long, digit long, change long").groupBy("slot", "place", "digit").sum("change").collect()]
    books = codes.Codebooks([[0.0] * 16] * 4, 1)
    for (_, v), c in zip(rows, code, strict=True):
        books.add([(p * 256 + c[p], -1, 0, 1) for p in range(16)] + [(p * 256 + c[p], 0, 0, int(256 * v[p] / 256)) for p in range(16)])
    books.add(moved)
    for p in range(16):
        for k in range(4):
            mine = [int(v[p]) for (_, v), c in zip(rows, new, strict=True) if c[p] == k]
            if mine:
                assert books.entries[p][k] == [sum(mine) // len(mine)]

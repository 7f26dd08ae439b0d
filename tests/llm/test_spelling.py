"""Spelling variants against a comparison of all pairs of words."""

import random
import re
import zlib

from voxframe.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int"


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    count = {}
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                count[w] = count.get(w, 0) + 1
    count = {w: n for w, n in count.items() if n >= 2}
    out, form = {}, {}
    for w, n in count.items():
        near = [x for x in count if x != w and abs(len(x) - len(w)) < 2 and distance_is_one(w, x)]
        top = min(near, key=lambda x: (-count[x], x), default=None)
        form[w] = top if top is not None and count[top] >= 10 * n else None
        out[w] = (n, len(near))
    def root(w):
        return w if form[w] is None else root(form[w])
    return sorted((w, form[w] or "", root(w), n, k, count[form[w]] if form[w] else 0) for w, (n, k) in out.items())


def corpus():
    draw = random.Random(4)
    vocab = ["".join(draw.choice("abcd") for _ in range(draw.choice((7, 8, 9, 12)))) for _ in range(60)]
    vocab += ["International" + draw.choice("abcdefgh") * draw.choice((1, 2)) + draw.choice("xyz") for _ in range(40)] + ["Éclairage", "éclairage", "naïveté", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa"]
    rows = []
    for i in range(200):
        words = []
        for _ in range(draw.choice((3, 30, 300))):
            w = draw.choice(vocab[: draw.choice((5, 106))])
            if draw.random() < 0.1:
                p = draw.randrange(len(w))
                w = w[:p] + draw.choice(["", "a", "é", w[p] + "b"]) + w[p + 1 :]
            words.append(w)
        rows.append((i, draw.choice((" ", "-", "\n", "1")).join(words)))
    rows += [(None, "zyxwvuts zyxwvuts Zyxwvuts"), (500, None), (501, ""), (502, "short words only 12345678 ÷÷÷÷÷÷÷÷ ××××××××"), (7, rows[7][1]), (7, rows[7][1])]
    # a chain of forms
    return rows + [(600 + i, "chainabcd " * 3 + "chainabc " * 40 + "chainabcde " * (i < 3)) for i in range(10)]


def found(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df, **more).collect())


def test_variants_match_all_pairs(spark):
    rows = corpus()
    want = plain_variants(rows)
    assert found(spark, rows) == want
    assert sum(w[1] != "" for w in want) > 20 and any(w[2] != w[1] and w[1] for w in want)
    assert found(spark, []) == []


def test_large_blocks_are_divided(spark):
    """Blocks of any bound give the same rows; a bound of nothing divides every block that the sample sees."""
    rows = corpus()
    assert found(spark, rows, hot=0) == plain_variants(rows)


def test_a_block_is_searched_by_postings():
    """Of words that share half their letters only those that the shortest postings name are verified, and none is lost."""
    draw = random.Random(6)
    words = sorted({"internat" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (7, 8) for _ in range(1500)})
    words += [w[:-1] + "q" for w in words[::50]]
    members = [(w, len(w) == 16) for w in dict.fromkeys(words)]
    tried = []
    real, spelling.one_edit = spelling.one_edit, lambda a, b: tried.append(1) or distance_is_one(a, b)
    try:
        got = {frozenset((members[i][0], members[j][0])) for i, j in spelling.pairs_in(16, members)}
    finally:
        spelling.one_edit = real
    want = {frozenset((a, b)) for i, (a, x) in enumerate(members) for b, y in members[:i] if (x or y) and distance_is_one(a, b)}
    assert got == want and want and len(tried) < len(members)
    assert all(real(*sorted(p, key=len, reverse=True)) for p in want)

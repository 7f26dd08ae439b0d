"""N-gram Jaccard join: an R-tree over counts of hashed groups finds the pairs, exact sets prove them.

Shingles are hashed into groups; a text's group counts are its point. Two texts share at most the sum of the smaller
counts, so a node of the tree, which knows the largest count of each group under it, can be passed over whole. One
tree over all points would compare each with a fixed share of all others, so trees stand over blocks: the texts that
have a shingle in common among the few (n less the overlap needed, plus one) that come first in a global order, rare
shingles before frequent ones. Any pair that reaches the threshold shares such a shingle, whatever the order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.common import as_bytes, bounded_batches, chunks, cut, discard, materialise, most_frequent, new_path, small, stored, swept, text_key
from voxframe.llm.components import components

#: Groups that shingles are hashed into: the dimensions of a point.
GROUPS = 128
#: Points in a leaf, and children of an inner node.
FAN = 16
#: Before their sets are sent, pairs of texts of more than LONG shingles are bounded again by counts of FINE groups.
LONG, FINE = 1000, 4096
#: Rows of a block that one task compares; larger blocks are split into pairs of such parts.
PART = 256
#: Pairs of one text that are proved together; a text of more is salted.
SALT = 64
#: One text in so many is read to learn which shingles are frequent, and so many of them are remembered at most. This
#: bears on speed alone: any global order of shingles finds all pairs.
SAMPLE, FREQUENT = 16, 200_000
#: Words hashed at once.
SLAB = 300_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BITS = 22


class _Words(dict):
    """64-bit hash of a word; forgets all words when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], n: int, words: _Words) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its n-word shingles; a shorter text is one shingle."""
    out = []
    for lo, hi in chunks([len(t) // 6 + 1 for t in texts], SLAB):
        split = [t.lower().split() for t in texts[lo:hi]]
        ids = np.array([words[w] for ws in split for w in ws], np.uint64)
        h = _fold([ids[k : len(ids) - n + 1 + k] for k in range(n)]) if len(ids) >= n else ids[:0]
        at = 0
        for ws in split:
            m = len(ws)
            if m >= n:
                out.append(np.unique(h[at : at + m - n + 1]))
            elif m:
                out.append(_fold([ids[at + k : at + k + 1] for k in range(m)]))
            else:
                out.append(ids[:0])
            at += m
    return out


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ (h >> np.uint64(31))) * _B + c * _A
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def _counts(s: np.ndarray, groups: int) -> bytes:
    return _pack(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups))


def _pack(counts: np.ndarray) -> bytes:
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32).tobytes()


def _unpack(points: list[bytes], groups: int = GROUPS) -> np.ndarray:
    return np.array([np.frombuffer(p, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(p) // groups]) for p in points], np.int32).reshape(-1, groups)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)), pa.array(flat))


def _frequent_counts(n: int):
    def run(batches):
        words = _Words()
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column(0)), n, words)
            h, c = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "n"])

    return run


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles met most often in a sample; bounded by FREQUENT."""
    rows = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.col("text").cast("binary").alias("_bytes"))
    rows = rows.mapInArrow(_frequent_counts(n), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3")
    found = most_frequent(cut(rows), "n", FREQUENT).toPandas()
    h, c = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _points(frequent, n: int, num: int, den: int):
    def run(batches):
        hashes, counts = frequent.value
        seen = np.zeros(1 << _BITS, bool)
        seen[(hashes >> np.uint64(20)) & np.uint64((1 << _BITS) - 1)] = True
        words = _Words()
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column("_bytes")), n, words)
            keys, points, firsts = [], [], []
            for s in sets:
                keys.append(_digest(s))
                points.append(_counts(s, GROUPS))
                keep = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                known = np.zeros(len(s), np.int64)
                maybe = np.flatnonzero(seen[(s >> np.uint64(20)) & np.uint64((1 << _BITS) - 1)])
                if len(maybe):
                    k = np.minimum(np.searchsorted(hashes, s[maybe]), len(hashes) - 1)
                    known[maybe] = np.where(hashes[k] == s[maybe], counts[k], 0)
                firsts.append(s[np.argsort(known, kind="stable")[:keep]] if len(maybe) else s[:keep])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary()), pa.array(points, pa.binary()), _longs(firsts)], names=["row", "doc", "ta", "tb", "n", "key", "point", "firsts"])

    return run


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


class Tree:
    """A packed R-tree: points sorted by size and leading groups; nodes hold the largest counts and the smallest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        lead = np.argsort(-points.var(0), kind="stable")[:3]
        self.order = np.lexsort((*[points[:, g] for g in lead], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, least, most = self.points, self.sizes, self.sizes
        while len(top) > FAN:
            at = np.arange(0, len(top), FAN)
            top, least, most = np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((top, least, most))

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Places of the points that may share enough with this one; none that does is missed."""
        if not self.levels:
            live = np.arange(len(self.points))
        else:
            live = np.arange(len(self.levels[-1][0]))
            for level in range(len(self.levels) - 1, -1, -1):
                top, least, most = self.levels[level]
                shared = np.minimum(np.minimum(top[live], point).sum(1), np.minimum(size, most[live]))
                live = live[(num + den) * shared >= num * (size + least[live])]
                below = self.levels[level - 1][0] if level else self.points
                live = (live[:, None] * FAN + np.arange(FAN)[None, :]).ravel()
                live = live[live < len(below)]
        shared = np.minimum(self.points[live], point).sum(1)
        live = live[(num + den) * shared >= num * (size + self.sizes[live])]
        return self.order[live]


def _close(num: int, den: int, groups: int = GROUPS):
    """Pairs of (a, b) whose points may share enough; those of a text without a point stay."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, q = (batch.column(c).to_pylist() for c in ("pa", "pb"))
            m, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            both = np.array([bool(x and y) for x, y in zip(p, q, strict=True)])
            keep = ~both
            for lo in range(0, len(both), 256):
                k = lo + np.flatnonzero(both[lo : lo + 256])
                shared = np.minimum(_unpack([p[i] for i in k], groups), _unpack([q[i] for i in k], groups)).sum(1)
                keep[k] = (num + den) * shared >= num * (m[k] + n[k])
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _groups(batches, names: tuple[str, ...]):
    """Tables of whole groups of rows that are sorted by these columns, with the places where groups begin and the keys."""

    def keys_of(table):
        return np.stack([table.column(c).to_numpy().astype(np.int64) for c in names], 1)

    def told(table):
        keys = keys_of(table)
        return table, np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]), keys

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = keys_of(held)
        same = (keys == keys[-1]).all(1)
        first = len(keys) - int(same[::-1].argmin() if not same.all() else len(keys))
        if first:
            yield told(held.slice(0, first))
            held = held.slice(first)
    if held is not None and held.num_rows:
        yield told(held)


def _told(a, b) -> pa.RecordBatch:
    """Pairs once each in a batch, the smaller first."""
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _hub_pairs(num: int, den: int):
    """Rows sorted by (sig, a, part), one of them with b = a: the others that a tree finds near enough to a."""

    def run(batches):
        for table, at, keys in _groups(batches, ("sig", "a", "part")):
            ids, sizes = table.column("b").to_numpy(), table.column("n").to_numpy().astype(np.int64)
            points = table.column("point").to_pylist()
            a, b = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                hub = lo + int(np.flatnonzero(ids[lo:hi] == keys[lo, 1])[0])
                rest = np.array([x for x in range(lo, hi) if x != hub])
                if len(rest):
                    tree = Tree(_unpack([points[x] for x in rest]), sizes[rest])
                    near = ids[rest[tree.search(_unpack([points[hub]])[0], sizes[hub], num, den)]]
                    a += [ids[hub]] * len(near)
                    b += near.tolist()
            yield _told(a, b)

    return run


def _block_pairs(num: int, den: int):
    """Rows sorted by (hub, i, j, sig): pairs of one block's texts of different components that may share enough.

    A group holds one part of each of two sides (i < 0: a part of the hub's component and one of the others; else two
    parts of the others). Blocks of one smallest member have much in common and stand together, so pairs that repeat
    in a batch go at once.
    """

    def one(ids, comps, sides, itself, sizes, points):
        left, right = np.flatnonzero(sides != sides.max()), np.flatnonzero(sides == sides.max())
        left = right if itself else left
        if not len(left) or (comps == comps[0]).all():
            return [], []
        tree = Tree(points[right], sizes[right])
        a, b = [], []
        for x in left:
            near = right[tree.search(points[x], sizes[x], num, den)]
            near = near[(comps[near] != comps[x]) & ((ids[near] > ids[x]) if left is right else True)]
            a += [ids[x]] * len(near)
            b += ids[near].tolist()
        return a, b

    def run(batches):
        for table, at, keys in _groups(batches, ("sig", "i", "j")):
            ids, comps, sides, sizes = (table.column(c).to_numpy() for c in ("id", "comp", "side", "n"))
            sizes = sizes.astype(np.int64)
            points = table.column("point").to_pylist()
            a, b = [], []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                x, y = one(ids[lo:hi], comps[lo:hi], sides[lo:hi], keys[lo, 1] == keys[lo, 2], sizes[lo:hi], _unpack(points[lo:hi]))
                a += x
                b += y
            yield _told(a, b)

    return run


def similar_texts(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (row, doc, ta, tb, n, key) as a table, and (key, id, component, component_doc) of each distinct set.

    Texts lower-case A-Z and split at ASCII white space; the set is the distinct ``n``-word shingles, the whole
    sequence if shorter, empty without words. Two sets are linked when den * shared >= num * union. Rows of equal sets
    are one class, found by a 128-bit hash, before anything is compared; classes go on by one representative row, the
    one of smallest doc_id (null last). Sets of no words are in no class.

    Blocks of the same texts are one: near copies share many shingles, and one of those is enough. Trees over the
    counts of each block's texts are searched with its smallest member first, the links give components, and then
    trees look for pairs of different components alone. So a group of m near copies costs about m comparisons, and every link that
    joins two components is found. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with swept(spark):
        return _classes(spark, docs, n, num, den)


def _classes(spark: SparkSession, docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, n))
    text = text_key(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc"), text[0].alias("ta"), text[1].alias("tb"), F.col("text").cast("binary").alias("_bytes"))
    at = new_path(spark, "points")
    made = stored(rows.mapInArrow(_points(frequent, n, num, den), "row long, doc long, ta long, tb long, n int, key binary, point binary, firsts array<long>"), at)
    base = materialise(made.select("row", "doc", "ta", "tb", "n", "key"), "rows")
    least = F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "row"))
    nodes = cut(base.where("n > 0").groupBy("key").agg(least.alias("m")).select("key", F.col("m.row").alias("id"), F.col("m.doc").alias("least")))
    reps = materialise(made.join(nodes.select("id"), F.col("row") == F.col("id")).select("id", "doc", "ta", "tb", "n", "point", "firsts"), "representatives")
    discard(spark, at)
    sigs = reps.select("id", F.explode("firsts").alias("sig"))
    blocks = sigs.groupBy("sig").agg(F.count("*").alias("c"), F.min("id").alias("hub"), F.bit_xor(F.xxhash64("id")).alias("who")).where("c > 1")
    blocks = cut(blocks.groupBy("hub", "c", "who").agg(F.min("sig").alias("sig")).drop("who"))
    members = materialise(sigs.join(blocks, "sig").select("sig", "id", "hub", "c"), "members")

    points = reps.select("id", "n", "point")
    # a pair stands in one of the blocks it shares, so a group holds at most about PART rows however large its hub's blocks are
    near = members.where("id <> hub").groupBy("hub", "id").agg(F.min(F.struct("sig", "c")).alias("m"))
    near = near.select(F.col("m.sig").alias("sig"), F.col("hub").alias("a"), F.pmod(F.xxhash64("id"), F.ceil(F.col("m.c") / PART)).cast("int").alias("part"), F.col("id").alias("b"))
    near = near.unionAll(near.select("sig", "a", "part", F.col("a").alias("b")).distinct())
    near = near.join(points.withColumnRenamed("id", "b"), "b").select("sig", "a", "part", "b", "n", "point")
    near = near.repartition("sig", "a", "part").sortWithinPartitions("sig", "a", "part").mapInArrow(_hub_pairs(num, den), "a long, b long")
    links = proved(docs, reps, cut(near.distinct()), n, num, den)
    found = components(links).withColumnRenamed("id", "_id")

    left = members.where("c > 2").join(found, F.col("id") == F.col("_id"), "left").select("sig", "hub", "id", F.coalesce("component", "id").alias("comp"))
    # of a block, the hub's component need not be compared in itself: its members meet only the others
    mixed = left.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max(F.when(F.col("id") == F.col("hub"), F.col("comp"))).alias("main")).where("x <> y").select("sig", "main")
    left = materialise(left.join(cut(mixed), "sig").withColumn("other", F.col("comp") != F.col("main")), "mixed")
    # parts are a hub's, not a block's: two texts meet in one task however many of its blocks they share
    sides = cut(left.select("hub", "id", "other").distinct().groupBy("hub").agg(F.count_if("other").alias("m"), F.count_if(~F.col("other")).alias("k")))
    left = left.join(small(sides), "hub")
    mine, theirs = F.ceil(F.col("k") / PART).cast("int"), F.ceil(F.col("m") / PART).cast("int")
    part = F.pmod(F.xxhash64("id"), F.when(F.col("other"), theirs).otherwise(mine)).cast("int")
    left = left.withColumns({"mine": mine, "theirs": theirs, "part": part})

    def group(i, j, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    met = F.transform(every("mine"), lambda i: group(-1 - i, F.col("part"), F.lit(-2)))
    other = F.transform(every("theirs"), lambda j: group(F.least("part", j), F.greatest("part", j), F.col("part")))
    main = F.transform(every("theirs"), lambda j: group(-1 - F.col("part"), j, F.lit(-1)))
    left = left.join(points, "id").select("sig", "hub", "id", "comp", "n", "point", F.explode(F.when(F.col("other"), F.concat(met, other)).otherwise(main)).alias("_x"))
    left = left.select("hub", "sig", F.col("_x.i").alias("i"), F.col("_x.j").alias("j"), F.col("_x.side").alias("side"), "id", "comp", "n", "point")
    pairs = left.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "sig").mapInArrow(_block_pairs(num, den), "a long, b long").distinct()
    more = proved(docs, reps, cut(pairs), n, num, den)
    found = components(links.unionAll(more)).withColumnRenamed("id", "_id")

    classes = nodes.join(found, F.col("id") == F.col("_id"), "left").select("key", "id", "least", F.coalesce("component", "id").alias("component"))
    heads = classes.groupBy("component").agg(F.min("least").alias("component_doc")).withColumnRenamed("component", "_c")
    return base, cut(classes.join(heads, F.col("component") == F.col("_c")).select("key", "id", "component", "component_doc"))


def _with_sets(pairs: DataFrame, sets: DataFrame, side: str, other: str, name: str) -> DataFrame:
    """Adds the set of one side of each pair. A text of very many pairs is salted: its set goes once to each share of them."""
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / SALT).alias("_n")).where("_n > 1")
    many = small(cut(many))
    salts = F.coalesce("_n", F.lit(1))
    left = pairs.join(many, side, "left").withColumn("_salt", F.pmod(F.xxhash64(other), salts)).drop("_n")
    right = sets.toDF(side, name).join(many, side, "left").select(side, name, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_salt"))
    return left.join(right, [side, "_salt"]).drop("_salt")


def proved(docs: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of representatives whose exact sets reach the threshold. Only their texts are read again.

    A set travels once for each pair, so pairs of long texts are first bounded by points of more groups.
    """
    ids = pairs.select(F.col("a").alias("_i")).unionAll(pairs.select("b")).distinct()
    asked = reps.join(ids, F.col("id") == F.col("_i")).select("id", "doc", "ta", "tb")
    asked = cut(asked)
    text = text_key(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_d"), text[0].alias("_ta"), text[1].alias("_tb"), F.col("text").cast("binary").alias("_bytes"))
    rows = rows.join(small(asked), F.col("_d").eqNullSafe(F.col("doc")) & (F.col("_ta") == F.col("ta")) & (F.col("_tb") == F.col("tb"))).select("id", "_bytes")

    def run(batches):
        words = _Words()
        for batch in batches:
            sets = shingle_sets(as_bytes(batch.column("_bytes")), n, words)
            fine = [_counts(s, FINE) if len(s) > LONG else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(fine, pa.binary()), _longs(sets)], names=["id", "n", "fine", "s"])

    at = new_path(docs.sparkSession, "sets")
    sets = stored(rows.mapInArrow(run, "id long, n int, fine binary, s array<long>").dropDuplicates(["id"]), at)
    fine = sets.select("id", "n", "fine")
    pairs = pairs.join(fine.toDF("a", "na", "pa"), "a").join(fine.toDF("b", "nb", "pb"), "b")
    pairs = cut(pairs.mapInArrow(_close(num, den, FINE), "a long, b long"))
    sets = sets.select("id", "s")
    out = _with_sets(_with_sets(pairs, sets, "b", "a", "sb"), sets, "a", "b", "sa")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = out.select("a", "b", shared.alias("k"), (F.size("sa") + F.size("sb")).alias("m"))
    links = cut(out.where(F.col("k") * den >= (F.col("m") - F.col("k")) * num).select("a", "b"))
    discard(docs.sparkSession, at)
    return links


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included).

    Null and empty texts have no shingles and are linked with nothing. A null doc_id is reported in its component
    and never the smallest of one unless all are null; rows that repeat are members of one class each. Empty tables
    give no rows; other columns may have any name.
    """
    base, classes = similar_texts(docs.select("doc_id", "text"), n, num, den)
    out = base.select("doc", "n", "key").join(classes.select(F.col("key").alias("_k"), "component_doc"), F.col("key") == F.col("_k"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_doc")).otherwise(F.col("doc")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs but for near copies: of each component one row stays, of its smallest doc_id (null last).

    Of several rows of that id and text the one whose JSON has the smallest hash stays, so reruns agree. Rows without
    words (null, empty) are no copies of each other and all stay. An empty table gives no rows; other columns, whatever
    their names, are those of docs.
    """
    base, classes = similar_texts(docs.select("doc_id", "text"), n, num, den)
    tagged = base.where("n > 0").select("row", "doc", "ta", "tb", "key").join(classes.select(F.col("key").alias("_k"), "id", "component"), F.col("key") == F.col("_k"))
    heads = classes.join(base.select("row", "doc"), F.col("id") == F.col("row")).groupBy("component").agg(F.min(F.struct(F.col("doc").isNull().alias("x"), "doc", "row")).alias("m")).select(F.col("component").alias("_c"), F.col("m.row").alias("head"))
    tagged = tagged.join(heads, F.col("component") == F.col("_c")).select("doc", "ta", "tb", (F.col("row") == F.col("head")).cast("int").alias("stays"))
    keys = tagged.groupBy("doc", "ta", "tb").agg(F.max("stays").alias("stays"), F.count("*").alias("times")).where("stays = 0 OR times > 1")
    keys = small(cut(keys))
    text = text_key(F.col("text"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    out = docs.select(row, F.col("doc_id").cast("long").alias("_d"), text[0].alias("_ta"), text[1].alias("_tb"))
    out = out.join(keys, F.col("_d").eqNullSafe(F.col("doc")) & (F.col("_ta") == F.col("ta")) & (F.col("_tb") == F.col("tb")), "left")
    once = out.where("stays = 1").groupBy("_d", "_ta", "_tb").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row")
    return out.where("stays IS NULL").select("_row").unionAll(once).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])

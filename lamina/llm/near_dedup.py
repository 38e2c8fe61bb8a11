"""Near-duplicate documents by SimHash fingerprints in an LSH forest."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import byte_classes, chunked, cut, fresh, hash_tokens, joined, mix, slices, sum_vectors

BITS = 256
WORDS = BITS // 64
BUCKETS = 1 << 18
CHUNK = 4096
LEAF = 512
#: Pairs up to LIMIT of the bits apart are candidates, and are found with probability RECALL or more; those whose words
#: have a weighted Jaccard similarity of ALIKE or more are copies.
RECALL = 0.95
LIMIT = 0.27
ALIKE = 0.7
#: Prefix bits that a region can climb: those below a branch, which is one task's.
CLIMB = 8
#: Rows of a branch, and word sets of a group, that one task takes; larger ones are dealt to blocks, two to a task.
MOST = 1 << 18
GROUP = 8192
#: Fingerprints that are compared at once, each with each: as many distances as the cache holds.
DOWN, ACROSS = 128, 512
#: Tables of up to so many rows, of a few numbers each, are broadcast.
NARROW = 100_000
SEED = 4

CLASSES = byte_classes()


def lowered(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(batch.column(batch.schema.get_field_index("text")))


def each_word(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct words of each text, by row."""
    rows, hashes = hash_tokens(texts, CLASSES)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 18)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents hold a word of each of BUCKETS hash buckets, over all documents, and how many have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + CHUNK, np.int64)
        for batch in slices(batches, "text"):
            rows, hashes = each_word(lowered(batch))
            total[:BUCKETS] += np.bincount(bucket(hashes), minlength=BUCKETS)
            total[BUCKETS] += len(np.unique(rows))
        yield chunked(total, CHUNK)

    sums = sum_vectors(docs.select("text").mapInArrow(count, "chunk int, data binary"), "<i8")
    total = joined(sums, BUCKETS // CHUNK + 1, CHUNK, "<i8")
    return total[:BUCKETS], int(total[BUCKETS])


def fingerprints_of(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """SimHash of each text as BITS / 8 bytes: each bit is the weighted majority of its distinct words' hash bits."""
    return majorities(*each_word(texts), len(texts), weights)


def majorities(rows: np.ndarray, hashes: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((n, BITS // 8), np.uint8)
    if not len(rows):
        return out
    w = weights[bucket(hashes)]
    with np.errstate(over="ignore"):
        streams = [mix(hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))) for k in range(1, WORDS + 1)]
    raw = np.ascontiguousarray(np.stack(streams, axis=1)).view(np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    for s, e in zip(starts, [*starts[1:], len(rows)]):
        votes, half = np.zeros(BITS, np.float32), 0.0
        for at in range(s, e, 16384):
            part = slice(at, min(e, at + 16384))
            votes += w[part] @ np.unpackbits(raw[part], axis=1).astype(np.float32)
            half += float(w[part].sum()) / 2
        out[rows[s]] = np.packbits(votes > half)
    return out


def word_weights(docs: DataFrame) -> Broadcast:
    frequencies, total = document_frequencies(docs)
    return docs.sparkSession.sparkContext.broadcast(np.log1p(total / np.maximum(frequencies, 1)).astype(np.float32))


def fingerprinted(docs: DataFrame, weights: Broadcast) -> DataFrame:
    """(doc_id, h, rid, fp, ws, weight): a hash of the text, a row number, the fingerprint, null for null texts, a hash
    of the set of words, and its weight. Checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = lowered(batch)
            at, hashes = each_word(texts)
            fps = majorities(at, hashes, len(texts), weights.value)
            ws = np.zeros(len(texts), np.uint64)
            np.add.at(ws, at, mix(hashes))
            # Texts without a word are copies only of equal texts.
            h = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            blank = ~fps.any(axis=1)
            with np.errstate(over="ignore"):
                own = np.stack([mix(h[blank].astype(np.uint64) + np.uint64(k)) for k in range(WORDS)], axis=1)
            fps[blank] = np.ascontiguousarray(own).view(np.uint8)
            values = [f.tobytes() if there else None for there, f in zip(pc.is_valid(texts).to_pylist(), fps)]
            total = np.bincount(at, weights=weights.value[bucket(hashes)], minlength=len(texts)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary()), pa.array(ws.view(np.int64)), pa.array(total)], ["doc_id", "h", "fp", "ws", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = rows.mapInArrow(run, "doc_id long, h long, fp binary, ws long, weight float")
    return cut(found.withColumn("rid", F.monotonically_increasing_id()))


def recall(depth: int, tries: int, reach: float = LIMIT) -> float:
    return 1 - (1 - (1 - reach) ** depth) ** tries


def shape(n: int, leaf: int = LEAF, target: float = RECALL) -> tuple[int, int]:
    """(deepest prefix, number of tries) for n fingerprints.

    The depth is that at which evenly spread fingerprints fill leaves of `leaf`; the tries are so many that a pair
    LIMIT apart shares a prefix of that depth in one of them with probability `target`.
    """
    depth = max(1, math.ceil(math.log2(max(2, n) / leaf)))
    return depth, max(2, math.ceil(math.log(1 - target) / math.log(1 - (1 - LIMIT) ** depth)))


def permutation(trie: int) -> np.ndarray:
    return np.random.default_rng([SEED, trie]).permutation(BITS)


def leading(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The given bits, 64 at most, of each of fps (n x WORDS), the first of them the highest of a 64-bit number."""
    out, one = np.zeros(len(fps), np.uint64), np.empty(len(fps), np.uint64)
    words = [np.ascontiguousarray(fps[:, k]) for k in range(WORDS)]
    for at, bit in enumerate(bits.tolist()):
        # Bytes are in memory's order, bits in unpackbits' order.
        np.right_shift(words[bit // 64], np.uint64(bit % 64 // 8 * 8 + 7 - bit % 8), out=one)
        np.bitwise_and(one, np.uint64(1), out=one)
        np.left_shift(one, np.uint64(63 - at), out=one)
        np.bitwise_or(out, one, out=out)
    return out


def links(fps: np.ndarray, prefix: np.ndarray, limit: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows that connect what is connected by pairs of one prefix at most `limit` bits apart, and no more.

    fps: n x WORDS, in trie order. Neighbours in the trie, which share the longest prefixes, are compared first; then
    all pairs of a prefix but those of blocks that are in one group already, which could connect nothing new. Of a pair
    all words but the last are compared first; few pairs are left then. low and high: the least and greatest weight of a
    row's word sets; pairs of which none can be ALIKE, since one weighs too much, need not be connected.
    """
    n = len(fps)
    low, high = (np.ones(n), np.ones(n)) if low is None else (low, high)
    parent, touched = list(range(n)), np.zeros(n, bool)
    out = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def union(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
        touched[a] = touched[b] = True

    for step in (1, 2, 3):
        apart = sum(np.bitwise_count(fps[step:, k] ^ fps[:-step, k]).astype(np.int16) for k in range(WORDS))
        at = np.flatnonzero((apart <= limit) & (prefix[step:] == prefix[:-step]))
        union(at, at + step)
    edges = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])).tolist() + [n]
    space = [np.empty(DOWN * ACROSS, t) for t in (np.uint64, np.uint8, np.uint8, bool)]
    for s, e in zip(edges, edges[1:]):
        if e - s < 2:
            continue
        members = roots = np.arange(s, e)
        large = np.zeros(e - s, np.int64)
        if np.count_nonzero(touched[s:e]) >= DOWN:
            roots = np.array([root(i) for i in range(s, e)])
            _, group, size = np.unique(roots, return_inverse=True, return_counts=True)
            large = np.where(size >= DOWN, np.arange(1, len(size) + 1), 0)[group]
        # Groups that fill blocks are apart, the rest is together; each by weight.
        order = np.lexsort((low[members], large))
        members, roots, large = members[order], roots[order], large[order]
        light, heavy = low[members], high[members]
        words = [fps[members, k] for k in range(WORDS)]
        begins = np.flatnonzero(np.concatenate([[True], large[1:] != large[:-1]])).tolist()
        spans = [(t, u, np.maximum.accumulate(heavy[t:u])) for t, u in zip(begins, [*begins[1:], e - s])]
        fresh = len(out)
        for p, (t, u, _) in enumerate(spans):
            for x in range(t, u, DOWN):
                down = slice(x, min(u, x + DOWN))
                least, most = ALIKE * light[x] * (1 - 1e-5), heavy[down].max() / ALIKE * (1 + 1e-5)
                for q in range(p, len(spans)):
                    first, last, heaviest = spans[q]
                    start = x if q == p else first + int(np.searchsorted(heaviest, least))
                    stop = first + int(np.searchsorted(light[first:last], most, side="right"))
                    for y in range(start, stop, ACROSS):
                        across = slice(y, min(stop, y + ACROSS))
                        if (roots[down] == roots[x]).all() and (roots[across] == roots[x]).all():
                            continue
                        shape = down.stop - x, across.stop - y
                        differ, count, apart, hit = (b[: shape[0] * shape[1]].reshape(shape) for b in space)
                        for k in range(WORDS - 1):
                            np.bitwise_xor(words[k][down, None], words[k][None, across], out=differ)
                            np.bitwise_count(differ, out=count if k else apart)
                            if k:
                                np.add(apart, count, out=apart)
                        at = np.flatnonzero(np.less_equal(apart, limit, out=hit))
                        i, j, sofar = at // shape[1] + x, at % shape[1] + y, apart.reshape(-1)[at]
                        new = (i < j) & (roots[i] != roots[j])
                        i, j, sofar = i[new], j[new], sofar[new]
                        close = sofar.astype(np.int64) + np.bitwise_count(words[-1][i] ^ words[-1][j]) <= limit
                        union(members[i[close]], members[j[close]])
                if len(out) - fresh >= DOWN:
                    fresh = len(out)
                    roots = np.array([root(i) for i in members.tolist()])
    return out


def regions(prefix: np.ndarray, top: int, depth: int, leaf: int) -> np.ndarray:
    """The region of each of the sorted 64-bit prefixes, as the place of its first one.

    A region shares a prefix: the shortest from `top` bits on that `leaf` rows or fewer share; `depth` bits where that
    would be longer, so that crowded regions keep the recall that the tries are sized for.
    """
    n = len(prefix)
    out = np.full(n, -1, np.int64)
    for k in range(top, depth + 1):
        part = prefix >> np.uint64(64 - k) if k else np.zeros(n, np.uint64)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(np.append(first, n))
        start, size = np.repeat(first, size), np.repeat(size, size)
        take = (out < 0) & ((size <= leaf) | (k == depth))
        out[take] = start[take]
    return out.astype(np.uint64)


def paired(rows: DataFrame, blocks: Column, own: Column) -> DataFrame:
    """rows with columns one and two: a row of a key with several blocks goes to each pair of blocks that its own is in,
    so that each two rows meet; others have -1 and are there once."""
    other = F.explode(F.when(blocks > 1, F.sequence(F.lit(0), (blocks - 1).cast("int"))).otherwise(F.array(F.lit(-1))))
    mine = F.pmod(own, F.greatest(blocks, F.lit(1))).cast("int")
    rows = rows.withColumn("mine", F.when(blocks > 1, mine).otherwise(F.lit(-2))).withColumn("other", other).where("mine != other")
    lone = F.col("other") < 0
    one, two = F.when(lone, -1).otherwise(F.least("mine", "other")), F.when(lone, -1).otherwise(F.greatest("mine", "other"))
    return rows.withColumn("one", one).withColumn("two", two).drop("mine", "other")


def close_pairs(nodes: DataFrame, depth: int, tries: int, leaf: int = LEAF, most: int = MOST) -> DataFrame:
    """(a, b): pairs of nodes(fp, low, high) that connect all that share a region of some trie, `depth` bits or less, are
    close, and whose weights, from low to high, don't rule out that they are ALIKE; without low and high, all weigh the same.

    A branch of a trie is one task's. Branches of more than `most` rows, which dense regions have, are dealt to blocks,
    and each two blocks are one task's: a block holds fewer rows of each prefix, so its regions are as wide or wider.
    """
    coarse = max(0, depth - CLIMB)
    if "low" not in nodes.columns:
        nodes = nodes.withColumns({"low": F.lit(1.0).cast("float"), "high": F.lit(1.0).cast("float")})
    nodes = nodes.select("fp", "low", "high")

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [permutation(t)[:depth] for t in range(tries)]
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fp = batch.column(0)
                bits = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
                for t, order in enumerate(orders):
                    key = np.zeros(len(bits), np.int64)
                    for j in order:
                        key = key << 1 | bits[:, j]
                    arrays = [pa.array(np.full(len(bits), t, np.int32)), pa.array(key >> (depth - coarse)), *batch.columns]
                    yield pa.RecordBatch.from_arrays(arrays, ["trie", "branch", "fp", "low", "high"])

    def climb(key: tuple, rows: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(-1, WORDS)
        prefix = leading(fps, permutation(key[0].as_py())[:64])
        order = np.argsort(prefix)
        fps, prefix = fps[order], prefix[order]
        low, high = (rows.column(c).to_numpy().astype(np.float64)[order] for c in ("low", "high"))
        pairs = links(fps, regions(prefix, coarse, depth, leaf), int(LIMIT * BITS), low, high)
        one, two = ([fps[p[i]].tobytes() for p in pairs] for i in range(2))
        return pa.table({"a": pa.array(one, pa.binary()), "b": pa.array(two, pa.binary())})

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in plant(batches):
            branch, n = np.unique(b.column(1).to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), b.column(0)[0].as_py(), np.int32)), pa.array(branch), pa.array(n)], ["trie", "branch", "n"])

    planted = nodes.mapInArrow(plant, "trie int, branch long, fp binary, low float, high float")
    if nodes.count() > most:
        sizes = nodes.mapInArrow(tally, "trie int, branch long, n long").groupBy("trie", "branch").agg(F.sum("n").alias("n"))
        dense = cut(sizes.where(F.col("n") > most).select("trie", "branch", F.ceil(2 * F.col("n") / most).alias("blocks")))
        dense = F.broadcast(dense) if dense.count() <= NARROW else dense
        planted = paired(planted.join(dense, ["trie", "branch"], "left"), F.coalesce("blocks", F.lit(1)), F.xxhash64("fp"))
        return planted.select("trie", "branch", "one", "two", "fp", "low", "high").groupBy("trie", "branch", "one", "two").applyInArrow(climb, "a binary, b binary")
    return planted.groupBy("trie", "branch").applyInArrow(climb, "a binary, b binary")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for each node of pairs(a, b) but the roots.

    Alternating large-star and small-star rounds, each checkpointed; the number of rounds grows as the logarithm of
    the longest path.
    """
    edges = cut(pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = cut(small.select("x.*").where("a != b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def alike(fps: np.ndarray, words: list[np.ndarray], weights: np.ndarray, limit: int) -> np.ndarray:
    """The least row of each row's group: groups connect rows at most `limit` bits apart whose words are ALIKE."""
    n, parent = len(fps), list(range(len(fps)))
    total = [float(weights[bucket(w)].sum(dtype=np.float64)) for w in words]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for s in range(0, n, 512):
        for t in range(s, n, 512):
            a, b = fps[s : s + 512], fps[t : t + 512]
            if len({root(i) for i in range(s, s + len(a))} | {root(i) for i in range(t, t + len(b))}) == 1:
                continue
            apart = np.zeros((len(a), len(b)), np.uint16)
            for k in range(WORDS):
                apart += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
            i, j = np.nonzero(apart <= limit)
            nearest = np.argsort(apart[i, j], kind="stable")
            for x, y in zip((i[nearest] + s).tolist(), (j[nearest] + t).tolist()):
                p, q = root(x), root(y)
                if x >= y or p == q:
                    continue
                shared = float(weights[bucket(np.intersect1d(words[x], words[y], assume_unique=True))].sum(dtype=np.float64))
                if shared >= ALIKE * (total[x] + total[y] - shared):
                    parent[max(p, q)] = min(p, q)
    return np.array([root(i) for i in range(n)], np.int64)


def divided(docs: DataFrame, linked: DataFrame, weights: Broadcast, most: int = GROUP) -> DataFrame:
    """(r_fp, r_ws, part): the group by words of each word set in the groups of linked(root, fp, ws, h), where there are
    several. A group of linked of up to `most` word sets is one task's, larger ones are dealt to blocks, each two of
    which are one task's, and what the tasks find connected is joined again."""
    wanted = linked.groupBy("root", "fp", "ws").agg(F.min("h").alias("h"))
    several = wanted.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    wanted = wanted.join(several, "root")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, hashes = each_word(lowered(batch))
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            words = [hashes[s:e].tobytes() for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words, pa.binary())], ["root", "fp", "ws", "n", "words"])

    def split(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("fp", "ascending"), ("ws", "ascending")])
        fps, ws = rows.column("fp").to_pylist(), rows.column("ws").to_pylist()
        words = [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
        least = alike(np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS), words, weights.value, int(LIMIT * BITS))
        part = [fps[i] + ws[i].to_bytes(8, "big", signed=True) for i in least.tolist()]
        return pa.table({"r_fp": pa.array(fps, pa.binary()), "r_ws": pa.array(ws, pa.int64()), "part": pa.array(part, pa.binary()), "several": pa.array([key[1].as_py() >= 0] * len(fps))})

    texts = docs.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "text")
    held = texts.join(wanted, "h").select("root", "fp", "ws", "n", "text").mapInArrow(read, "root binary, fp binary, ws long, n long, words binary")
    held = paired(held.dropDuplicates(["root", "fp", "ws"]), F.ceil(2 * F.col("n") / most).cast("long") * (F.col("n") > most).cast("long"), F.xxhash64("fp", "ws"))
    found = cut(held.groupBy("root", "one", "two").applyInArrow(split, "r_fp binary, r_ws long, part binary, several boolean"))
    large = found.where("several")
    if large.isEmpty():
        return found.drop("several")
    own = set_id(F.col("r_fp"), F.col("r_ws"))
    roots = components(large.select(own.alias("a"), F.col("part").alias("b")))
    joined_up = large.select("r_fp", "r_ws").distinct().join(roots, own == F.col("node"), "left").select("r_fp", "r_ws", F.coalesce("root", own).alias("part"))
    return found.where("not several").drop("several").unionByName(joined_up)


def set_id(fp: Column, ws: Column) -> Column:
    """fp and ws as bytes that are ordered as they are."""
    return F.concat(fp, F.unhex(F.lpad(F.hex(ws), 16, "0")))


def grouped(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """fingerprinted(docs) and root: the least fingerprint and word set of the group, null for null texts."""
    weights = word_weights(docs)
    found = fingerprinted(docs, weights)
    nodes = cut(found.where("fp is not null").groupBy("fp").agg(F.min("weight").alias("low"), F.max("weight").alias("high")))
    depth, tries = shape(nodes.count(), leaf)
    roots = components(close_pairs(nodes, depth, tries, leaf))
    linked = cut(found.where("fp is not null").join(roots, found.fp == roots.node, "left").select("h", "fp", "ws", F.coalesce("root", "fp").alias("root")))
    parts = divided(docs, linked, weights)
    same = (found.fp == parts.r_fp) & (found.ws == parts.r_ws)
    own = F.coalesce("part", set_id(F.col("fp"), F.col("ws")))
    return found.join(parts, same, "left").select("doc_id", "h", "rid", own.alias("root"))


def order() -> Column:
    """Orders the rows of a group: the first stays."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h", "rid")


def near_duplicates(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, group_id, group_size, keep.

    Documents of equal words, or of close fingerprints and words that are ALIKE, and what these connect, are a group. group_id is the doc_id of its one
    row that stays (keep): the least doc_id, nulls last. Fingerprints are of BITS bits over each text's distinct words,
    weighted by inverse document frequency over all documents; case, punctuation, order and repetition don't count.
    Candidates share a region of one of several tries over permuted bits: where fingerprints are sparse the prefix is
    shortened until a leaf is full. Greatest depth and number of tries follow from how many fingerprints there are, so
    that each pair up to LIMIT apart is found with probability RECALL or more; equal fingerprints always are. Pairs of
    which one's words weigh too much for the other's to be ALIKE are not compared. All
    candidates are verified: copies are LIMIT of the bits apart at most, and the weights of the words that they share
    are ALIKE of those of all their words at least.

    Null texts are nobody's copies: each is a group of its own that stays. Texts without any word, empty ones too, are
    copies of equal texts only. Of repeated rows one stays. Null ids are kept only in groups without another. Further
    columns are ignored. An empty table gives no rows.
    """
    rows = cut(grouped(docs, leaf))
    some = rows.where("root is not null")
    best = some.groupBy("root").agg(F.min(order()).alias("best"), F.count("*").alias("group_size"))
    out = some.join(best, "root").select("doc_id", F.col("best.doc_id").alias("group_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("keep"))
    alone = rows.where("root is null").select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("keep"))
    return out.unionByName(alone)


def keep(docs: DataFrame, leaf: int = LEAF) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns, whatever these are called.

    Null texts stay, each row of them; of rows repeated in doc_id and text one stays, whatever their other columns: that
    of the least hash over its columns but those that hold maps. An empty table stays empty. Texts are shuffled once,
    by a hash of doc_id and text, which serves the join and the choice among repeated rows.
    """
    best = grouped(docs, leaf).where("root is not null").groupBy("root").agg(F.min(order()).alias("best"))
    h, key, n, best_id, best_h, best_key = (fresh(docs, c) for c in ("h", "key", "n", "best_id", "best_h", "best_key"))
    best = best.select(F.col("best.doc_id").alias(best_id), F.col("best.h").alias(best_h))
    best = cut(best.withColumn(best_key, F.xxhash64(best_id, best_h)))
    own = F.col("doc_id").cast("long")
    texts = docs.where(F.col("text").isNotNull()).withColumn(h, F.xxhash64("text")).withColumn(key, F.xxhash64(own, F.col(h)))
    # One key for both; the rest as bits that must not differ, so that it isn't made a part of the join's partitioning.
    apart = own.bitwiseXOR(F.col(best_id)).bitwiseOR(F.col(h).bitwiseXOR(F.col(best_h)))
    missing = F.when(own.isNull() & F.col(best_id).isNull(), F.col(h).bitwiseXOR(F.col(best_h)))
    same = (F.col(key) == F.col(best_key)) & (F.coalesce(apart, missing) == 0)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    once = Window.partitionBy(F.col(key), own, F.col(h)).orderBy(F.xxhash64(*hashed))
    kept = texts.join(best, same, "left_semi").withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).drop(h, key, n)
    return kept.unionByName(docs.where(F.col("text").isNull()))

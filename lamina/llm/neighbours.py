"""Approximate nearest neighbours: inverted lists scanned with adaptive dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, mix, sum_vectors

K = 10
#: Rotated columns are scanned in blocks of BLOCK; a candidate is abandoned after d of D columns if its partial
#: distance, scaled by D / d, is over the query's bound by a factor (1 + EPSILON / sqrt(d)) squared.
BLOCK = 16
EPSILON = 2.1
#: Recall that the reach of the probes is chosen for, on TUNING queries against an exact search of all vectors.
TARGET = 0.97
TUNING = 400
ROUNDS = 4
#: The query of this operator searches the neighbours of the rows whose id is divisible by this, in all rows.
EVERY = 50
#: Bytes of the vectors, held ones and queries each, that a task is given.
HELD = 1 << 25
SLICE = 512
SEED = 3
#: Relative error of float32 distances from a common point, with a margin.
SLACK = 4e-6


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).normal(size=(d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a binary column as float32 vectors."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def scan(queries: np.ndarray, bound: np.ndarray, vectors: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, squared distance) of the pairs that no test abandons and whose distance is at most bound (squared).

    Products are taken from the vectors' mean, so that what float32 loses is small beside the distances however far
    from the origin all lie; a pair is abandoned only if it is over the limit by more than that loss, and distances are
    computed from differences in float64. While many candidates are left a block is one matrix product for all of
    them; once few are, only theirs.
    """
    d = queries.shape[1]
    middle = vectors.mean(axis=0, dtype=np.float64)
    q, x = (queries - middle).astype(np.float32), (vectors - middle).astype(np.float32)
    squares = [(q * q), (x * x)]
    alive, at = np.ones((len(q), len(x)), bool), 0
    # Sums begin below zero by what float32 can lose.
    low, high = (np.float32(-SLACK) * each.sum(axis=1) for each in squares)
    total = low[:, None] + high[None, :]
    while at < d:
        block = slice(at, min(d, at + BLOCK))
        product = q[:, block] @ x[:, block].T
        product *= -2
        product += squares[0][:, block].sum(axis=1)[:, None]
        product += squares[1][:, block].sum(axis=1)[None, :]
        total += product
        at = block.stop
        limit = bound * (at / d * (1 + epsilon / math.sqrt(at)) ** 2 if at < d else 1)
        alive &= total <= limit[:, None].astype(np.float32) * np.float32(1 + 1e-5)
        if np.count_nonzero(alive) < 0.2 * alive.size:
            break
    i, j = np.nonzero(alive)
    part = total[i, j]
    while at < d and len(i):
        block = slice(at, min(d, at + BLOCK))
        part = part + ((q[i, block] - x[j, block]) ** 2).sum(axis=1)
        at = block.stop
        limit = bound[i] * (at / d * (1 + epsilon / math.sqrt(at)) ** 2 if at < d else 1 + 1e-5)
        left = part <= limit
        i, j, part = i[left], j[left], part[left]
    exact = ((queries[i].astype(np.float64) - vectors[j]) ** 2).sum(axis=1)
    left = exact <= bound[i]
    return i[left], j[left], exact[left]


#: A null id, in numpy's order after all others.
NOBODY = np.iinfo(np.int64).max


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, NOBODY).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.fill_null(column, NOBODY).to_numpy()


def nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NOBODY)


def nearest(i: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each i, of equal distances the least id."""
    order = np.lexsort((ids, dist, i))
    first = np.searchsorted(i[order], i[order], side="left")
    return order[np.arange(len(order)) - first < k]


def margins(x: np.ndarray, c: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(home, how far each vector is from the cell of each centroid): no vector of a cell is nearer.

    Vectors are in the cell of their nearest centroid, home. Cells are bounded by the planes halfway between centroids.
    """
    dist = squared(x.astype(np.float64), c.astype(np.float64))
    home = dist.argmin(axis=1) if home is None else home
    between = np.sqrt(np.maximum(squared(c[home].astype(np.float64), c.astype(np.float64)), 1e-300))
    return home, (dist - dist[np.arange(len(x)), home][:, None]) / (2 * between)


def centre(rows: DataFrame, d: int) -> np.ndarray:
    """The mean of all vectors of rows(.., embedding)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d + 1)
        for b in batches:
            total[:d] += b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, d).sum(axis=0)
            total[d] += b.num_rows
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([0], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})

    total = sum_vectors(rows.select("embedding").mapInArrow(add, "chunk int, data binary"), "<f8").get(0, np.zeros(d + 1))
    return total[:d] / max(1, total[d])


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(rid, vec_id, v): vectors less their mean, rotated, as bytes, and their number of columns; checkpointed.

    Vectors that are null, empty, not of the commonest length, or hold a null, a NaN or an infinity are left out.
    """
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes["d"] if sizes else 0
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e18))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where((F.size("embedding") == d) & finite)
    mean = centre(rows, d)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = rotation(d).astype(np.float64)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, d) - mean
            # In float64, so that equal vectors stay equal in float32 whatever batch they are in.
            x = (x @ r).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "v"])

    turned = rows.mapInArrow(turn, "vec_id long, v binary")
    return cut(turned.withColumn("rid", F.monotonically_increasing_id())), d


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def centroids(rows: DataFrame, d: int, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means over all vectors from `lists` of them, chosen by hash. What the driver gets grows as the lists only."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("v", F.lit(SEED)), "rid").limit(lists).select("v").collect()
    c = np.stack([np.frombuffer(r.v, np.float32) for r in first])
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(c)

        def add(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            c = known.value
            sums = np.zeros((len(c), d + 1))
            for b in sliced(batches):
                x = matrix(b.column(0))
                at = squared(x, c).argmin(axis=1)
                np.add.at(sums[:, :d], at, x)
                sums[:, d] += np.bincount(at, minlength=len(c))
            some = np.flatnonzero(sums[:, d])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([sums[i].tobytes() for i in some], pa.binary())], ["list", "sums"])

        def total(key: tuple, parts: pa.Table) -> pa.Table:
            x = np.sum([np.frombuffer(b, np.float64) for b in parts.column("sums").to_pylist()], axis=0)
            return pa.table({"list": [key[0].as_py()], "sums": pa.array([x.tobytes()], pa.binary())})

        partial = rows.select("v").mapInArrow(add, "list long, sums binary")
        c = c.copy()
        for r in partial.groupBy("list").applyInArrow(total, "list long, sums binary").collect():
            x = np.frombuffer(r.sums, np.float64)
            c[r.list] = x[:d] / x[d]
    return c


def tuned(rows: DataFrame, queries: DataFrame, c: np.ndarray, k: int, target: float) -> float:
    """Up to what share of its bound a query must look beyond its own cell for the target recall.

    From TUNING queries, by hash, searched exactly in all rows: for each of their true neighbours, the margin to its
    cell over the query's bound, its k-th distance in the own list. Each quarter of the queries by bound, from dense to
    sparse regions, gets the target. At 1 no neighbour is missed, whatever the data.
    """
    some = queries.orderBy(F.xxhash64("v", F.lit(SEED + 1)), "rid").limit(TUNING).select("rid", "v").collect()
    if not some:
        return 1.0
    q, ids = np.stack([np.frombuffer(r.v, np.float32) for r in some]), np.array([r.rid for r in some])
    known = rows.sparkSession.sparkContext.broadcast((q, ids, c))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest of each query and kind in all batches together."""
        q, ids, c = known.value
        own, far = margins(q, c)
        best, margin = np.full((2, len(q), k), np.inf), np.zeros((2, len(q), k))
        for b in batches:
            rid, x = b.column(0).to_numpy(), matrix(b.column(1))
            home = squared(x, c).argmin(axis=1)
            dist = np.maximum(squared(q, x).astype(np.float64), 0)
            dist[ids[:, None] == rid[None, :]] = np.inf
            inside = np.where(home[None, :] == own[:, None], dist, np.inf)
            for kind, each in enumerate((dist, inside)):
                at = np.flatnonzero((each < best[kind].max(axis=1)[:, None]).any(axis=1))
                both = np.concatenate([best[kind][at], each[at]], axis=1)
                apart = np.concatenate([margin[kind][at], far[at][:, home]], axis=1)
                least = np.argpartition(both, k - 1, axis=1)[:, :k]
                best[kind][at], margin[kind][at] = (np.take_along_axis(y, least, axis=1) for y in (both, apart))
        kind, i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(kind), pa.array(best[kind, i, j]), pa.array(margin[kind, i, j])], ["q", "kind", "dist", "margin"])

    found = rows.select("rid", "v").mapInArrow(lambda b: search(sliced(b)), "q long, kind long, dist double, margin double")
    best = found.groupBy("q", "kind").agg(F.slice(F.sort_array(F.collect_list(F.struct("dist", "margin"))), 1, k).alias("best")).collect()
    inside = {r.q: math.sqrt(r.best[-1].dist) for r in best if r.kind == 1 and len(r.best) == k}
    ratios = sorted((inside[r.q], [x.margin / max(inside[r.q], 1e-30) for x in r.best]) for r in best if r.kind == 0 and r.q in inside)
    reach = 0.0
    for part in np.array_split(np.arange(len(ratios)), 4):
        if len(part):
            reach = max(reach, float(np.quantile(np.concatenate([ratios[i][1] for i in part]), target, method="higher")))
    return min(1.0, max(0.0, reach)) if ratios else 1.0


def dealt(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first group, number of groups) of each list: groups of lists of `most` rows together, larger lists in several."""
    first, parts, at, room = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, 0
    for i, size in enumerate(sizes.tolist()):
        if size > room:
            at, room, parts[i] = at + 1, most, max(1, math.ceil(size / most))
        first[i] = at
        at, room = at + int(parts[i]) - 1, room - size if parts[i] == 1 else 0
    return first, parts


def closest(q: np.ndarray, own: np.ndarray, x: np.ndarray, rid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, squared distance) of the k nearest of x to each query but the row itself, fewer if there are fewer.

    own: the queries' rid. Ties go to the lower id.
    """
    middle = x.mean(axis=0, dtype=np.float64)
    inner, found = (x - middle).astype(np.float32), []
    high = (inner * inner).sum(axis=1).max()
    for at in range(0, len(q), SLICE):
        some = (q[at : at + SLICE] - middle).astype(np.float32)
        dist = squared(some, inner)
        dist[own[at : at + SLICE, None] == rid[None, :]] = np.inf
        # As many more as may be nearer than float32 says, so that the exact order decides, ties included.
        limit = np.partition(dist, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1] * (1 + 1e-5) + 2 * SLACK * ((some * some).sum(axis=1) + high)
        i, j = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
        exact = ((q[at + i].astype(np.float64) - x[j]) ** 2).sum(axis=1)
        best = nearest(i, ids[j], exact, k)
        found.append((at + i[best], j[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def knn(vectors: DataFrame, k: int = K, target: float = TARGET, every: int = 1) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k nearest other rows, among all, of each row of vectors(vec_id,
    embedding) whose vec_id is divisible by `every`; at 1 of all rows.

    Vectors, less the mean of all, are rotated at random and put into about sqrt(N) / 4 lists by k-means over all of
    them. Each query's bound is the distance of its k-th neighbour in its own list; it then probes the lists whose cells
    are nearer than `reach` times its bound (see tuned), few in dense regions and as many as it takes in sparse ones,
    and scan() abandons candidates whose partial distance over a few blocks of columns already shows, by a test at
    EPSILON, that they are over the bound. Distances given are exact. A task holds a group of lists, or a part of a
    large one, of HELD bytes, and gets each query once, whatever the number of lists that it probes there.

    Rows without a usable vector (see prepared) have no neighbours and are nobody's. Equal vectors are neighbours at
    distance 0, repeated rows too; ties go to the lower vec_id, null ids last. Null ids are carried along, and divisible
    by 1 only. Further columns are ignored. An empty table gives no rows; a table of fewer than k + 1 rows gives all
    pairs.
    """
    spark = vectors.sparkSession
    schema = "rid long, vec_id long, neighbour_id long, dist double"
    rows, d = prepared(vectors)
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    asks = F.lit(True) if every == 1 else F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    c = centroids(rows, d, max(1, math.ceil(math.sqrt(n) / 4)))
    reach = tuned(rows, rows.where(asks), c, k, target)
    known = spark.sparkContext.broadcast(c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            home = squared(matrix(b.column(2)), known.value).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *b.columns], ["list", "rid", "vec_id", "v"])

    homes = cut(rows.select("rid", "vec_id", "v").mapInArrow(assign, "list int, rid long, vec_id long, v binary"))
    sizes, asking = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for r in homes.groupBy("list").agg(F.count("*").alias("n"), F.sum(asks.cast("long")).alias("q")).collect():
        sizes[r.list], asking[r.list] = r.n, r.q
    most = max(1, HELD // (4 * d))
    first, parts = dealt(sizes, min(most, max(2048, math.ceil(n / 24))))
    #: How many groups of queries each group of lists meets, so that each has at most about `most` of them.
    mine = math.ceil(max(1, np.bincount(first, weights=asking).max()) / most)
    others = math.ceil(max(1, asking.sum()) / most)

    def held(salts: int) -> DataFrame:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                home, rid = b.column(0).to_numpy(), b.column(1).to_numpy()
                group = first[home] + (mix(rid.astype(np.uint64)) % parts[home].astype(np.uint64)).astype(np.int64)
                for salt in range(salts):
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(np.full(len(rid), salt)), *b.columns], names)

        names = ["group", "salt", "list", "rid", "vec_id", "v"]
        return homes.mapInArrow(place, "group long, salt long, list int, rid long, vec_id long, v binary")

    def answer(asked: pa.Table, i: np.ndarray, other: np.ndarray, dist: np.ndarray) -> pa.Table:
        at = pa.array(i)
        return pa.table({"rid": asked.column("rid").take(at), "vec_id": asked.column("vec_id").take(at), "neighbour_id": nullable(other), "dist": pa.array(dist)})

    def by_list(table: pa.Table) -> list[tuple[int, np.ndarray]]:
        home = table.column("list").to_numpy()
        order = np.argsort(home, kind="stable")
        return [(int(home[at[0]]), at) for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(at)]

    def within(asked: pa.Table, there: pa.Table) -> pa.Table:
        """The k nearest of each query in its own list."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and there.num_rows:
            q, own, x, rid, ids = matrix(asked.column("v")), asked.column("rid").to_numpy(), matrix(there.column("v")), there.column("rid").to_numpy(), ids_of(there.column("vec_id"))
            lists = dict(by_list(there))
            for home, ask in by_list(asked):
                for at in range(0, len(lists.get(home, ())), 4096):
                    some = lists[home][at : at + 4096]
                    i, j, dist = closest(q[ask], own[ask], x[some], rid[some], ids[some], k)
                    found.append((ask[i], ids[some[j]], dist))
        return answer(asked, *(np.concatenate(c) for c in zip(*found)))

    def beyond(home: np.ndarray, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether each query probes each list but its own."""
        _, far = margins(x, known.value, home)
        # With fewer than k rows in the own list there is no bound; reach may be 0.
        wide = np.where(np.isinf(bound), np.inf, reach * np.sqrt(np.where(np.isinf(bound), 0, bound)))
        return (far <= wide[:, None]) & (np.arange(far.shape[1])[None, :] != home[:, None])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query for each group that has a list to probe."""
        of = np.zeros((len(first), int((first + parts).max())), np.float32)
        for i in range(len(first)):
            of[i, first[i] : first[i] + parts[i]] = 1
        for b in sliced(batches):
            i, group = np.nonzero(beyond(b.column(0).to_numpy(), matrix(b.column(3)), b.column(4).to_numpy()).astype(np.float32) @ of)
            t = b.take(pa.array(i))
            salt = (mix(t.column(1).to_numpy().astype(np.uint64)) % np.uint64(others)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(salt), *t.columns], ["group", "salt", "list", "rid", "vec_id", "v", "bound"])

    def probe(asked: pa.Table, there: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and there.num_rows:
            q, home, bound, x, ids = matrix(asked.column("v")), asked.column("list").to_numpy(), asked.column("bound").to_numpy(), matrix(there.column("v")), ids_of(there.column("vec_id"))
            lists = [(each, x[at], ids[at]) for each, at in by_list(there)]
            for s in range(0, len(q), SLICE):
                part = slice(s, s + SLICE)
                probes = beyond(home[part], q[part], bound[part])
                for each, y, other in lists:
                    ask = s + np.flatnonzero(probes[:, each])
                    for at in range(0, len(y) if len(ask) else 0, 2048):
                        i, j, dist = scan(q[ask], bound[ask], y[at : at + 2048])
                        best = nearest(i, other[at + j], dist, k)
                        found.append((ask[i[best]], other[at + j[best]], dist[best]))
        i, other, dist = (np.concatenate(c) for c in zip(*found))
        best = nearest(i, other, dist, k)
        return answer(asked, i[best], other[best], dist[best])

    entry = F.struct("dist", F.col("neighbour_id").isNull().alias("missing"), "neighbour_id")
    top = F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("best")
    queries = homes.where(asks)
    at_home = spark.createDataFrame([(i, f, p) for i, (f, p) in enumerate(zip(first.tolist(), parts.tolist()))], "list int, first long, parts long")
    own = queries.join(F.broadcast(at_home), "list").withColumn("group", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
    own = own.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(mine))).select("group", "salt", "list", "rid", "vec_id", "v")
    near = own.groupBy("group", "salt").cogroup(held(mine).groupBy("group", "salt")).applyInArrow(within, schema)
    bound = F.when(F.size("best") == k, F.element_at("best", k)["dist"]).otherwise(F.lit(math.inf))
    known_best = cut(queries.join(near.groupBy("rid").agg(top), "rid", "left").select("list", "rid", "vec_id", "v", F.coalesce(bound, F.lit(math.inf)).alias("bound"), "best"))
    asked = known_best.select("list", "rid", "vec_id", "v", "bound").mapInArrow(spread, "group long, salt long, list int, rid long, vec_id long, v binary, bound double")
    far = asked.groupBy("group", "salt").cogroup(held(others).groupBy("group", "salt")).applyInArrow(probe, schema)
    near = known_best.select("rid", "vec_id", F.explode("best").alias("x")).select("rid", "vec_id", "x.neighbour_id", "x.dist")
    best = near.unionByName(far).groupBy("rid", "vec_id").agg(top)
    flat = best.select("vec_id", F.posexplode("best").alias("at", "x"))
    return flat.select("vec_id", "x.neighbour_id", (F.col("at") + 1).alias("rank"), F.sqrt("x.dist").alias("distance"))

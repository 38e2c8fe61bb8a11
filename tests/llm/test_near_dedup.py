import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import near_dedup as nd

from . import edges


def corpus(n=500, seed=2):
    """Random texts, some copies of others with a share of the words changed; the sources of the copies."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    texts, of = [], {}
    for i in range(n):
        if i > 50 and r.random() < 0.4:
            j = r.randrange(i)
            j = of.get(j, j)
            texts.append(" ".join(word() if r.random() < r.choice([0, 0.03, 0.1]) else w for w in texts[j].split()))
            of[i] = j
        else:
            texts.append(" ".join(word() for _ in range(r.randint(40, 200))))
    return texts, of


def test_groups_are_those_of_brute_force(spark):
    texts, of = corpus()
    docs = edges.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in nd.near_duplicates(docs, leaf=16).collect()}
    df, n = nd.document_frequencies(docs)
    fps = nd.fingerprints_of(pa.array(texts), np.log1p(n / np.maximum(df, 1)).astype(np.float32))
    x = np.ascontiguousarray(fps).view(np.uint64)
    apart = sum(np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(int) for k in range(nd.WORDS))
    parent = list(range(len(texts)))
    for i, j in zip(*np.nonzero(apart <= int(nd.LIMIT * nd.BITS))):
        a, b = (next(k for k in [i] if True) for i in (i, j))
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(i, j) for i, j in zip(*np.nonzero(apart <= int(nd.LIMIT * nd.BITS))) if i < j]
    found = sum(got[i].group_id == got[j].group_id for i, j in pairs)
    assert found >= 0.95 * len(pairs) and len(pairs) > 100
    for i in range(len(texts)):
        assert root(got[i].group_id) == root(i), "never more than brute force joins"
        assert got[i].keep == (got[i].group_id == i)
    assert sum(got[i].group_id == got[j].group_id for i, j in of.items()) >= 0.97 * len(of)
    kept = nd.keep(docs, leaf=16)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


@pytest.mark.parametrize("seed", range(5))
def test_links_connect_what_all_pairs_do(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, (6, nd.WORDS)).astype(np.uint64)
    fps = base[r.integers(0, 6, 1300)] ^ (np.uint64(1) << r.integers(0, 64, (1300, nd.WORDS)).astype(np.uint64))
    prefix = np.sort(r.integers(0, 3, 1300)).astype(np.uint64)
    pairs = nd.links(fps, prefix, 9)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 9) & (prefix[:, None] == prefix[None])
    assert all(near[i, j] for i, j in pairs)
    parts = [np.arange(1300), np.arange(1300)]
    for part, edges_ in zip(parts, (pairs, list(zip(*np.nonzero(near))))):
        changed = True
        a, b = (np.array(x) for x in zip(*edges_))
        while changed:
            low = np.minimum(part[a], part[b])
            before = part.copy()
            np.minimum.at(part, a, low)
            np.minimum.at(part, b, low)
            changed = (before != part).any()
    assert (parts[0] == parts[1]).all() and len(pairs) < 1300


@pytest.mark.parametrize("seed", range(4))
def test_links_by_weight_lose_no_pair_that_can_be_alike(seed):
    """Some rows' word sets differ in weight, some groups fill blocks; none is connected that all pairs don't."""
    r = np.random.default_rng(seed)
    n = 1500
    base = r.integers(0, 2**63, (40, nd.WORDS)).astype(np.uint64)
    of = np.where(r.random(n) < 0.4, 0, r.integers(0, 40, n))
    fps = base[of] ^ (np.uint64(1) << r.integers(0, 64, (n, nd.WORDS)).astype(np.uint64))
    prefix = np.sort(r.integers(0, 2, n)).astype(np.uint64)
    low = np.exp(r.normal(size=n) * 1.5)
    high = low * np.where(r.random(n) < 0.2, 2, 1)
    near = (np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2) <= 9) & (prefix[:, None] == prefix[None])
    can = near & (high[:, None] >= nd.ALIKE * low[None]) & (high[None] >= nd.ALIKE * low[:, None])
    pairs = nd.links(fps, prefix, 9, low, high)
    group = linked_groups(pairs)
    assert all(near[i, j] for i, j in pairs)
    assert all(group[i] == group[j] for i, j in zip(*np.nonzero(can)) if i != j)
    alone = nd.links(fps[:2] * np.uint64(0), prefix[:2] * np.uint64(0), 9, np.array([1.0, 2.0]), np.array([1.0, 2.0]))
    assert alone == [(0, 1)], "neighbours in the trie are compared whatever they weigh"


def test_far_weights_are_not_compared(monkeypatch):
    """Rows that weigh 1, 2, 4 and so on: all pairs would be 30 times as many."""
    r = np.random.default_rng(1)
    fps, weight = r.integers(0, 2**63, (20000, nd.WORDS)).astype(np.uint64), 2.0 ** r.integers(0, 30, 20000)
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(nd.np, "bitwise_count", lambda x, **k: compared.append(x.size) or count(x, **k))
    assert nd.links(fps, np.zeros(20000, np.uint64), 69, weight, weight) == []
    assert sum(compared) < 3 * 20000**2 / 30


def test_leading_bits_are_those_of_the_permutation():
    fps = np.random.default_rng(2).integers(0, 256, (50, nd.BITS // 8)).astype(np.uint8)
    order = nd.permutation(3)[:64]
    want = np.packbits(np.unpackbits(fps, axis=1)[:, order], axis=1).astype(np.uint64)
    assert (nd.leading(fps.view(np.uint64), order) == (want << np.arange(56, -1, -8, dtype=np.uint64)).sum(axis=1)).all()


def test_shape_reaches_the_recall():
    for n in (1, 10, 10_000, 10**8):
        depth, tries = nd.shape(n)
        assert nd.recall(depth, tries) >= nd.RECALL


def test_shape_reaches_the_recall_of_what_counts_as_a_copy():
    for n in (10_000, 10**6, 10**8):
        depth, tries = nd.shape(n)
        assert nd.recall(depth, tries, nd.LIMIT) >= nd.RECALL


def test_sparse_regions_climb(spark):
    """Two fingerprints that part within the depth in every trie, far from 600 others that crowd the other half."""
    r = np.random.default_rng(3)
    crowd, pair = r.integers(0, 2, (600, nd.BITS)).astype(np.uint8), np.repeat(r.integers(0, 2, (1, nd.BITS)).astype(np.uint8), 2, axis=0)
    for t in range(2):
        top = nd.permutation(t)
        crowd[:, top[0]], pair[:, top[0]] = 1, 0
        pair[0, top[3]], pair[1, top[3]] = 0, 1
    both = [np.packbits(x).tobytes() for x in pair]
    nodes = spark.createDataFrame([(np.packbits(x).tobytes(),) for x in crowd] + [(x,) for x in both], "fp binary")
    assert {frozenset(map(bytes, p)) for p in nd.close_pairs(nodes, 4, 2).collect()} == {frozenset(both)}


def test_regions_of_different_density_have_different_depths():
    """A region's depth: the bits that its first and last prefix share."""
    r = np.random.default_rng(8)
    dense = r.integers(0, 2**63, 5000).astype(np.uint64) >> np.uint64(3)  # all begin with 0000
    sparse = r.integers(0, 2**63, 40).astype(np.uint64) | np.uint64(1 << 63)
    prefix = np.sort(np.concatenate([dense, sparse]))
    region = nd.regions(prefix, 1, 9, 64)
    where = {int(s): np.flatnonzero(region == s) for s in np.unique(region)}
    assert all((np.diff(at) == 1).all() for at in where.values())
    depths = {s: 64 - int(prefix[at[0]] ^ prefix[at[-1]]).bit_length() for s, at in where.items()}
    assert all(len(at) <= 64 or depths[s] >= 9 for s, at in where.items())
    assert 5000 in where and len(where[5000]) == 40, "the sparse half climbs to its first bit"
    assert min(depths[s] for s in where if s < 5000) >= 8, "the crowded sixteenth goes down"


def linked_groups(pairs):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in list(parent)}


def test_dense_branches_are_dealt_to_blocks(spark):
    r = np.random.default_rng(9)
    base = r.integers(0, 2, (40, nd.BITS)).astype(np.uint8)
    fps = base[r.integers(0, 40, 900)]
    fps[r.random(fps.shape) < 0.03] ^= 1
    nodes = spark.createDataFrame([(np.packbits(x).tobytes(),) for x in fps], "fp binary").distinct()
    one, many = ([tuple(map(bytes, p)) for p in nd.close_pairs(nodes, 3, 3, 16, most=m).collect()] for m in (10**6, 60))
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b))
    assert all(apart(a, b) <= int(nd.LIMIT * nd.BITS) for a, b in many)
    groups, wider = linked_groups(one), linked_groups(many)
    assert all(wider[a] == wider[b] for a, b in one) and len(groups) > 800
    sizes = nd.paired(spark.range(500).withColumn("blocks", F.lit(4)), F.col("blocks"), F.col("id")).groupBy("one", "two").count().collect()
    assert len(sizes) == 6 and sum(x["count"] for x in sizes) == 1500


def test_large_groups_are_dealt_to_blocks(spark):
    texts, _ = corpus(300)
    docs = edges.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    weights = nd.word_weights(docs)
    found = nd.fingerprinted(docs, weights)
    linked = found.select("h", "fp", "ws", F.substring("fp", 1, 0).alias("root"))  # all in one group
    one, many = ({(bytes(r.r_fp), r.r_ws): bytes(r.part) for r in nd.divided(docs, linked, weights, most=m).collect()} for m in (10**6, 40))
    assert one == many and len(set(one.values())) < len(one)


def test_repeated_rows_maps_and_one_shuffle_of_texts(spark):
    docs = edges.documents(spark).withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    docs = docs.union(docs.where("doc_id = 1")).withColumn("source", F.monotonically_increasing_id().cast("string"))
    kept = nd.keep(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.columns == docs.columns and sum(r.doc_id == 1 for r in kept.collect()) == 1
    assert sum("Exchange hashpartitioning" in line for line in plan.split("\n")) <= 2


def test_short_documents_that_share_a_line_stay(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7)))
    lines = [" ".join(word() for _ in range(12)) for _ in range(20)]
    texts = [" ".join(word() for _ in range(3)) + "\n" + line for line in lines for _ in range(3)]
    texts += [" ".join(word() for _ in range(150)) for _ in range(60)]
    texts += [" ".join(word() if i % 40 == 7 else w for i, w in enumerate(t.split())) for t in texts[60:]]
    docs = edges.documents(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    assert {r.doc_id for r in nd.keep(docs).collect()} == set(range(120))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (103, 100)]
    pairs = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in chain], "a binary, b binary")
    got = {r.node[0]: r.root[0] for r in nd.components(pairs).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in (101, 102, 103)}
    assert nd.components(pairs.limit(0)).count() == 0


def test_edges(spark):
    docs = edges.documents(spark).union(edges.documents(spark, [(9, "", "en", "s", 0), (0, " \n\t ", "en", "s", 0), (None, "A plain text about the river and its banks!", "en", "s", 0)]))
    got = nd.near_duplicates(docs)
    assert got.count() == docs.count()
    by = sorted((r.doc_id or -1, r.group_id or -1, r.group_size, r.keep) for r in got.collect())
    assert [x for x in by if x[0] == 1] == [(1, 1, 3, False), (1, 1, 3, True)]
    kept = nd.keep(docs)
    assert kept.count() == got.where("keep").count()
    assert sum(r.doc_id == 1 for r in kept.collect()) == 1
    assert nd.near_duplicates(edges.documents(spark, [])).count() == 0 and nd.keep(edges.documents(spark, [])).count() == 0
    nulls = edges.documents(spark, [(1, None, "en", "s", 1), (1, None, "en", "s", 1)])
    assert nd.near_duplicates(nulls).where("keep and group_size = 1").count() == 2 and nd.keep(nulls).count() == 2
    blank = {r.doc_id: (r.group_id, r.keep) for r in nd.near_duplicates(docs).collect() if r.doc_id in (3, 9, 4, 0)}
    assert blank == {3: (3, True), 9: (3, False), 4: (0, False), 0: (0, True)}

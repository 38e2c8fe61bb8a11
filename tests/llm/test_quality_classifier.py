import random

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import quality_classifier as c

from . import edges


def test_contexts_are_those_of_brute_force():
    texts = ["a b c a", "", "x", None, "b b &&& a."]
    rows, words = c.words_of(pa.array(texts))
    columns, signs = c.index_vectors()
    want = np.zeros((c.VOCABULARY, c.DIMS))
    for i in range(len(words)):
        for j in range(len(words)):
            if i != j and abs(i - j) <= c.WINDOW and rows[i] == rows[j]:
                np.add.at(want[words[i]], columns[words[j]], signs[words[j]])
    assert (c.contexts(rows, words, columns, signs).reshape(want.shape) == want).all()
    assert list(np.bincount(rows, minlength=5)) == [4, 0, 1, 0, 5]


def test_index_vectors_are_sparse_and_balanced():
    columns, signs = c.index_vectors()
    assert all(len(set(r)) == c.NONZERO for r in columns[:100].tolist()) and not signs.sum(axis=1).any()


def test_pooling_is_that_of_brute_force():
    r = np.random.default_rng(0)
    v = c.Vectors(r.normal(size=(c.VOCABULARY, c.DIMS)).astype(np.float32), r.random(c.VOCABULARY).astype(np.float32))
    texts = ["a b c", "", None, "z", "a a a a"]
    got = v.pool(pa.array(texts))
    rows, words = c.words_of(pa.array(texts))
    for i in range(len(texts)):
        x, w = v.unit[words[rows == i]].astype(float), v.weight[words[rows == i]].astype(float)
        if len(x):
            mean = (w[:, None] * x).sum(0) / w.sum()
            step = np.diff(x, axis=0, prepend=x[:1])
            want = np.concatenate([mean, np.sqrt(np.maximum((w[:, None] * x * x).sum(0) / w.sum() - mean**2, 0)), np.sqrt((w[:, None] * step**2).sum(0) / w.sum())])
            assert np.allclose(got[i], want, atol=1e-3)
        else:
            assert not got[i].any()


def test_network_learns_and_temperature_calibrates():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    p = 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1] - x[:, 2]))
    y = (r.random(3000) < p).astype(float)
    raw = c.train(x[:1500], y[:1500])
    net = c.calibrated(raw, x[1500:2200], y[1500:2200])
    loss = lambda n: np.mean(np.logaddexp(0, z := n.logits(x[1500:2200]) / n.temperature) - y[1500:2200] * z)
    assert loss(net) <= loss(raw)
    sharp = c.Network(raw.shift, raw.scale, raw.w1, raw.b1, 3 * raw.w2, 3 * raw.b2)
    assert c.calibrated(sharp, x[1500:2200], y[1500:2200]).temperature == pytest.approx(3 * net.temperature, rel=1e-3)
    assert np.mean((net.probability(x[2200:]) > 0.5) == (p[2200:] > 0.5)) > 0.8
    held, t = net.logits(x[1500:2200]), np.geomspace(0.05, 20, 400)
    losses = [np.mean(np.logaddexp(0, held / s) - y[1500:2200] * held / s) for s in t]
    assert net.temperature == pytest.approx(t[int(np.argmin(losses))], rel=0.05)


def corpus(spark, n=900):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(2))
    docs = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(40)), "en", "s", 1) for i in range(n)]
    return edges.documents(spark, docs), edges.labels(spark, [(i, int(i % 3 != 0), 0) for i in range(0, n, 2)])


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    got = c.classify(docs, labels).collect()
    held = [r for r in got if r.doc_id % 2]
    assert np.mean([r.keep == (r.doc_id % 3 != 0) for r in held]) > 0.97


def test_sums_do_not_depend_on_partitions(spark):
    docs, _ = corpus(spark, 60)
    a, b = c.word_vectors(docs.repartition(1)), c.word_vectors(docs.repartition(7))
    assert (a.unit == b.unit).all() and (a.weight == b.weight).all()


def test_labels_of_one_class(spark):
    docs, labels = corpus(spark, 200)
    for q in (0, 1):
        one = labels.where(f"quality = {q}")
        n = one.count()
        assert {round(r.quality, 9) for r in c.classify(docs, one).collect()} == {round(abs(1 - q - (n + 1) / (n + 2)), 9)}


def test_edges(spark):
    docs = edges.documents(spark)
    got = c.classify(docs, edges.labels(spark))
    assert got.count() == docs.count() and {r.quality for r in got.where("doc_id in (2, 3, 4)").collect()} == {0.0}
    assert {r.quality for r in c.classify(docs, edges.labels(spark, [])).collect()} == {0.0, 0.5}
    assert c.classify(edges.documents(spark, []), edges.labels(spark)).count() == 0

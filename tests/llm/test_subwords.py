import math
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from lamina.llm import subwords as s

from . import edges

pytestmark = pytest.mark.skipif(not Path(s.MODEL).exists(), reason="no tokenizer files")


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=s.MODEL)


@pytest.fixture(scope="module")
def vocabulary():
    return s.Vocabulary.load()


@pytest.fixture(scope="module")
def pieces(model):
    return {model.id_to_piece(i): i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}


def segmentations(text, pieces, model, v):
    """All, with log probabilities."""
    def rest(t):
        if not t:
            yield (), 0.0
        for n in range(1, len(t) + 1):
            if t[:n] in pieces:
                for ids, w in rest(t[n:]):
                    yield (pieces[t[:n]], *ids), w + model.get_score(pieces[t[:n]]) * s.ALPHA
        if t and t[0] not in pieces:
            for ids, w in rest(t[1:]):
                yield (*(v.bytes_from + b for b in t[0].encode()), *ids), w + v.worst

    out = dict(rest("▁" + text.replace(" ", "▁")))
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


@pytest.mark.parametrize("text", ["there", "The th", "a\nbé 多", "x", "in  on", "  ", "🙂a", "\x00"])
def test_samples_are_distinct_and_their_chances_those_of_all_segmentations(text, vocabulary, pieces, model):
    every = segmentations(text, pieces, model, vocabulary)
    n, k = 4000, 3
    by = defaultdict(list)
    for i, r, ids, p, q, exact in s.encode_texts([text] * n, np.arange(n), vocabulary, k):
        ids = tuple(ids.tolist())
        assert exact and p == pytest.approx(every[ids], abs=1e-6) and r == len(by[i])
        by[i].append((ids, q))
    assert all(len({ids for ids, _ in x}) == len(x) == min(k, len(every)) for x in by.values())
    firsts = Counter(x[0][0] for x in by.values())
    for ids, p in every.items():
        p = math.exp(p)
        assert abs(firsts[ids] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n) + 1e-3
    if len(every) > 1:
        pairs = Counter((x[0][0], x[1][0]) for x in by.values())
        for a, b in pairs:
            p = math.exp(every[a] + every[b] - np.logaddexp.reduce([w for ids, w in every.items() if ids != a]))
            assert abs(pairs[a, b] / n - p) < 4.5 * math.sqrt(max(p * (1 - p), 0) / n) + 2e-3
    # The inclusion scores make the sum of probabilities an unbiased estimate of 1.
    totals = [sum(math.exp(every[ids]) / max(q, 1e-300) for ids, q in x if every[ids] > -600) for x in by.values()]
    assert np.mean(totals) == pytest.approx(1, abs=5 * np.std(totals) / math.sqrt(n) + 1e-6)


def test_likeliest_is_sampled_most(vocabulary, pieces, model):
    every = segmentations("other one", pieces, model, vocabulary)
    firsts = Counter(tuple(x[2].tolist()) for x in s.encode_texts(["other one"] * 500, np.arange(500), vocabulary, 1))
    assert every[firsts.most_common(1)[0][0]] > max(every.values()) - 0.3


def test_decoding_is_the_librarys(vocabulary, model):
    for text in ("", "a", "  two  spaces ", "çà 多字节 🙂\n\ttab", "mixed 12,345.67 (x)"):
        ids = model.encode(text)
        assert vocabulary.decode(ids) == model.decode(ids) == text
    assert vocabulary.decode([vocabulary.bytes_from + 0xFF]) == "�"
    assert vocabulary.decode([1, 2]) == ""


def test_batches_and_neighbours_do_not_matter(vocabulary):
    texts = ["one text", "", "another text", "one text", " x"]
    together = s.encode_texts(texts, np.array([5, 6, 7, 5, 9]), vocabulary, 2)
    alone = [(i, *x[1:]) for i, (t, k) in enumerate(zip(texts, [5, 6, 7, 5, 9])) for x in s.encode_texts([t], np.array([k]), vocabulary, 2)]
    plain = lambda rows: [(i, r, ids.tolist(), round(p, 6), round(q, 6), e) for i, r, ids, p, q, e in rows]
    assert plain(together) == plain(alone)
    assert plain(together)[0][2:] == [(0, *x[1:]) for x in plain(together) if x[0] == 3][0][2:]


def test_list_array():
    rows = (np.array([1, 2], np.int32), None, np.zeros(0, np.int32), np.array([3], np.int32))
    assert s.list_array(rows).to_pylist() == [[1, 2], None, [], [3]] and s.list_array((None,)).to_pylist() == [None] and s.list_array(()).to_pylist() == []


def test_table(spark):
    docs = edges.documents(spark)
    got = s.encode(docs)
    rows = got.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(r.exact for r in rows if r.ids is not None) and sum(r.ids is None for r in rows) == 2
    assert [(r.sample, list(r.ids), r.log_prob, r.inclusion) for r in rows if r.doc_id == 3] == [(0, [], 0.0, 1.0)]
    back = got.where("doc_id is not null and ids is not null").select("doc_id", s.decoded(got.ids).alias("t")).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.t == text[r.doc_id] for r in back) and len(back) > 12
    assert len({(r.sample, tuple(r.ids)) for r in rows if r.doc_id == 1}) == 2 and sum(r.doc_id == 1 for r in rows) == 4
    assert s.encode(edges.documents(spark, [])).count() == 0


def test_edges_have_their_log_probability_and_words_their_pieces_in_order():
    """Log probabilities are looked up, and the first sample's pieces are put in place without sorting."""
    v = s.Vocabulary.load()
    texts = ["the river and its banks", "", "a", "Überlauf \U0001f600 the the river", " ".join(map(str, range(300)))]
    lat = s.lattice(texts, v)
    assert np.array_equal(lat.logs, lat.weight + lat.beta[lat.to] - lat.beta[lat.node]) and np.allclose(np.exp(lat.logs), lat.p)
    owner, edge, _, _ = next(s.sample(lat, np.arange(5).astype(np.uint64), 5, 2))
    assert (np.diff(owner) >= 0).all()
    follows = lat.to[edge[:-1]] == lat.node[edge[1:]]
    ends = lat.to[edge] < len(lat.size)
    assert (follows | ends[:-1]).all() and ends.sum() == len(lat.word)

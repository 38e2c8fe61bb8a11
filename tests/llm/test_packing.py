import random

import pytest

from lamina.llm import packing as p
from lamina.llm.packing import two_fit

from . import edges


def brute(lengths, capacity):
    """The same rules by looking at every item and every pair."""
    left, bins = set(range(len(lengths))), []

    def first(n):
        return min(i for i in left if lengths[i] == n)

    while left:
        held, gap = [], capacity
        while fits := [lengths[i] for i in left if lengths[i] <= gap]:
            i = first(max(fits))
            left.remove(i)
            held.append(i)
            gap -= lengths[i]
        while gap:
            short = min(held, key=lambda i: (lengths[i], -held.index(i)))
            room = gap + lengths[short]
            pairs = [(lengths[a] + lengths[b], max(lengths[a], lengths[b])) for a in left for b in left if a < b and lengths[short] < lengths[a] + lengths[b] <= room]
            if not pairs:
                break
            total, longer = max(pairs)
            held.remove(short)
            for n in (longer, total - longer):
                i = first(n)
                left.remove(i)
                held.append(i)
            left.add(short)
            gap = room - total
        bins.append(held)
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_bins_are_those_of_the_rules(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, r.choice([20, 60])) for _ in range(r.randint(0, 60))]
    got = two_fit(lengths, 60)
    assert got == brute(lengths, 60)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))


def test_a_replacement_fills_better():
    assert two_fit([6, 3, 2, 2], 10) == [[0, 2, 3], [1]]


def test_many_replacements_stay_fast():
    import time

    r = random.Random(0)
    lengths = [r.choice([3, 5, 1750]) for _ in range(50_000)]
    began = time.process_time()
    bins = two_fit(lengths, p.CAPACITY)
    assert time.process_time() - began < 5 and sum(map(len, bins)) == 50_000


def test_tokens_are_the_whole_text():
    encoding, inside = p.tokenizer(p.VOCABULARY)
    for text in ["", "a", "We'll go  now \n\n x  ", edges.LONG, "x" * 50_000, "çà et là 🙂🙂 多字节" * 400, " " * 10_000, "\n" * 1_000_000 + "x", "\n \t" * 5000]:
        tokens = p.tokens_of(text)
        assert encoding.decode(tokens) == text
        for capacity in (1, 3, 7, 1000):
            starts = p.cut_points(tokens, capacity, inside)
            ends = [*starts[1:], len(tokens) + 1]
            assert starts[0] == 0 and all(0 < e - s <= capacity for s, e in zip(starts, ends))
            if capacity >= 7:
                assert "".join(encoding.decode_bytes(tokens[s:e]).decode() for s, e in zip(starts, ends)) == text, "no character is cut"
            assert len(starts) <= -(-(len(tokens) + 1) // max(1, capacity - 3)) + 1


def test_table(spark):
    got = p.pack(edges.documents(spark), capacity=1000, shard=40).toPandas()
    assert set(got["doc_id"].dropna()) == {1, 3, 4, 5, 6, 7, 8}
    assert (got.groupby("bin_id")["length"].sum() <= 1000).all()
    by = got[got.doc_id == 5].sort_values("start")
    assert by["length"].sum() == len(p.tokens_of(edges.LONG)) + 1 and (by["start"].diff().dropna() == 1000).all()
    assert list(got[got.doc_id == 3]["length"]) == [1] and len(got[got.doc_id == 1]) == 2
    ends = got.sort_values(["bin_id", "slot"]).groupby("bin_id")
    for _, b in ends:
        assert list(b["slot"]) == list(range(len(b))) and list(b["offset"]) == [0, *b["length"].cumsum()[:-1]]
    assert p.pack(edges.documents(spark, [])).count() == 0


def test_query_is_that_of_brute_force(spark):
    """One shard, packed by the rules from each text's tokens."""
    r = random.Random(3)
    docs = [(i, " ".join("word" * r.randint(1, 3) for _ in range(r.randint(0, 60))), "en", "s", 1) for i in range(60)]
    parts = []
    for i, text, *_ in docs:
        n = len(p.tokens_of(text)) + 1
        parts += [(i, k, min(50, n - 50 * k)) for k in range(-(-n // 50))]
    want = sorted(sorted(parts[i] for i in b) for b in brute([n for *_, n in parts], 50))
    got = {}
    for x in p.pack(edges.documents(spark, docs), capacity=50, shard=10**6).collect():
        got.setdefault(x.bin_id, []).append((x.doc_id, x.piece, x.length))
    assert sorted(map(sorted, got.values())) == want

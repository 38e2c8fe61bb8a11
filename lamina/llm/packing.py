"""Best-two-fit packing of documents into fixed-size training sequences."""

from __future__ import annotations

import base64
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, row_hash, slices

#: Ranks of a byte-level vocabulary, whose tokens' bytes make up any text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 4096
SHARD = 50_000
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Longer runs of white space are tokenised in parts, as the pattern's backtracking has a limit.
BLANKS = re.compile(r"\s{1000}")
PIECES = "doc_id long, piece int, start long, length int"
SCHEMA = "bin_id long, slot int, offset int, doc_id long, piece int, start long, length int"


def two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes into lengths, each of 1..capacity; every index is in just one bin, which holds `capacity` at most.

    A bin first takes, again and again, the longest unpacked item that fits. Then, while it has a gap, its shortest
    item s is replaced by the two unpacked items of the largest sum that is over s and fits gap + s; of equal sums,
    the pair with the longest item. s can then be packed later. Of items of equal length the first goes first.
    Both searches are bit operations on the set of unpacked lengths, bit i being length i.
    """
    stock: dict[int, list[int]] = defaultdict(list)
    for i, n in enumerate(lengths):
        stock[n].append(i)
    for each in stock.values():
        heapify(each)
    have = mirror = 0
    for n in stock:
        have |= 1 << n
        mirror |= 1 << (capacity - n)
    bins = []
    while have:
        held: list[tuple[int, int]] = []
        gap = capacity
        while gap and (fits := have & ((2 << gap) - 1)):
            n = fits.bit_length() - 1
            held.append((n, heappop(stock[n])))
            if not stock[n]:
                have ^= 1 << n
                mirror ^= 1 << (capacity - n)
            gap -= n
        while gap and have:
            least = min(range(len(held)), key=lambda k: (held[k][0], -k))
            short = held[least][0]
            pair = None
            for total in range(short + gap, short, -1):
                both = have & (mirror >> (capacity - total))
                if both:
                    a = both.bit_length() - 1
                    if 2 * a != total or len(stock[a]) > 1:
                        pair = (a, total - a)
                        break
            if pair is None:
                break
            back = held.pop(least)
            for n in pair:
                held.append((n, heappop(stock[n])))
                if not stock[n]:
                    have ^= 1 << n
                    mirror ^= 1 << (capacity - n)
            if not stock[short]:
                have |= 1 << short
                mirror |= 1 << (capacity - short)
            heappush(stock[short], back[1])
            gap += short - sum(pair)
        bins.append([i for _, i in held])
    return bins


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_built: dict[str, tuple] = {}


def tokenizer(path: str, ranks: Callable[[], dict[bytes, int]] | None = None):
    """The encoding, and for each id whether its bytes begin inside a character; made once in a process, from ranks() or
    the file."""
    if path not in _built:
        import tiktoken

        known = ranks() if ranks else ranks_of(path)
        inside = np.zeros(max(known.values()) + 1, bool)
        for token, rank in known.items():
            inside[rank] = 0x80 <= token[0] < 0xC0
        _built[path] = (tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=known, special_tokens={}), inside)
    return _built[path]


def tokens_of(text: str, path: str = VOCABULARY) -> list[int]:
    encoding, _ = tokenizer(path)
    if len(text) < 1000 or not (cuts := [m.end() for m in BLANKS.finditer(text)]):
        return encoding.encode_ordinary(text)
    return [t for a, b in zip([0, *cuts], [*cuts, len(text)]) for t in encoding.encode_ordinary(text[a:b])]


def cut_points(tokens: list[int], capacity: int, inside: np.ndarray) -> list[int]:
    """Where pieces of at most `capacity` of the tokens and one end token begin; not inside a character if that can be."""
    starts, at, n = [0], capacity, len(tokens) + 1
    while at < n:
        back = at
        while at < n - 1 and back > starts[-1] and inside[tokens[back]]:
            back -= 1
        starts.append(back if back > starts[-1] else at)
        at = starts[-1] + capacity
    return starts


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length): each text's tokens and one end token, cut into pieces of `capacity` at most.

    The driver alone reads the vocabulary's file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks_of(vocabulary))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, inside = tokenizer(vocabulary, lambda: shared.value)
        for b in slices(batches, "text"):
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = tokens_of(text, vocabulary)
                starts = cut_points(tokens, capacity, inside)
                rows += [(d, k, s, e - s) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(tokens) + 1]))]
            if rows:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length"])

    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, PIECES)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs docs(doc_id, text) into bins of `capacity` tokens by best-two-fit; a row for each piece of a document.

    bin_id; slot, its order in the bin; offset, where it begins in the bin; doc_id; piece, start and length, the part
    of the document. A document is its tokens of `vocabulary` and one end token. Longer documents are cut into pieces of
    `capacity` tokens, a few less where a character would be cut, and a rest; nothing is left out or shortened. Pieces
    are hashed over as many shards as keep a shard near `shard` pieces, and each shard is packed by itself; only these
    narrow rows are shuffled.

    Null texts have nothing to pack and no row; an empty text is its end token. Null ids, repeated rows and ties are
    packed like any other, in order of (length, doc_id, piece). Further columns are ignored. An empty table: no rows.
    """
    parts = cut(pieces(docs, capacity, vocabulary))
    shards = max(1, -(-parts.count() // shard))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "length"], kind="stable").reset_index(drop=True)
        bins = two_fit(rows["length"].tolist(), capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        sizes = np.array([len(b) for b in bins])
        out = rows.iloc[order].reset_index(drop=True)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        begin = np.cumsum(out["length"].to_numpy()) - out["length"].to_numpy()
        out["bin_id"] = np.repeat(np.arange(len(bins)), sizes) + (int(key[0]) << 32)
        out["slot"] = (np.arange(len(out)) - first).astype(np.int32)
        out["offset"] = (begin - begin[first]).astype(np.int32)
        return out[["bin_id", "slot", "offset", "doc_id", "piece", "start", "length"]]

    where = F.pmod(row_hash("doc_id", "piece", "length"), F.lit(shards)).cast("int")
    return parts.withColumn("shard", where).groupBy("shard").applyInPandas(one, SCHEMA)

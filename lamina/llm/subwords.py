"""SentencePiece segmentations sampled without replacement by Gumbel top-k search over the lattice, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import mix, powers, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
#: Piece scores are multiplied by this; a segmentation's probability is in proportion to the exponential of their sum.
ALPHA = 2e-4
SPACE = "▁"
SLICE = 1 << 20
SLOT_BITS, PAIR_BITS = 18, 20
#: The state of the random numbers before any part.
BEGIN = np.uint64(0x8B72E9D5)
SPREAD = np.uint64(0xD1342543DE82EF95)
SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, inclusion double, exact boolean"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces' ids and scaled scores; the ids of the bytes; all ids' bytes, for decoding.

    slots is an open hash table of the pieces' keys, at their first SLOT_BITS bits or the next free place, 0 free; at
    has the piece for each slot. begun tells by the first bits of a hash whether it can be that of a piece's beginning."""

    slots: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    begun: np.ndarray
    longest: int
    bytes_from: int
    worst: float
    #: Whether some piece can hold two characters side by side, by pair_keys(). Where none can, texts are cut.
    pairs: np.ndarray
    #: Of each id the bytes that it stands for: spelled[starts[id] :][: sizes[id]].
    spelled: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def load(path: str = MODEL, alpha: float = ALPHA) -> "Vocabulary":
        """From a SentencePiece model with byte fallback, a dummy prefix and no normalisation."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n, texts, known = model.vocab_size(), [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                texts.append(int(piece[3:5], 16))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                texts.append(None)
            else:
                texts.append(piece)
                known.append(i)
        first = texts.index(0)
        if [texts[first + b] for b in range(256)] != list(range(256)):
            raise ValueError("the model has no byte fallback")
        keys = piece_keys([texts[i] for i in known])
        scores = np.array([model.get_score(i) for i in known]) * alpha
        bits = SLOT_BITS
        slots, at, begun = np.zeros((1 << bits) + 1024, np.uint64), np.zeros((1 << bits) + 1024, np.int64), np.zeros(1 << 20, bool)
        for k, key in enumerate(keys.tolist()):
            free = key >> (64 - bits)
            while slots[free]:
                free += 1
            slots[free], at[free] = key, k
        begun[piece_keys(sorted({texts[i][:n] for i in known for n in range(1, len(texts[i]))})) >> np.uint64(44)] = True
        ids = np.array(known, np.int32)
        raw = [b"" if t is None else t.replace(SPACE, " ").encode() if isinstance(t, str) else bytes([t]) for t in texts]
        sizes = np.array([len(b) for b in raw])
        pairs = np.zeros(1 << PAIR_BITS, bool)
        for t in (texts[i] for i in known):
            pairs[pair_keys(codes_of(t))] = True
        return Vocabulary(slots, at, ids, scores, begun, max(len(texts[i]) for i in known), first, float(scores[scores > -1e4].min()), pairs, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes) - sizes, sizes)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The pieces of the keys, -1 of what is none."""
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        held = self.slots[slot]
        out = np.where(held == keys, self.at[slot], -1)
        more = np.flatnonzero((held != keys) & (held != 0))
        while len(more):
            slot[more] += 1
            held = self.slots[slot[more]]
            hit = held == keys[more]
            out[more[hit]] = self.at[slot[more[hit]]]
            more = more[~hit & (held != 0)]
        return out

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each of several texts, whose ids end at `ends`: spaces for the marks, without the first,
        which encoding adds. Control ids are nothing."""
        size = self.sizes[ids]
        last = np.cumsum(size)
        raw = self.spelled[np.repeat(self.starts[ids] - (last - size), size) + np.arange(last[-1] if len(last) else 0)].tobytes()
        at = np.concatenate([[0], last])[np.concatenate([[0], ends])].tolist()
        return [raw[x:y].removeprefix(b" ") for x, y in zip(at, at[1:])]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that don't form UTF-8 become U+FFFD. Ids outside the vocabulary raise an IndexError."""
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def pair_keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of each two neighbours, PAIR_BITS each."""
    with np.errstate(over="ignore"):
        both = codes[:-1].astype(np.uint64) << np.uint64(21) | codes[1:].astype(np.uint64)
        return ((both + np.uint64(1)) * SPREAD >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((codes + np.uint64(1)) * up, out=sums[1:])
    return sums


def keys_at(sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of the substrings."""
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return (sums[start + length] - sums[start]) * down[start] * SPREAD + np.asarray(length).astype(np.uint64)


def piece_keys(pieces: list[str]) -> np.ndarray:
    sums = prefix_sums(codes_of("".join(pieces)))
    sizes = np.array([len(p) for p in pieces])
    return keys_at(sums, np.cumsum(sizes) - sizes, sizes)


@dataclass
class Lattice:
    """Of the distinct words of some texts, longest first. Node row[r] + w is r characters before the end of word w;
    left is that r of each node.

    The edges of a node are first[node] .. first[node + 1] - 1, shortest pieces first: node; id, the piece's or -2 - c for
    the bytes of character c; to, the node it leads to; weight, its scaled score; p, its probability given the node, over
    all completions, and logs, its log; run, the running sum of the node's probabilities. beta is the log of a node's
    completions' weight.
    """

    text: np.ndarray
    word: np.ndarray
    size: np.ndarray
    row: np.ndarray
    left: np.ndarray
    first: np.ndarray
    node: np.ndarray
    id: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    beta: np.ndarray
    p: np.ndarray
    logs: np.ndarray
    run: np.ndarray

    def log_prob(self, edge: np.ndarray) -> np.ndarray:
        return self.logs[edge]

    def others(self, node: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes x slots) log probabilities of the nodes' edges, -inf for those in the bit sets taken; and the log of
        their sums, exact however small it is."""
        begin, degree = self.first[node], self.first[node + 1] - self.first[node]
        slots = np.arange(degree.max(initial=1))
        shut = (taken[:, None] >> slots & 1 > 0) | (slots >= degree[:, None])
        logs = np.where(shut, -np.inf, self.log_prob(np.minimum(begin[:, None] + slots, len(self.p) - 1)))
        top = np.maximum(logs.max(axis=1), -1e300)
        with np.errstate(divide="ignore"):
            return logs, top + np.log(np.exp(logs - top[:, None]).sum(axis=1))


def lattice(texts: list[str], v: Vocabulary) -> Lattice:
    """Texts are cut into words wherever no piece can hold both characters, so that words are independent."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    codes = codes_of("".join(marked))
    sizes = np.array([len(m) for m in marked], np.int64)
    begins = np.cumsum(sizes) - sizes
    head = np.ones(len(codes), bool)
    head[1:] = ~v.pairs[pair_keys(codes)]
    head[begins[sizes > 0]] = True
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(codes)))
    sums = prefix_sums(codes)
    # Of texts that begin at the same place all but the last are empty: searchsorted gives the last.
    text = np.searchsorted(begins, start, side="right") - 1
    _, at, word = np.unique(keys_at(sums, start, length), return_index=True, return_inverse=True)
    longest_first = np.argsort(-length[at], kind="stable")
    place = np.empty(len(at), np.int64)
    place[longest_first] = np.arange(len(at))
    at, word = at[longest_first], place[word]
    size, end = length[at], start[at] + length[at]
    most = int(size[0]) if len(size) else 0
    wide = np.concatenate([[len(size)], np.searchsorted(-size, -np.arange(1, most + 1), side="right")]).astype(np.int64)
    row = np.concatenate([[0], np.cumsum(wide)])
    nodes = int(row[-1])
    left = np.repeat(np.arange(most + 1), wide)
    owner = np.arange(nodes) - row[left]
    where = end[owner] - left
    _, down = powers(len(sums))
    here, scale = sums[where], down[where]
    found, degree = [], np.zeros(nodes, np.int64)
    active = np.arange(row[1] if most else 0, nodes)
    for n in range(1, min(v.longest, most) + 1):
        # active: nodes with n characters left whose first n - 1 begin some piece.
        with np.errstate(over="ignore"):
            keys = (sums[where[active] + n] - here[active]) * scale[active] * SPREAD + np.uint64(n)
        piece = v.find(keys)
        if n == 1:
            piece[piece < 0] = -2
        hit = np.flatnonzero(piece != -1)
        node = active[hit]
        found.append((n, node, piece[hit], degree[node]))
        degree[node] += 1
        active = active[v.begun[keys >> np.uint64(44)] & (left[active] > n)]
    first = np.concatenate([[0], np.cumsum(degree)])
    ids, to, weight = np.empty(first[-1], np.int32), np.empty(first[-1], np.int64), np.empty(first[-1])
    for n, node, piece, rank in found:
        edge = first[node] + rank
        ids[edge] = np.where(piece >= 0, v.ids[piece], -2 - codes[where[node]].astype(np.int64))
        weight[edge] = np.where(piece >= 0, v.scores[piece], v.worst)
        to[edge] = row[left[node] - n] + owner[node]
    beta, p, logs = np.zeros(nodes), np.empty(len(ids)), np.empty(len(ids))
    group = np.repeat(np.arange(nodes), degree)
    for r in range(1, most + 1):
        a, b = row[r], row[r + 1]
        edges = slice(first[a], first[b])
        starts, own = first[a:b] - first[a], group[edges] - a
        values = logs[edges] = weight[edges] + beta[to[edges]]
        top = np.maximum.reduceat(values, starts)
        values = np.exp(values - top[own])
        total = np.add.reduceat(values, starts)
        beta[a:b] = top + np.log(total)
        p[edges] = values / total[own]
    logs -= beta[group]
    run = np.cumsum(p)
    run -= np.concatenate([[0.0], run])[first[group]]
    return Lattice(text, word, size, row, left, first, group, ids, to, weight, beta, p, logs, run)


def stirred(x: np.ndarray | np.uint64, *parts: np.ndarray | int) -> np.ndarray:
    """The state of the random numbers after further parts."""
    with np.errstate(over="ignore"):
        for p in parts:
            x = mix(np.asarray(p).astype(np.uint64) + (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95))
    return x


def uniform(*parts: np.ndarray | int, state: np.ndarray | np.uint64 = BEGIN) -> np.ndarray:
    """Random numbers in (0, 1), a function of the parts alone; state is what stirred() gives for the first of them."""
    return ((stirred(state, *parts) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def truncated(mass: np.ndarray, limit: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of location mass, given that they are at most limit: u inverted, scaled to the value there."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(np.minimum(mass - limit, 700)) - np.log(u)))


def sample(lat: Lattice, seeds: np.ndarray, texts: int, k: int) -> Iterator[tuple]:
    """For each r < k: (text of each piece, its edge; of each text log probability, perturbed value); last, the bound.

    A search node is a beginning of a segmentation with some next edges excluded; its value is the greatest perturbed
    log probability, log p + Gumbel noise, of its completions, which is Gumbel with its whole mass as location. The best
    node is taken from the queue and completed at random, which gives the segmentation that has that value; what else
    it held are the nodes that leave the segmentation at one of its pieces, with values cut off at that of their
    parent. So segmentations come in order of their perturbed values: a sample without replacement. The bound that is
    yielded last is the best value left, of the segmentation that would come next.
    """
    word, text = lat.word, lat.text
    count = np.bincount(text, minlength=texts)
    ordinal = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    initial = lat.row[lat.size[word]] + word

    def walk(r: int, inst: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Random completions of words from nodes on: (word instance, edge, place in the completion) of each piece, those
        of a word in order."""
        out = []
        with np.errstate(over="ignore"):
            turn = np.uint64(0xA24BAED4963EE407 * r & (1 << 64) - 1)
            key = mix(seeds + turn)[text[inst]] + ordinal[inst].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        key = stirred(BEGIN, key)
        while len(inst):
            u = uniform(lat.left[node], state=key)
            edge, stop = lat.first[node], lat.first[node + 1] - 1
            more = np.flatnonzero((lat.run[edge] < u) & (edge < stop))
            while len(more):
                edge[more] += 1
                more = more[(lat.run[edge[more]] < u[more]) & (edge[more] < stop[more])]
            out.append((inst, edge, np.full(len(inst), len(out))))
            node = lat.to[edge]
            go = np.flatnonzero(node >= len(lat.size))
            inst, node, key = inst[go], node[go], key[go]
        return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))

    paths: list[dict[str, np.ndarray]] = []
    value = -np.log(-np.log(uniform(seeds, 1 << 40)))
    live = np.ones(texts, bool)
    for r in range(k + 1):
        cut_at, banned = np.full(texts, -1), np.zeros(texts, np.int64)
        if not r:
            found, unordered, place = walk(r, np.arange(len(text)), initial)
            pieces = np.bincount(found, minlength=len(text))
            inst, edge = np.repeat(np.arange(len(text)), pieces), np.empty(len(found), np.int64)
            edge[(np.cumsum(pieces) - pieces)[found] + place] = unordered
        else:
            best, chosen, where = np.full(texts, -np.inf), np.full(texts, -1), np.zeros(texts, np.int64)
            for s, p in enumerate(paths):
                if not len(p["text"]):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], p["text"][1:] != p["text"][:-1]]))
                top = np.full(texts, -np.inf)
                top[p["text"][starts]] = np.maximum.reduceat(p["value"], starts)
                hit = np.flatnonzero((p["value"] == top[p["text"]]) & (top[p["text"]] > best[p["text"]]))
                better = p["text"][hit]
                best[better], chosen[better], where[better] = p["value"][hit], s, hit
            if r == k:
                yield best
                return
            live, value = chosen >= 0, best
            kept, starters = [], []
            for s, p in enumerate(paths):
                own = np.flatnonzero(chosen == s)
                if not len(own):
                    continue
                at = where[own]
                p["value"][at] = -np.inf
                node = p["node"][at]
                taken = p["banned"][at] | 1 << (p["edge"][at] - lat.first[node])
                other, mass = lat.others(node, taken)
                run = np.cumsum(np.exp(other - mass[:, None]), axis=1)
                e = lat.first[node] + (run < uniform(seeds[own], r, 1 << 41)[:, None] * run[:, -1:]).sum(axis=1)
                limit = np.full(texts, -1, np.int64)
                limit[own] = at
                before = np.flatnonzero(np.arange(len(p["text"])) < limit[p["text"]])
                cut_at[own], banned[own] = at - np.searchsorted(p["text"], own), taken
                kept.append((p["inst"][before], p["edge"][before]))
                kept.append((p["inst"][at], e))
                after = lat.to[e]
                go = after >= len(lat.size)
                starters.append((p["inst"][at][go], after[go]))
                last = np.full(texts, len(text) + 1, np.int64)
                last[own] = p["inst"][at]
                rest = np.flatnonzero(np.arange(len(text)) > last[text])
                starters.append((rest, initial[rest]))
            fresh = walk(r, *(np.concatenate([x[i] for x in starters]) if starters else np.zeros(0, np.int64) for i in range(2)))
            inst, edge = (np.concatenate([*[x[i] for x in kept], fresh[i]]) for i in range(2))
            # Of one word the pieces are in order already.
            order = np.argsort(inst, kind="stable")
            inst, edge = inst[order], edge[order]
        owner = text[inst]
        size = np.bincount(owner, minlength=texts)
        first = np.cumsum(size) - size
        run = np.concatenate([[0.0], np.cumsum(lat.log_prob(edge))])
        before = run[:-1] - run[first][owner]
        total = run[first + size] - run[first]
        index = np.arange(len(owner)) - first[owner]
        node = lat.node[edge]
        out = np.zeros(len(owner), np.int64)
        at = np.flatnonzero(index == cut_at[owner])
        out[at] = banned[owner[at]]
        p = lat.p[edge]
        with np.errstate(divide="ignore"):
            mass = before + np.log1p(-np.minimum(p, 1))
        # Where little is left, or more is taken, the rest is summed; of a single edge nothing is left.
        near = np.flatnonzero(((p > 1 - 1e-6) | (out > 0)) & (lat.first[node + 1] - lat.first[node] > 1))
        mass[near] = before[near] + lat.others(node[near], out[near] | 1 << (edge[near] - lat.first[node[near]]))[1]
        values = truncated(mass, value[owner], uniform((1 << 42) + index, state=stirred(BEGIN, seeds, r)[owner]))
        values[index < cut_at[owner]] = -np.inf
        paths.append({"text": owner, "inst": inst, "node": node, "edge": edge, "value": values, "banned": out})
        yield owner, edge, np.where(live, total, -np.inf), np.where(live, value, -np.inf)


def pieces_of(lat: Lattice, edge: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many for each edge): one id a piece, the UTF-8 bytes of characters without one."""
    ids = lat.id[edge]
    lost = np.flatnonzero(ids < -1)
    count = np.ones(len(ids), np.int64)
    if not len(lost):
        return ids, count
    spelled = [chr(-2 - int(c)).encode("utf-8") for c in ids[lost]]
    count[lost] = [len(b) for b in spelled]
    out = np.repeat(ids, count)
    out[np.repeat(ids < -1, count)] = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int32) + v.bytes_from
    return out, count


def encode_texts(texts: list[str], keys: np.ndarray, v: Vocabulary, k: int = SAMPLES) -> list[tuple[int, int, np.ndarray, float, float, bool]]:
    """(text, sample, ids, log probability, inclusion, whether decoding gives the text) of k distinct segmentations of
    each text, fewer if it has fewer."""
    lat = lattice(texts, v)
    n = len(texts)
    drawn = list(sample(lat, mix(keys.astype(np.uint64) + np.uint64(11)), n, k))
    bound = drawn.pop()
    out, raw = [], [t.encode() for t in texts]
    for r, (owner, edge, logp, value) in enumerate(drawn):
        ids, count = pieces_of(lat, edge, v)
        ends = np.cumsum(np.bincount(owner, weights=count, minlength=n).astype(np.int64))
        with np.errstate(over="ignore", invalid="ignore"):
            chance = -np.expm1(-np.exp(np.minimum(logp - bound, 700)))
        back = v.decode_all(ids, ends)
        for i in np.flatnonzero(np.isfinite(value) if r else np.ones(n, bool)):
            out.append((int(i), r, ids[ends[i - 1] if i else 0 : ends[i]], float(logp[i]), float(chance[i]), back[i] == raw[i]))
    return sorted(out, key=lambda x: x[:2])


def list_array(rows: tuple[np.ndarray | None, ...]) -> pa.Array:
    """Arrays of ids, or None, as one Arrow column, without an object for each id."""
    ends = np.cumsum([0 if r is None else len(r) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int32), *[r for r in rows if r is not None]])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, pa.int32()), mask=pa.array([r is None for r in rows], pa.bool_()))


def encode(docs: DataFrame, model: str = MODEL, samples: int = SAMPLES, alpha: float = ALPHA) -> DataFrame:
    """`samples` distinct segmentations of each row of docs(doc_id, text): doc_id, sample, ids, log_prob, inclusion, exact.

    A segmentation's probability is in proportion to exp(alpha * sum of piece scores) among all of the text. They are
    the `samples` best by perturbed probability, in that order: a sample without replacement by Gumbel top-k, found by
    best-first search (see sample()), not by enumeration. inclusion is the probability that a segmentation's perturbed
    value is over that of the next one, which was not taken: 1 / inclusion weighs estimates over samples. Random
    numbers are a function of doc_id and of the place in the text, so results don't depend on partitions or retries.
    exact tells whether decoding the ids gives the text back; of ordinary text it always does, a text that holds the
    mark character itself gets a space there. The model file is read by the driver alone.

    A text with fewer segmentations has fewer rows; an empty text has one, of no ids. A null text has one row of null
    ids and probabilities. Null ids share the seed of 0. Repeated rows give equal rows. Whole texts are read. Further
    columns are ignored. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, alpha))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in slices(batches, "text", SLICE):
            doc, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            some = [i for i, t in enumerate(text) if t is not None]
            rows = [(doc[i], 0, None, None, None, None) for i, t in enumerate(text) if t is None]
            if some:
                keys = np.array([doc[i] or 0 for i in some], np.int64)
                rows += [(doc[some[i]], *x) for i, *x in encode_texts([text[i] for i in some], keys, v, samples)]
            columns = [list_array(c) if f.name == "ids" else pa.array(list(c), f.type) for c, f in zip(zip(*rows), out)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("exact", pa.bool_())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The texts of arrays of ids, row by row, however long: null of null, "" of an empty array and of control ids alone.

    Bytes that make up no character become the replacement character. The model file is read by the driver alone.
    """
    v = Vocabulary.load(model)

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else v.decode(r) for r in rows.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)

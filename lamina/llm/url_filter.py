"""URL filter: gradient-boosted trees on lexical features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut

#: Labelled URLs that the trees are fitted on, at most.
LABELLED = 20_000
TREES, DEPTH, RATE, CUTS, RIDGE, SHARE = 60, 3, 0.2, 32, 1.0, 0.3
SEED = 6
THRESHOLD = 0.5
#: Words of known bad hosts: the seed list that labels the table's URLs. The trees see no words of the URL.
SEEDS = ("spam", "adult", "porn", "xxx", "casino", "bets", "pills", "ads", "malware", "phish", "warez")
#: Suffixes of which the table is broadcast, at most; with more it is joined by shuffle.
NARROW = 100_000
LEXICAL = ("length", "host_length", "host_parts", "host_hyphens", "longest_part", "depth", "digits", "entropy", "host_entropy", "parameters", "query_length", "fragment", "secure", "extension")
SUFFIX = ("suffix_urls", "suffix_hosts")
#: What Python computes; the other features are Spark's.
ENTROPIES = ("entropy", "host_entropy")


def host_of(url: Column) -> Column:
    """The lower-case host, "" if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def suffix_of(host: Column) -> Column:
    """The last two parts of a host."""
    return F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column) -> dict[str, Column]:
    """The LEXICAL features of a URL but the ENTROPIES; of a null or empty one all zeros."""
    count = lambda text, mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    plain = F.substring_index(url, "#", 1)
    before = F.substring_index(plain, "?", 1)
    query = F.when(F.length(plain) > F.length(before), F.substring(plain, F.length(before) + 2, F.length(plain))).otherwise(F.lit(""))
    rest = F.when(F.instr(before, "://") > 0, F.substring(before, F.instr(before, "://") + F.lit(3), F.length(before))).otherwise(F.lit(""))
    path = F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/") + F.lit(1), F.length(rest))).otherwise(F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    found = {
        "length": F.length(url), "host_length": F.length(host), "host_parts": count(host, ".") + 1, "host_hyphens": count(host, "-"),
        "longest_part": F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))), "depth": F.size(parts),
        "digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.octet_length(url),
        "parameters": F.when(query != "", count(query, "&") + 1).otherwise(0), "query_length": F.length(query),
        "fragment": F.length(url) > F.length(plain) + 1, "secure": F.lower(F.substring(url, 1, 5)) == "https",
        "extension": F.coalesce(F.contains(F.try_element_at(parts, F.lit(-1)), F.lit(".")), F.lit(False)),
    }
    return {n: F.when(F.length(url) > 0, c.cast("double")).otherwise(0.0) for n, c in found.items()}


def entropies(texts: pa.Array) -> np.ndarray:
    """Bits a byte of each text, 0 of null and empty ones."""
    out = np.zeros(len(texts))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for at in range(0, len(texts), 4096):
        ends = offsets[at : at + 4097]
        sizes = np.diff(ends)
        n = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 256 + data[ends[0] : ends[-1]], minlength=len(sizes) * 256).reshape(-1, 256)
        share = n / np.maximum(sizes, 1)[:, None]
        out[at : at + 4096] = -(share * np.log2(np.where(n > 0, share, 1))).sum(axis=1)
    return out


@dataclass(frozen=True)
class Trees:
    """Complete trees of DEPTH: at each inner node x[feature] > cut goes right. start is the first log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            score += leaf[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(score, -60, 60)))


def boost(x: np.ndarray, y: np.ndarray, share: float = SHARE) -> Trees:
    """Histogram boosting of the logistic loss, both classes of equal weight. A class without examples: log-odds only.

    Each tree splits by a random `share` of the features, DEPTH at least, so that where several tell the classes apart all are used,
    not the first alone: sites that share only some of them are known too.
    """
    n, d = x.shape if len(x) else (0, 1)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    good, bad = float((y == 0).sum()), float((y == 1).sum())
    if not good or not bad:
        start = 0.0 if not n else -4.0 if good else 4.0
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    w = np.where(y == 1, n / (2 * bad), n / (2 * good))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for j in range(d)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    score, features, limits, values = np.zeros(n), [], [], []
    rng = np.random.default_rng(SEED)
    for _ in range(TREES):
        some = np.sort(rng.permutation(d)[: max(DEPTH, round(share * d))])
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            node = at - first
            best = np.full(width, 1e-9)
            for j in some:
                size = len(cuts[j]) + 1
                key = node * size + bins[:, j]
                sums = [np.bincount(key, weights=s, minlength=width * size).reshape(width, size).cumsum(axis=1) for s in (g, h)]
                (gl, hl), (gt, ht) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                if gain.shape[1]:
                    k = gain.argmax(axis=1)
                    better = gain[np.arange(width), k] > best
                    best[better] = gain[np.arange(width), k][better]
                    f[first : first + width][better] = j
                    c[first : first + width][better] = cuts[j][k][better]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > c[at])
        leaf = at - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + RIDGE)
        score += value[leaf]
        features.append(f), limits.append(c), values.append(value)
    return Trees(np.array(features), np.array(limits), np.array(values), 0.0)


def seed_labels(pages: DataFrame) -> DataFrame:
    """(url, label) of pages(url): 1 if a SEEDS word stands in the host, between dots, hyphens and digits; else 0."""
    known = pages.where(F.col("url").isNotNull() & (F.col("url") != "")).select("url")
    bad = host_of(F.col("url")).rlike(rf"(?:^|[-.0-9])(?:{'|'.join(SEEDS)})(?=[-.0-9]|$)")
    return known.select("url", bad.cast("int").alias("label"))


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, host, the LEXICAL columns but ENTROPIES and the SUFFIX ones: how many URLs and about how many hosts
    of all share its suffix (log). The table of suffixes is broadcast if it is small, so popular ones skew nothing."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"))
    by = rows.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.log1p(F.count("*")).alias("suffix_urls"), F.log1p(F.approx_count_distinct("host", 0.02)).alias("suffix_hosts"))
    by = cut(by)
    by = F.broadcast(by) if by.count() <= NARROW else by
    rows = rows.withColumn("suffix", suffix_of(F.col("host"))).join(by, "suffix").drop("suffix")
    return rows.select("page_id", "url", "host", *[c.alias(n) for n, c in lexical(F.col("url"), F.col("host")).items()], *SUFFIX)


def features(batch: pa.RecordBatch) -> np.ndarray:
    """Of rows with the columns of described(), LEXICAL and SUFFIX in this order."""
    column = lambda n: batch.column(batch.schema.get_field_index(n))
    found = {"entropy": entropies(column("url")), "host_entropy": entropies(column("host"))}
    return np.column_stack([found[n] if n in found else column(n).to_numpy(zero_copy_only=False) for n in (*LEXICAL, *SUFFIX)])


#: What features() reads.
INPUTS = ("host", *(n for n in LEXICAL if n not in ENTROPIES), *SUFFIX)


def fit(rows: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Trees:
    """Trees from at most `bound` distinct labelled URLs, chosen by hash; of several labels for one the greatest holds."""
    known = labels.where(F.col("url").isNotNull() & F.col("label").isNotNull()).groupBy("url").agg(F.max("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("url"), "url").limit(bound)
    marked = rows.join(known, "url").dropDuplicates(["url"]).select("url", "label", *INPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in features(b)], pa.binary())], ["url", "label", "x"])

    found = sorted(marked.mapInArrow(run, "url string, label int, x binary").collect())
    x = np.stack([np.frombuffer(r.x) for r in found]) if found else np.zeros((0, 1))
    return boost(x, np.array([r.label >= 1 for r in found], np.float64))


def judge(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """Each row of pages(page_id, url): page_id, url, bad (probability), keep. Trees are fitted on labels(url, label).

    Suffix statistics count all rows of pages. Null and empty URLs have all lexical features 0 and are judged by the
    trees like any other; they can't be labelled. Null ids and repeated rows are each judged, repeated URLs trained on
    once. Long URLs are read whole. Further columns are ignored. An empty table gives no rows; without labels every
    URL has probability 1/2, with labels of one class only near 0 or 1.
    """
    rows = described(pages)
    trees = pages.sparkSession.sparkContext.broadcast(fit(rows, labels, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = trees.value.probability(features(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array(p < threshold)], ["page_id", "url", "bad", "keep"])

    return rows.select("page_id", "url", *INPUTS).mapInArrow(run, "page_id long, url string, bad double, keep boolean")


def judge_table(pages: DataFrame) -> DataFrame:
    """judge() of a table of pages by its own seed labels."""
    return judge(pages, seed_labels(pages))

"""What several operators of this subpackage need: tables, lineage cuts, token hashing, bounded vector sums."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def temporary(prefix: str) -> str:
    """A new local folder that goes with this process; for local masters only."""
    path = tempfile.mkdtemp(prefix=prefix)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the cluster's shared folder (spark.checkpoint.dir).

    Only a local master without that setting, as in tests, gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or temporary("checkpoint-"))
    return df.checkpoint(eager=True)


def row_hash(*columns: Column | str) -> Column:
    """A 64-bit hash that is never null; null columns count as absent."""
    return F.xxhash64(*columns)


def label_sample(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label): one label for each labelled document, at most `bound` of them, chosen by hash of doc_id.

    Null ids and null labels are left out; of several labels for one document the least holds.
    """
    each = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    each = each.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose `column` holds about `most` bytes, or a single longer value."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if batch.num_rows > start:
            yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash multiplier and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            grown = []
            for base in (_MULTIPLIER, _INVERSE):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                grown.append(np.cumprod(x, dtype=np.uint64))
        _powers = (grown[0], grown[1])
    return _powers[0][:n], _powers[1][:n]


def byte_classes(*groups: str, lower: bool = True) -> np.ndarray:
    """256 classes: 0 separates, 1 is a letter, digit or any non-ASCII byte, 2 and on are the given groups."""
    classes = np.zeros(256, np.uint8)
    for c in range(128):
        if chr(c).isalnum():
            classes[c] = 1
    classes[128:] = 1
    for k, group in enumerate(groups, 2):
        for c in group:
            classes[ord(c)] = k
    return classes


def hash_tokens(texts: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each token: a longest run of bytes of one class other than 0. Null texts have no tokens.

    The hash is the polynomial hash of the token's bytes from prefix sums, so no token becomes a Python object.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0]) if len(texts) else 0
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    kind = classes[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[offsets - offsets[0]] = True
    edges = np.flatnonzero(edge)
    start, end = edges[:-1], edges[1:]
    token = kind[start] > 0
    start, end = start[token], end[token]
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * up, out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    rows = np.searchsorted(offsets - offsets[0], start, side="right") - 1
    return rows, hashes


def sum_vectors(partials: DataFrame, dtype: str, partial: str = "") -> dict[int, np.ndarray]:
    """Sums the binary vectors of partials(chunk int, data binary) by chunk, streaming, and collects the sums.

    partial is the type of the elements in partials if it isn't dtype.
    The number and size of chunks are fixed by the caller, so what reaches the driver does not grow with the input.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(data, partial or dtype).astype(dtype)
                if chunk in total:
                    total[chunk] += values
                else:
                    total[chunk] = values
        if total:
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array(list(total), pa.int32()), "data": pa.array([v.tobytes() for v in total.values()], pa.binary())}
            )

    summed = partials.repartition("chunk").mapInArrow(add, "chunk int, data binary")
    return {r.chunk: np.frombuffer(r.data, dtype).copy() for r in summed.collect()}


def chunked(values: np.ndarray, size: int) -> pa.RecordBatch:
    """values, flattened, as rows (chunk, data) of `size` elements, for sum_vectors; all-zero chunks are left out."""
    parts = values.reshape(-1, size)
    keep = np.flatnonzero(parts.any(axis=1))
    return pa.RecordBatch.from_pydict(
        {"chunk": pa.array(keep.astype(np.int32)), "data": pa.array([parts[i].tobytes() for i in keep], pa.binary())}
    )


def joined(chunks: dict[int, np.ndarray], count: int, size: int, dtype: str) -> np.ndarray:
    """The inverse of chunked(): chunks that are missing are zero."""
    out = np.zeros((count, size), dtype)
    for k, v in chunks.items():
        out[k] = v
    return out.reshape(-1)

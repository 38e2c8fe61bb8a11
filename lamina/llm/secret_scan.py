"""Secret scans that link the parts of a credential: access identifiers, secrets and endpoints near one another."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, fresh, slices

#: A scope is a secret and REACH characters on either side of it.
REACH = 200
BIN = 512

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"
_NAME = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth|credentials?)"
#: (type, kind, strong, what the text must hold for it, pattern). Of a pattern with a group, the group is the part.
#: Strong patterns can't well be anything else; weak ones count only with a complementary part in scope.
PATTERNS = [
    (name, kind, strong, needs, re.compile(pattern))
    for name, kind, strong, needs, pattern in (
        ("private_key", SECRET, True, "-----BEGIN", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"),
        ("cloud_key_id", IDENTIFIER, True, "A", r"(?<![A-Za-z0-9])A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
        ("forge_token", SECRET, True, "gh", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"),
        ("chat_token", SECRET, True, "xox", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
        ("payment_key", SECRET, True, "k_", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
        ("map_key", SECRET, True, "AIza", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}"),
        ("web_token", SECRET, True, "eyJ", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        ("assigned", SECRET, True, "=:", rf"(?i:(?<![a-z]){_NAME})[\"']?\s{{0,4}}(?::=|=>|[:=])\s{{0,4}}[\"']?([^\s\"',;&<>]{{8,}})"),
        ("long_run", SECRET, False, "", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])"),
        ("user", IDENTIFIER, False, "=:", r"(?i:(?<![a-z])(?:user(?:name|id)?|login|account|client[_-]?id))[\"']?\s{0,4}[:=]\s{0,4}[\"']?([^\s\"',;&<>]{2,})"),
        ("mail", IDENTIFIER, False, "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
        ("address", ENDPOINT, False, ".", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\w.]\d)"),
        ("url", ENDPOINT, False, "://", r"(?<![A-Za-z0-9])[a-z][a-z0-9+:-]{1,20}://[^\s\"'<>]{3,}"),
    )
]
#: Texts with neither hold no part.
HAS = re.compile(r"[0-9=:@]")
NEEDLES = ("-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "eyJ", "k_live_", "k_test_")


def entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def mixed(value: str) -> bool:
    """Whether a value has more than words have: digits, capitals after small letters, or marks that passwords have."""
    return any(c.isdigit() for c in value) or re.search(r"[^\W\d_][!@#$%^*_+=~|\\]+[^\W_]|[a-z][A-Z]", value) is not None


def candidates_in(text: str | None) -> list[tuple[str, str, bool, int, int, str]]:
    """(type, kind, strong, start, end, digest) of each part in a text, in characters; parts don't overlap.

    A pattern earlier in PATTERNS wins. Assigned values count as strong from 2.5 bits of entropy a character on if they
    are mixed() too, else as weak: prose after "secret:" is no secret by itself. An address is no assigned value unless
    it holds a user. Long runs count only from 3 bits on and with a digit.
    """
    if not text or not HAS.search(text) and not any(n in text for n in NEEDLES):
        return []
    found: list[tuple[str, str, bool, int, int, str]] = []
    taken: list[tuple[int, int]] = []
    for name, kind, strong, needs, pattern in PATTERNS:
        if needs and needs not in text and not (needs == "=:" and ("=" in text or ":" in text)):
            continue
        for m in pattern.finditer(text):
            value = m.group(m.re.groups)
            start, end = m.span(m.re.groups)
            sure = strong
            if name == "assigned":
                if "://" in value and "@" not in value:
                    continue
                sure = mixed(value) and entropy(value) >= 2.5
            if name == "long_run" and (entropy(value) < 3 or not any(c.isdigit() for c in value)):
                continue
            at = bisect_left(taken, (start, end))
            if at and taken[at - 1][1] > start or at < len(taken) and taken[at][0] < end:
                continue
            taken.insert(at, (start, end))
            found.append((name, kind, sure, start, end, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:16]))
    return found


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, type, kind, strong, start, end, digest): the parts in each distinct (doc_id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [
                (d, h, *c)
                for d, h, t in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for c in candidates_in(t)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

    out = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("type", pa.string()), ("kind", pa.string()), ("strong", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(scan, "doc_id long, h long, type string, kind string, strong boolean, start int, end int, digest string").distinct()


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """parts that are reported: parts and how many complementary parts are in scope (linked).

    Secrets are joined with the identifiers and endpoints of the same text that their scope, `reach` characters on
    either side, overlaps: by an equi-join on the text and the bins of BIN characters that both cover, and then the
    intervals themselves, each pair in the first bin of both. Strong parts are reported anyway, weak ones only if linked.
    """
    key = ["doc_id", "h", "start", "end"]
    low, high = F.col("start") - reach, F.col("end") + reach
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    scopes = parts.where(F.col("kind") == SECRET).select(*[F.col(c).alias(f"s_{c}") for c in key], low.alias("low"), high.alias("high"), bins(low, high).alias("s_bin"))
    others = parts.where(F.col("kind") != SECRET).select(*key, bins(F.col("start"), F.col("end")).alias("bin"))
    near = F.col("s_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("s_h") == F.col("h")) & (F.col("s_bin") == F.col("bin"))
    once = F.col("bin") == F.greatest(F.floor(F.col("low") / BIN), F.floor(F.col("start") / BIN))
    pairs = scopes.join(others, near & (F.col("start") <= F.col("high")) & (F.col("end") >= F.col("low")) & once)
    ends = F.explode(F.array(F.struct(*key), F.struct(*[F.col(f"s_{c}").alias(c) for c in key]))).alias("x")
    counts = pairs.select(ends).select("x.*").groupBy(*key).agg(F.count("*").alias("linked"))
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in key], "linked")
    same = F.col("c_doc_id").eqNullSafe(F.col("doc_id"))
    for c in key[1:]:
        same &= F.col(f"c_{c}") == F.col(c)
    joined = parts.join(counts, same, "left").withColumn("linked", F.coalesce("linked", F.lit(0)).cast("long"))
    return joined.where(F.col("strong") | (F.col("linked") > 0)).select(*parts.columns, "linked")


def findings(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """The reported parts in docs(doc_id, text): doc_id, type, kind, strong, start, end, linked, digest.

    start and end count characters of the whole text. The digest is the first half of the SHA-256 of the part, which
    is never given itself. Null and empty texts have no parts. Rows of null ids are scanned as one document for each
    text; rows repeated in doc_id and text are reported once. Further columns are ignored. An empty table: no rows.
    """
    return linked(cut(candidates(docs)), reach).drop("h")


def reported_in(text: str | None, reach: int = REACH) -> list[tuple[str, int, int]]:
    """(type, start, end) of what linked() reports in one text, by place: the same interval join by bisection.

    Parts don't overlap, so their starts and their ends are in the same order.
    """
    parts = sorted(candidates_in(text), key=lambda p: p[3])
    sides = {side: [p for p in parts if (p[1] == SECRET) == side] for side in (True, False)}
    ends = {side: ([p[3] for p in each], [p[4] for p in each]) for side, each in sides.items()}
    out = []
    for name, kind, strong, start, end, _ in parts:
        first, last = ends[kind != SECRET]
        if strong or bisect_right(first, end + reach) > bisect_left(last, start - reach):
            out.append((name, start, end))
    return out


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs, every row and column, with each reported part in text replaced by [type]; n_chars, if there, is renewed.

    What is reported in a text follows from that text alone, so it is scanned, linked (reported_in) and struck out in
    one pass, and no text is shuffled. Texts without reported parts, null and empty ones too, stay as they are. Repeated
    rows and rows of null ids are each redacted; long parts are struck out whole. Further columns keep their names and
    values. An empty table stays empty.
    """
    struck = fresh(docs, "struck")

    def strike(texts: pa.Array) -> pa.Array:
        """The new text, null where nothing is reported."""
        out = []
        for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t"):
            for text in batch.column(0).to_pylist():
                pieces, done = [], 0
                for name, start, end in reported_in(text, reach):
                    pieces += [text[done:start], f"[{name}]"]
                    done = end
                out.append("".join(pieces) + text[done:] if pieces else None)
        return pa.array(out, pa.string())

    rows = docs.withColumn(struck, F.arrow_udf(strike, "string")(F.col("text")))
    changed = {"text": F.coalesce(F.col(struck), F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length(F.col(struck)).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(length, F.col("n_chars"))
    return rows.withColumns(changed).select(*[F.col(f"`{c}`") for c in docs.columns])

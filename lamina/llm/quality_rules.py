"""Quality rules whose cutoffs are chosen so that few good documents are rejected, with proof from labelled holdouts."""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, fresh, hash_tokens, slices

RISK = 0.02
ERROR = 0.05
TAILS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016)
BINS = 1000
NONE = "(none)"
RULES = ("symbol", "upper", "digit", "repeat")


def among(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in chars]).astype(np.uint8)


SYMBOL, DIGIT, SOLID = among("#$%&*|!<>{}[]=~^\\_@+`"), among("0123456789"), 1 - among(" \t\n\r\f\v")
UPPER = among(string.ascii_uppercase)
LETTER = among(string.ascii_letters)


def shares(texts: pa.Array) -> dict[str, np.ndarray]:
    """Each rule's share of each text, 0 to BINS; texts without anything to count have 0.

    symbol and digit: of the bytes that are not white space; upper: capitals of the ASCII letters; repeat: of the
    words, those equal to the word before them.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ends = offsets - offsets[0]

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return sums[ends[1:]] - sums[ends[:-1]]

    def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (part * BINS // np.maximum(whole, 1)).astype(np.int32)

    solid = count(SOLID)
    words, hashes = hash_tokens(texts, SOLID)
    again = words[1:][(hashes[1:] == hashes[:-1]) & (words[1:] == words[:-1])]
    return {
        "symbol": share(count(SYMBOL), solid),
        "upper": share(count(UPPER), count(LETTER)),
        "digit": share(count(DIGIT), solid),
        "repeat": share(np.bincount(again, minlength=rows), np.bincount(words, minlength=rows)),
    }


def share_column(text: Column) -> Column:
    """A struct of shares()."""
    return F.arrow_udf(share_rows, ", ".join(f"{n} int" for n in RULES))(text)


def share_rows(texts: pa.Array) -> pa.Array:
    parts = [shares(b.column(0)) for b in slices(iter([pa.RecordBatch.from_arrays([texts], ["t"])]), "t")]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[n] for p in parts] or [np.zeros(0, np.int32)])) for n in RULES], list(RULES))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k), X binomial(n, p): the exact p-value against a rate of p or more, whatever the size of n.

    It is the regularised incomplete beta function I(1 - p; n - k, k + 1), by its continued fraction (modified Lentz)
    on the side where that converges.
    """
    if n <= 0 or k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = float(n - k), float(k + 1), 1 - p
    if x < (a + 1) / (a + b + 2):
        return min(1.0, beta_part(a, b, x, p))
    return max(0.0, 1 - beta_part(b, a, p, x))


def beta_part(a: float, b: float, x: float, y: float) -> float:
    """I(x; a, b), y = 1 - x, for x below about (a + 1) / (a + b + 2)."""
    front = peak(a, b, x, y) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h, m = d, 0
    while True:
        m += 1
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14 or m > 10_000_000:  # about sqrt(n) steps are needed
            return front * h


def stirling_rest(z: float) -> float:
    """log gamma(z) less (z - 1/2) log z - z + log(2 pi) / 2, for z of some size."""
    if z < 15:
        return math.lgamma(z) - (z - 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi)
    return 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)


def peak(a: float, b: float, x: float, y: float) -> float:
    """x^a y^b / B(a, b) without the cancellation of large logarithms."""
    n = a + b
    drift = lambda u: u - math.log1p(u)  # noqa: E731
    delta = x * b - y * a  # x n - a
    exponent = -a * drift(delta / a) - b * drift(-delta / b) + stirling_rest(n) - stirling_rest(a) - stirling_rest(b)
    return math.exp(exponent) * math.sqrt(a / n * b / (2 * math.pi))


def cutoffs_at(counts: dict[int, int], tails: tuple[float, ...] = TAILS) -> list[int]:
    """For each tail rate, the least bin with at most that share of the counts above it."""
    total, above, out = sum(counts.values()), 0, []
    falling = sorted(counts, reverse=True)
    for tail in tails:
        allowed, above, least = tail * total, 0, falling[0] if falling else BINS
        for b in falling:
            least = b
            if above + counts[b] > allowed:
                break
            above += counts[b]
        out.append(least)
    return out


def certified(tested: list[tuple[int, int]], good: int, strata: int, risk: float = RISK, error: float = ERROR) -> int:
    """The level to use, or -1: none is certified.

    tested: for each level the good and the bad holdout documents that it rejects. Levels are tested from the mildest
    on until one fails (fixed sequence), each at error / strata (Bonferroni): with probability 1 - error no certified
    level of any stratum rejects more than `risk` of its good documents. Of the certified levels the mildest counts
    that rejects 99 % of the bad documents that the strictest of them rejects.
    """
    passed = -1
    for level, (k, _) in enumerate(tested):
        if binomial_tail(k, good, risk) > error / max(1, strata):
            break
        passed = level
    if passed < 0:
        return -1
    return next(i for i in range(passed + 1) if tested[i][1] >= 0.99 * tested[passed][1])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, h, stratum, blank, a column for each rule); h is a hash of the text."""
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("lang"), F.lit(NONE)).alias("stratum"),
        (text.isNull() | ~text.rlike(r"\S")).alias("blank"),
        share_column(text).alias("shares"),
    )
    return rows.select("doc_id", "h", "stratum", "blank", "shares.*")


def choose(features: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, tails: tuple[float, ...] = TAILS) -> dict[str, dict[str, int]]:
    """{stratum: {rule: cutoff}} from all labelled documents; strata without a certified level are missing.

    A trial is a distinct labelled text of a stratum, so that copies aren't counted as independent; of its labels the
    least holds. Half of the texts, by the MD5 of their least doc_id, give each level's cutoffs: those rates of its good ones
    are above them, rule by rule. The other half tests the levels, all rules together. Both are counted by Spark over
    all labels; the driver gets counts by stratum, rule and bin only.
    """
    names = RULES
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    known = features.where(~F.col("blank")).join(marks, "doc_id")
    known = known.groupBy("stratum", "h").agg(F.min("quality").alias("quality"), F.min("doc_id").alias("least"), *[F.min(n).alias(n) for n in names])
    known = cut(known.withColumn("half", (F.substring(F.md5(F.col("least").cast("string")), 1, 1) >= "8").cast("int")))
    fit = known.where((F.col("half") == 0) & (F.col("quality") >= 1))
    bins = fit.select("stratum", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("bin")) for n in names])).alias("x"))
    counts: dict[tuple[str, str], dict[int, int]] = {}
    for r in bins.groupBy("stratum", "x.rule", "x.bin").count().collect():
        counts.setdefault((r["stratum"], r["rule"]), {})[r["bin"]] = r["count"]
    strata = sorted({s for s, _ in counts})
    ladders = {s: {n: cutoffs_at(counts[s, n], tails) for n in names} for s in strata}
    if not strata:
        return {}

    def level(s: str) -> Column:
        """The mildest level that rejects the row, len(tails) if none does."""
        return F.least(*[
            F.coalesce(*[F.when(F.col(n) > c, F.lit(i)) for i, c in enumerate(ladders[s][n])], F.lit(len(tails))) for n in names
        ])  # fmt: skip

    rejected = F.coalesce(*[F.when(F.col("stratum") == s, level(s)) for s in strata], F.lit(len(tails)))
    table: dict[tuple[str, bool], dict[int, int]] = {}
    held = known.where(F.col("half") == 1).groupBy("stratum", (F.col("quality") >= 1).alias("good"), rejected.alias("level")).count()
    for r in held.collect():
        table.setdefault((r["stratum"], r["good"]), {})[r["level"]] = r["count"]
    out = {}
    for s in strata:
        good, bad = table.get((s, True), {}), table.get((s, False), {})
        tested = [tuple(sum(n for k, n in side.items() if k <= i) for side in (good, bad)) for i in range(len(tails))]
        if (at := certified(tested, sum(good.values()), len(strata), risk, error)) >= 0:
            out[s] = {n: ladders[s][n][at] for n in names}
    return out


def broken(cutoffs: dict[str, dict[str, int]], stratum: Column, blank: Column, values: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks."""
    tests = [F.when(blank, F.lit("blank"))]
    for n, value in values.items():
        limits = [F.when(stratum == s, F.lit(c[n])) for s, c in cutoffs.items()]
        if limits:
            tests.append(F.when(value > F.coalesce(*limits, F.lit(BINS)), F.lit(n)))
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Each row of docs(doc_id, text, lang): doc_id, stratum, its share for each rule (thousandths), the rules that it
    breaks, separated by commas, and keep.

    A document goes if a rule's share is over the cutoff that choose() certified for its language. A language whose
    labels can't certify any cutoff keeps all its documents. Null or blank texts break the rule "blank" and go. Null
    languages are the stratum "(none)". Null ids are judged but can't be labelled; repeated rows are each judged, but
    count as one labelled text. Of several labels for one document the least holds. Further columns are ignored. An
    empty table gives no rows; empty labels certify nothing.
    """
    features = cut(measured(docs))
    cutoffs = choose(features, labels, **options)
    names = RULES
    lost = broken(cutoffs, F.col("stratum"), F.col("blank"), {n: F.col(n) for n in names})
    return features.withColumn("broken", F.array_join(lost, ",")).select("doc_id", "stratum", *names, "broken", (F.col("broken") == "").alias("keep"))


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever these are called.

    Null and blank texts go; null ids, null languages, ties and repeated rows are treated as in judge(). An empty table
    stays empty; empty labels let all but blank texts stay.
    """
    cutoffs = choose(cut(measured(docs)), labels, **options)
    name = fresh(docs, "shares")
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    lost = broken(cutoffs, F.coalesce(F.col("lang"), F.lit(NONE)), blank, {n: F.col(f"{name}.{n}") for n in RULES})
    return docs.withColumn(name, share_column(F.col("text"))).where(F.size(lost) == 0).drop(name)


def sql(risk: float = RISK, error: float = ERROR, tails: tuple[float, ...] = TAILS) -> str:
    """DuckDB SQL for judge() of the tables documents and labels."""
    kept = {"symbol": r"[^#$%&*|!<>{}\[\]=~^\\_@+`]", "digit": "[^0-9]", "upper": "[^A-Z]", "letter": "[^A-Za-z]", "blanks": r"[^ \t\n\r\f\v]"}
    counts = ", ".join(f"length(regexp_replace(t, '{pattern}', '', 'g')) AS n_{name}" for name, pattern in kept.items())
    values = ", ".join(f"('{n}', {n})" for n in RULES)
    ladder = ", ".join(f"({i}, {t}::DOUBLE)" for i, t in enumerate(tails))
    return rf"""
WITH texts AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, text, coalesce(text, '') AS t, coalesce(lang, '{NONE}') AS stratum FROM documents
), counted AS (
  SELECT *, {counts}, list_filter(regexp_split_to_array(t, '[ 	
]+'), lambda w: w <> '') AS words FROM texts
), features AS (
  SELECT doc_id, stratum, text, n_blanks = strlen(t) AS blank,
    CAST(n_symbol * {BINS} // greatest(strlen(t) - n_blanks, 1) AS INTEGER) AS symbol,
    CAST(n_upper * {BINS} // greatest(n_letter, 1) AS INTEGER) AS upper,
    CAST(n_digit * {BINS} // greatest(strlen(t) - n_blanks, 1) AS INTEGER) AS digit,
    CAST(len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) * {BINS} // greatest(len(words), 1) AS INTEGER) AS repeat
  FROM counted
), marks AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1
), known AS (
  SELECT stratum, min(quality) >= 1 AS good, md5(CAST(min(doc_id) AS VARCHAR))[1] >= '8' AS held, {", ".join(f"min({n}) AS {n}" for n in RULES)}
  FROM features JOIN marks USING (doc_id) WHERE NOT blank GROUP BY stratum, text
), fit AS (
  SELECT stratum, rule, bin FROM known, LATERAL (VALUES {values}) v(rule, bin) WHERE good AND NOT held
), bins AS (
  SELECT stratum, rule, bin, sum(count(*)) OVER (PARTITION BY stratum, rule) AS total,
    sum(count(*)) OVER (PARTITION BY stratum, rule ORDER BY bin DESC) - count(*) AS above
  FROM fit GROUP BY stratum, rule, bin
), cutoffs AS (
  SELECT stratum, rule, level, min(bin) AS cutoff FROM bins, (VALUES {ladder}) l(level, tail) WHERE above <= tail * total GROUP BY ALL
), levels AS (
  SELECT k.stratum, k.good, min(c.level) AS level
  FROM (SELECT row_number() OVER () AS id, * FROM known WHERE held) k, LATERAL (VALUES {values}) v(rule, bin)
  LEFT JOIN cutoffs c ON c.stratum = k.stratum AND c.rule = v.rule AND v.bin > c.cutoff GROUP BY k.id, k.stratum, k.good
), tested AS (
  SELECT s.stratum, l.level, count(*) FILTER (WHERE k.good) AS n, count(*) FILTER (WHERE k.good AND k.level <= l.level) AS lost,
    count(*) FILTER (WHERE NOT k.good AND k.level <= l.level) AS caught
  FROM (SELECT DISTINCT stratum FROM fit) s CROSS JOIN (VALUES {ladder}) l(level, tail) LEFT JOIN levels k ON k.stratum = s.stratum GROUP BY ALL
), bounds AS (
  SELECT *, coalesce((
    SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))) FROM range(0, lost + 1) r(i)
  ), 1) AS p FROM tested
), failed AS (
  SELECT stratum, min(level) FILTER (WHERE n = 0 OR p > {error} / greatest(1, (SELECT count(DISTINCT stratum) FROM fit))) AS first FROM bounds GROUP BY stratum
), passed AS (
  SELECT b.* FROM bounds b JOIN failed f ON b.stratum = f.stratum AND (f.first IS NULL OR b.level < f.first)
), chosen AS (
  SELECT stratum, min(level) AS level
  FROM (SELECT *, max(caught) OVER (PARTITION BY stratum) AS most FROM passed) WHERE caught >= 0.99 * most GROUP BY stratum
), limits AS (
  SELECT stratum, {", ".join(f"max(cutoff) FILTER (WHERE rule = '{n}') AS {n}" for n in RULES)} FROM cutoffs JOIN chosen USING (stratum, level) GROUP BY stratum
)
SELECT f.doc_id, f.stratum, {", ".join(f"f.{n}" for n in RULES)}, concat_ws(',', CASE WHEN f.blank THEN 'blank' END, {", ".join(f"CASE WHEN f.{n} > l.{n} THEN '{n}' END" for n in RULES)}) AS broken, broken = '' AS keep
FROM features f LEFT JOIN limits l ON l.stratum = f.stratum
"""

"""Preference pairs for training: one prompt from the longest common turn prefix, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (turn, role, text) in order of turn, then role and text."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = turns.where(F.col("conv_id").isNotNull())
    return known.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))


def pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected), arrays of (role, text), of a table of single conversations.

    Each conversation with an assistant turn is chosen, up to its last such turn. Rejected is the same with that turn's
    text replaced by the last assistant text of its neighbour, conv_id with the lowest bit flipped: a fluent reply
    to another conversation. If the neighbour has none, the rejected conversation ends before that turn.
    """
    said = F.filter("turns", lambda t: t["role"] == TRAINED)
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), TRAINED).cast("int") + 1
    each = conversations(turns).where(F.size(said) > 0).select("conv_id", F.slice(plain, 1, last).alias("chosen"))
    said = turns.where(F.col("conv_id").isNotNull() & (F.col("role") == TRAINED)).select(F.col("conv_id").cast("long").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("text", F.lit("")).alias("text"))
    reply = said.groupBy("conv_id").agg(F.max(F.struct("turn", "text"))["text"].alias("reply"))
    swapped = F.when(F.col("reply").isNotNull(), F.array(F.struct(F.lit(TRAINED).alias("role"), F.col("reply").alias("text")))).otherwise(F.slice("chosen", 1, 0))
    before = F.slice("chosen", 1, F.size("chosen") - 1)
    return each.join(reply, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), "chosen", F.concat(before, swapped).alias("rejected"))


def escaped(text: Column) -> Column:
    """Text without any mark of the format: "<|" becomes "<\\|" and "<\\" becomes "<\\\\", which can be undone."""
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<\\\\")), F.lit("<|"), F.lit("<\\|"))


def rendered(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))


def spans(turns: Column) -> Column:
    """[start, end) in characters of what is trained on in the rendered turns: assistant texts and their end marks."""
    def add(sofar: Column, t: Column) -> Column:
        start = sofar["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + 7
        found = F.when(t["role"] == TRAINED, F.concat(sofar["found"], F.array(F.array(start, end)))).otherwise(sofar["found"])
        return F.struct((end + 1).alias("at"), found.alias("found"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("found"))
    return F.aggregate(turns, nothing, add, lambda sofar: sofar["found"])


def format_pairs(compared: DataFrame) -> DataFrame:
    """A row for each of compared(pair_id, chosen, rejected): pair_id, prefix_turns, prompt, chosen, rejected and masks.

    chosen and rejected are arrays of (role, text). Their longest common turn prefix, turns equal in role and text, is
    rendered once as the prompt; what is left of each is its completion, which may be empty. A mask holds the
    [start, end) character spans of the completion that are trained on: texts of assistant turns with their end mark,
    not their role line, nor other turns. Everything stays in the JVM; there is no shuffle.

    Roles and texts are escaped() first, so that marks which they hold don't end a turn or begin another. A null
    conversation counts as empty, a null role or text as "". Equal conversations give two empty completions.
    Null ids, repeated rows and further columns: each row is formatted by itself. An empty table gives no rows.
    """

    def clean(c: str) -> Column:
        plain = F.transform(c, lambda t: F.struct(escaped(F.coalesce(t["role"], F.lit(""))).alias("role"), escaped(F.coalesce(t["text"], F.lit(""))).alias("text")))
        return F.coalesce(plain, F.slice(F.array(F.struct(F.lit("").alias("role"), F.lit("").alias("text"))), 1, 0)).alias(c)

    rows = compared.select("pair_id", clean("chosen"), clean("rejected"))
    least = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", 1, least), F.slice("rejected", 1, least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    first = F.array_position(same, False).cast("int")
    rows = rows.withColumn("prefix_turns", F.when(first > 0, first - 1).otherwise(least))
    rest = {c: F.slice(c, F.col("prefix_turns") + 1, F.greatest(F.size(c) - F.col("prefix_turns"), F.lit(0))) for c in ("chosen", "rejected")}
    rest["prompt"] = F.slice("chosen", 1, F.col("prefix_turns"))
    rows = rows.select("pair_id", "prefix_turns", *[x.alias(f"{c}_turns") for c, x in rest.items()])
    text = [F.array_join(rendered(F.col(f"{c}_turns")), "").alias(c) for c in ("prompt", "chosen", "rejected")]
    masks = [F.to_json(spans(F.col(f"{c}_turns"))).alias(f"{c}_mask") for c in ("chosen", "rejected")]
    return rows.select("pair_id", "prefix_turns", *text, *masks)


def format_table(turns: DataFrame) -> DataFrame:
    """format_pairs() of the pairs() of a table of conversations(conv_id, turn, role, text).

    Turns without conv_id belong to no conversation and are left out; repeated turns count once; null turn numbers
    come first. Conversations without an assistant turn have nothing to prefer and no row.
    """
    return format_pairs(pairs(turns))


#: DuckDB SQL for format_table() of the table conversations.
SQL = r"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM turns
), last AS (
  SELECT conv_id, max(n) AS n FROM numbered WHERE role = 'assistant' GROUP BY conv_id
), chosen AS (
  SELECT t.conv_id, t.n, t.role, t.text, t.n = l.n AS is_last FROM numbered t JOIN last l ON t.conv_id = l.conv_id AND t.n <= l.n
), swapped AS (
  SELECT c.conv_id, c.n, c.role, o.text FROM chosen c JOIN chosen o ON o.conv_id = xor(c.conv_id, 1) AND o.is_last WHERE c.is_last
), rejected AS (
  SELECT conv_id, n, role, text FROM chosen WHERE NOT is_last UNION ALL SELECT * FROM swapped
), prefix AS (
  SELECT c.conv_id, coalesce(min(c.n) FILTER (WHERE r.n IS NULL OR r.role <> c.role OR r.text <> c.text), max(c.n) + 1) - 1 AS k
  FROM chosen c LEFT JOIN rejected r ON c.conv_id = r.conv_id AND c.n = r.n GROUP BY c.conv_id
), lines AS (
  SELECT s.side, s.conv_id, s.n, s.role, '<|' || s.role || '|>' || chr(10) || s.text || '<|end|>' || chr(10) AS line, s.n <= p.k AS shared
  FROM (
    SELECT side, conv_id, n, replace(replace(role, '<\', '<\\'), '<|', '<\|') AS role, replace(replace(text, '<\', '<\\'), '<|', '<\|') AS text
    FROM (SELECT 'chosen' AS side, conv_id, n, role, text FROM chosen UNION ALL SELECT 'rejected', conv_id, n, role, text FROM rejected) b
  ) s
  JOIN prefix p ON s.conv_id = p.conv_id
), ends AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY side, conv_id, shared ORDER BY n) AS stop FROM lines
), texts AS (
  SELECT side, conv_id,
    coalesce(string_agg(line, '' ORDER BY n) FILTER (WHERE NOT shared), '') AS completion,
    coalesce(string_agg(line, '' ORDER BY n) FILTER (WHERE shared), '') AS prompt,
    '[' || coalesce(string_agg('[' || CAST(stop - length(line) + length(role) + 5 AS VARCHAR) || ',' || CAST(stop - 1 AS VARCHAR) || ']', ',' ORDER BY n)
      FILTER (WHERE NOT shared AND role = 'assistant'), '') || ']' AS mask
  FROM ends GROUP BY side, conv_id
)
SELECT p.conv_id AS pair_id, CAST(p.k AS INTEGER) AS prefix_turns, c.prompt, c.completion AS chosen, coalesce(r.completion, '') AS rejected,
  c.mask AS chosen_mask, coalesce(r.mask, '[]') AS rejected_mask
FROM prefix p JOIN texts c ON c.conv_id = p.conv_id AND c.side = 'chosen' LEFT JOIN texts r ON r.conv_id = p.conv_id AND r.side = 'rejected'
"""

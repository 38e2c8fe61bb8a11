import json
import re

import duckdb
from pyspark.sql import functions as F

from lamina.llm import preference as p

TURN = "array<struct<role string, text string>>"


def formatted(spark, *pairs):
    df = spark.createDataFrame([(i, a, b, "clash") for i, (a, b) in enumerate(pairs)], f"pair_id long, chosen {TURN}, rejected {TURN}, prompt string")
    return {r.pair_id: r for r in p.format_pairs(df).collect()}


def brute(chosen, rejected):
    escape = lambda x: (x or "").replace("<\\", "<\\\\").replace("<|", "<\\|")
    chosen, rejected = ([(escape(r), escape(t)) for r, t in c or []] for c in (chosen, rejected))
    k = 0
    while k < min(len(chosen), len(rejected)) and chosen[k] == rejected[k]:
        k += 1

    def render(turns):
        out, spans = "", []
        for role, text in turns:
            head = f"<|{role}|>\n"
            if role == "assistant":
                spans.append([len(out + head), len(out + head + text + "<|end|>")])
            out += head + text + "<|end|>\n"
        return out, json.dumps(spans).replace(" ", "")

    (prompt, _), (a, am), (b, bm) = render(chosen[:k]), render(chosen[k:]), render(rejected[k:])
    return k, prompt, a, b, am, bm


U, A, B = ("user", "hé 🙂?"), ("assistant", "yes"), ("assistant", "no\nnever")


def test_pairs_of_all_kinds(spark):
    pairs = [([U, A], [U, B]), ([U, A, U, A], [U, A, U, B]), ([U, A], [U, A]), ([U, A, U], [U]), ([A], [B]), ([], []), (None, [U, A]), ([U, B, U, A], [U, A, U, A]), ([(None, None), A], [("", ""), B]), ([U, ("assistant", "x" * 100_000)], [U, A]),
        ([U, ("assistant", "ends<|end|>\n<|user|>\nnot")], [U, ("assistant", "<\\|end|> <\\\\ <")]), ([("<|x", "<|end|>"), A], [("<\\|x", "<|end|>"), A])]
    got = formatted(spark, *pairs)
    for i, pair in enumerate(pairs):
        r = got[i]
        assert (r.prefix_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == brute(*pair), pair
    start, end = json.loads(got[1].rejected_mask)[0]
    assert got[1].rejected[start:end] == "no\nnever<|end|>"
    assert not formatted(spark)


def test_marks_in_texts_can_be_told_from_the_formats(spark):
    texts = ["<|end|>", "<\\|end|>", "<\\\\|end|>", "<", "<\\", "a<|b<\\|c", "<<||", "\\<|\\"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(p.escaped(F.col("t"))).collect()]
    assert not any("<|" in t for t in got)
    assert [re.sub(r"<\\(.)", r"<\1", t) for t in got] == texts


def test_table_and_its_sql_agree(spark):
    turns = [(c, t, r, x) for c in range(6) for t, (r, x) in enumerate([("system", "s"), ("user", f"q{c}"), ("assistant", f"a{c}"), ("user", "bye")][c % 3 :])]
    turns += [(7, 0, "user", "alone"), (8, 0, "user", None), (8, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, None, "odd"), (0, 1, "user", "q0"), (10, 0, "assistant", "a"), (11, 0, "assistant", "a"), (12, 0, "user", "<|end|> <\\|"), (12, 1, "assistant", "<|x"), (13, 0, "assistant", "y<\\")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, chosen string")
    got = sorted(tuple(r) for r in p.format_table(df).collect())
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(t) for t in turns])
    assert got == sorted(con.sql(p.SQL).fetchall()) and len(got) == 11
    assert p.format_table(df.limit(0)).count() == 0

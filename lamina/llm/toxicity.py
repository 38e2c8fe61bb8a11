"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import cut, fresh, label_sample
from lamina.llm.quality_rules import binomial_tail

#: Labelled documents from which the lexicon is learned, at most.
LABELLED = 20_000
THRESHOLD = 1.0
#: Weights within a clause: of an insult alone, after a person, at a person, of each other insult, of a threat alone and
#: at a person, and of what is negated or reported. Two clauses count together if they are WINDOW tokens apart or less.
LONE, NEAR, AT, MORE, BARE, AIMED, EXEMPT = 0.6, 0.8, 1.2, 0.6, 0.1, 1.2, 0.05
WINDOW = 200
#: A lone listed word is as good as a verdict if the labels show, at 95 %, that this is right in SURE of such documents.
SURE = 0.8

#: Learned words are in so much of a language's toxic documents, unless they explain the rest. Hashes that tell copies.
COMMON, SIGNS = 0.1, 4

INSULTS = (
    "idiot idiots moron morons loser losers scum trash clown clowns stupid pathetic worthless disgusting imbecile dumbass bastard asshole "
    "retard scumbag vermin idiota imbécil estúpido estúpida imbécile connard salope abruti arschloch dummkopf vollidiot abschaum"
).split()
THREATS = "kill murder destroy hurt stab shoot strangle burn töten umbringen tuer frapper matar golpear".split()
SECOND = "you your yours du dich dein ihr tu toi vous ton votre tú ti usted ustedes vosotros".split()
THIRD = "he she they them him her people everyone sie il elle ils elles él ella ellos ellas".split()
BEING = "is are am was were be been re 's 're bist ist sind seid war es est sont êtes eres son sois".split()
NEGATIONS = "not never no isn't aren't don't doesn't won't wasn't nicht kein keine niemals jamais pas nunca jamás".split()
REPORTS = "said says called calls wrote claimed claims alleged quoted reported sagte sagt nannte dit disait appelé dijo dice llamó".split()
THAT = "that dass daß que qu".split()
CLASSES = {"N": NEGATIONS, "R": REPORTS, "W": THAT, "C": BEING, "Z": THIRD, "Y": SECOND, "T": THREATS, "I": INSULTS}
MARKS = "\"“”«»„"

#: A word, a quotation mark, a comma, or what ends a clause or a paragraph.
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[\"“”«»„]|,|[.!?;]+|\n+")
STEMS = (4, 5, 6, 7)


@dataclass(frozen=True)
class Transducer:
    """A deterministic weighted transducer: arcs[state][symbol] = (next state, output symbol, weight), start state 0.

    A symbol without an arc keeps the state and is copied at no weight.
    """

    arcs: dict[int, dict[str, tuple[int, str, float]]] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get(state, {}).get(symbol, (state, symbol, 0.0))

    def outputs(self, alphabet: Iterable[str]) -> list[str]:
        """What it can write when it reads the alphabet."""
        return sorted({*alphabet} | {out for row in self.arcs.values() for _, out, _ in row.values()})

    def then(self, other: "Transducer", alphabet: Iterable[str]) -> "Transducer":
        """The composition: other reads what this one writes; weights add up. Only states that can be reached."""
        alphabet = list(alphabet)
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            a, b = pair = todo.pop()
            row = arcs[number[pair]] = {}
            for symbol in alphabet:
                next_a, middle, w = self.step(a, symbol)
                next_b, out, v = other.step(b, middle)
                if (next_a, next_b) not in number:
                    number[next_a, next_b] = len(number)
                    todo.append((next_a, next_b))
                row[symbol] = (number[next_a, next_b], out, w + v)
        return Transducer(arcs)

    def weights(self, symbols: Iterable[str]) -> list[float]:
        """The weight of each clause: what the arcs weigh up to each B or P and after the last."""
        state, total, out = 0, 0.0, []
        for s in symbols:
            state, _, w = self.step(state, s)
            total += w
            if s in "BP":
                out.append(total)
                total = 0.0
        return [*out, total]


#: Negation, reporting verb, that, copula, third and second person, threat, insult, quotation mark, comma, other word,
#: end of a clause, end of a paragraph.
ALPHABET = "NRWCZYTIQKOBP"


def negation(reach: int = 3) -> Transducer:
    """Writes i for an insult I, t for a threat T, within `reach` tokens after a negation N of the clause."""
    arcs: dict[int, dict[str, tuple[int, str, float]]] = {0: {"N": (reach, "N", 0.0)}}
    for left in range(1, reach + 1):
        arcs[left] = {s: (left - 1, s, 0.0) for s in "RWCZYQKO"}
        arcs[left] |= {"N": (reach, "N", 0.0), "I": (0, "i", 0.0), "T": (0, "t", 0.0), "B": (0, "B", 0.0), "P": (0, "P", 0.0)}
    return Transducer(arcs)


def reported(most: int = 8) -> Transducer:
    """Writes q for insults and threats that a speech verb reports.

    In quotation marks after the verb: up to the closing mark, the end of the paragraph, or `most` clauses on, whichever
    is first. Without them, after "that" or a person: to the end of the clause. What is quoted before its verb isn't seen.
    States: 1 saw a verb, 2 reports a clause, 3 and on quotes that many clauses.
    """
    quiet = {s: "q" for s in "ITit"}
    arcs = {
        0: {"R": (1, "R", 0.0)},
        1: {"Q": (3, "Q", 0.0), "B": (0, "B", 0.0), "P": (0, "P", 0.0)} | {s: (2, s, 0.0) for s in "WYZ"},
        2: {s: (2, o, 0.0) for s, o in quiet.items()} | {"Q": (3, "Q", 0.0), "B": (0, "B", 0.0), "P": (0, "P", 0.0)},
    }
    for k in range(3, 3 + most):
        arcs[k] = {s: (k, o, 0.0) for s, o in quiet.items()} | {"Q": (0, "Q", 0.0), "P": (0, "P", 0.0)}
        arcs[k]["B"] = (k + 1 if k + 1 < 3 + most else 0, "B", 0.0)
    return Transducer(arcs)


def target() -> Transducer:
    """Tells insults and threats at persons from others: writes d for an insult at a person, f for one somewhere after a
    person in the clause, a for one alone; k for the person that a threat is at, h for the threat itself.

    At a person: right after a second person or one word later, or up to three words after a person's "is". A threat is
    at a person named right after it or one word later. States: 0 none, 1 a person before, 2 and 3 just after a second
    person, 4 to 6 after a copula, 7 and 8 after a threat without a person before, 9 and 10 with one.
    """
    arcs: dict[int, dict[str, tuple[int, str, float]]] = {}
    for state in range(11):
        someone = state in (1, 2, 3, 4, 5, 6, 9, 10)
        row = {"B": (0, "B", 0.0), "P": (0, "P", 0.0), "Y": (2, "Y", 0.0), "Z": (1, "Z", 0.0), "T": (9 if someone else 7, "h", 0.0)}
        row["I"] = (1, "d", 0.0) if state in (2, 3, 4, 5, 6) else (1, "f", 0.0) if someone else (0, "a", 0.0)
        row["C"] = (4 if state in (1, 2, 3) else state, "C", 0.0)
        after = {2: 3, 3: 1, 4: 5, 5: 6, 6: 1, 7: 8, 8: 0, 9: 10, 10: 1}.get(state, state)
        row |= {s: (after, s, 0.0) for s in "ONRW"}
        row |= {s: (1 if someone else 0, s, 0.0) for s in "KQ"}
        if state >= 7:
            row |= {"Y": (2, "k", 0.0), "Z": (1, "k", 0.0)}
        arcs[state] = row
    return Transducer(arcs)


def weighing(lone: float = LONE) -> Transducer:
    """Weighs what target() wrote, each kind once in a clause and a second insult besides, so no clause grows without limit."""
    arcs: dict[int, dict[str, tuple[int, str, float]]] = {}
    first = {"a": lone, "f": max(NEAR, lone), "d": AT}
    for insults in range(3):
        for bare in range(2):
            for aimed in range(2):
                for exempt in range(2):
                    to = lambda i=insults, b=bare, a=aimed, e=exempt: ((i * 2 + b) * 2 + a) * 2 + e  # noqa: E731, B023
                    row = {s: (to(i=min(2, insults + 1)), s, (w, MORE, 0.0)[insults]) for s, w in first.items()}
                    row["h"] = (to(b=1), "h", 0.0 if bare else BARE)
                    row["k"] = (to(a=1), "k", 0.0 if aimed else AIMED)
                    row |= {s: (to(e=1), s, 0.0 if exempt else EXEMPT) for s in "itq"}
                    arcs[to()] = row | {"B": (0, "B", 0.0), "P": (0, "P", 0.0)}
    return Transducer(arcs)


@cache
def grammar(lone: float = LONE) -> Transducer:
    """The four transducers composed into one."""
    return negation().then(reported(), ALPHABET).then(target(), ALPHABET).then(weighing(lone), ALPHABET)


@dataclass(frozen=True)
class Lexicon:
    """Learned entries: whole words, and stems that begin words; the built-in classes besides; what a lone insult weighs."""

    words: frozenset[str] = frozenset()
    stems: frozenset[str] = frozenset()
    lone: float = LONE

    def pattern(self) -> str:
        """A Java regular expression that finds any insult or threat in lower-case text."""
        whole = "|".join(re.escape(w) for w in sorted({*INSULTS, *THREATS, *self.words}))
        found = rf"(?:{whole})(?![\p{{L}}\p{{N}}])"
        if self.stems:
            found = rf"(?:{found}|(?:{'|'.join(re.escape(s) for s in sorted(self.stems))}))"
        return rf"(?<![\p{{L}}\p{{N}}]){found}"

    def symbols(self) -> dict[str, str]:
        return {w: k for k, words in CLASSES.items() for w in words} | dict.fromkeys(self.words, "I")


def symbol(token: str, known: dict[str, str], stems: tuple[str, ...]) -> str:
    """A token's class. Of a word with apostrophes that isn't known its parts count, insults and threats first."""
    if (s := known.get(token)) is not None:
        return s
    if token[0] in MARKS or token[0] in ",.!?;\n":
        return "Q" if token[0] in MARKS else "K" if token == "," else "P" if token[0] == "\n" else "B"
    if stems and token.startswith(stems):
        return "I"
    if "'" in token:
        if token.endswith("n't"):
            return "N"
        found = [symbol(part, known, stems) for part in token.split("'")]
        return next((s for k in "ITNYZRWC" for s in found if s == k), "O")
    return "O"


def score_text(text: str | None, lexicon: Lexicon, known: dict[str, str] | None = None) -> tuple[float, int, str]:
    """(score, clauses with any weight, the heaviest such clause's symbols, runs of O as one) of a text; (0, 0, "") of null.

    The score is the weight of the heaviest clause, or of the two heaviest that begin WINDOW tokens apart or less.
    """
    known = lexicon.symbols() if known is None else known
    stems = tuple(lexicon.stems)
    symbols = [symbol(token, known, stems) for token in TOKEN.findall((text or "").lower().replace("’", "'"))]
    score, best, matched, start, recent = 0.0, None, 0, 0, []
    ends = [*(i for i, s in enumerate(symbols) if s in "BP"), len(symbols)]
    for end, w in zip(ends, grammar(lexicon.lone).weights(symbols)):
        if w > 0:
            recent = [(at, v) for at, v in recent if start - at <= WINDOW]
            score = max(score, w + max((v for _, v in recent), default=0.0))
            recent.append((start, w))
            matched += 1
            if best is None or w > best[0]:
                best = (w, start, end)
        start = end + 1
    pattern = re.sub("O+", "O", "".join(symbols[best[1] : best[2]])).strip("O") if best else ""
    return round(score, 4), matched, pattern


def begin_alike(a: str, b: str) -> bool:
    a, b = a.rstrip("$"), b.rstrip("$")
    return a.startswith(b) or b.startswith(a)


def cover(holding: dict[str, set[int]], least: float) -> list[str]:
    """Entries, each of which is in `least` documents or more that none before it is in; the most first, of equals the
    longest, then the first in the alphabet."""
    left, taken = {e: set(d) for e, d in holding.items()}, []
    while left:
        best = min(left, key=lambda e: (-len(left[e]), -len(e), e))
        new = left.pop(best)
        if len(new) < least:
            break
        taken.append(best)
        for docs in left.values():
            docs -= new
    return taken


def stem(n: int, word: Column) -> Column:
    return F.when(F.length(word) > n, F.substring(word, 1, n))


def chance(share: float, entries: int, error: float = 0.05) -> int:
    """In so many documents, all toxic, an entry must be, so that of `entries` without any meaning none is with
    probability 1 - error, where `share` of the documents are toxic."""
    share = min(max(share, 1e-6), 0.5)
    return max(5, math.ceil(math.log(error / max(1, entries)) / math.log(share)))


def learn(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Lexicon:
    """Words and stems that mark toxic documents, from at most `bound` labelled documents, and what a lone one weighs.

    Each text counts once for each of its words and of their stems of 4 to 7 letters. An entry is taken if at least
    99 % of its documents are toxic and, in some language, so many are as chance() asks for and 1 % of the language's
    toxic ones at least, near copies counting about once. Of these cover() takes those that explain a language's toxic
    documents, not the words that copies of one of them share besides; and all that are in COMMON of them, near copies
    counting about once, are taken, of those that begin with one another the commonest. Without a column `lang` all documents are of one language.

    A lone insult weighs THRESHOLD instead of LONE where the labels show that one is enough: binomially, at 95 %, more
    than SURE of the documents with just one are toxic.
    """
    marks = label_sample(labels, "toxic", bound)
    text = F.lower("text")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    known = docs.select(F.col("doc_id"), text.alias("text"), lang.alias("lang")).where(F.col("text").isNotNull()).join(F.broadcast(marks), "doc_id")
    known = cut(known.groupBy(F.xxhash64("text").alias("key")).agg(F.max("label").alias("label"), F.min("lang").alias("lang"), F.first("text").alias("text")))
    entries = known.select("key", (F.col("label") >= 1).alias("toxic"), "lang", F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+")).alias("words"))
    stems = [F.transform("words", partial(stem, n)) for n in STEMS]
    each = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(w, F.lit("$"))), *stems))
    #: Near copies mostly agree in the least hashes of their words, by which they count about once.
    signs = [f"sign{k}" for k in range(SIGNS)]
    least = [F.array_min(F.transform("words", lambda w, k=k: F.xxhash64(w, F.lit(k)))).alias(c) for k, c in enumerate(signs)]
    entries = entries.select("key", "toxic", "lang", each.alias("entries"), *least)
    apart = F.least(*[F.size(F.collect_set(F.when(F.col("toxic"), F.col(c)))) for c in signs])
    total = {r.lang: r for r in entries.groupBy("lang").agg(F.sum(F.col("toxic").cast("int")).alias("toxic"), F.count("*").alias("docs"), apart.alias("apart")).collect()}
    toxic, everything = sum(r.toxic for r in total.values()), sum(r.docs for r in total.values())
    if not toxic:
        return Lexicon()
    by = entries.select("toxic", "lang", *signs, F.explode("entries").alias("entry")).where(F.length("entry") > 3)
    by = by.groupBy("lang", "entry").agg(F.sum(F.col("toxic").cast("int")).alias("bad"), F.count("*").alias("docs"), apart.alias("apart"))
    by = by.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("docs").alias("docs"), F.collect_list(F.when(F.col("apart") >= 5, F.struct("lang", "apart"))).alias("in"))
    by = cut(by.where((F.col("docs") >= 5) & (F.col("bad") > 0)))
    enough = chance(toxic / everything, by.count())
    found = by.where((F.col("bad") >= 0.99 * F.col("docs")) & F.exists("in", lambda x: x["apart"] >= enough)).select("entry", "in")
    copies = {(x["lang"], r.entry): x["apart"] for r in found.collect() for x in r["in"]}
    where = entries.where("toxic").select("key", "lang", F.explode("entries").alias("entry")).join(F.broadcast(found.select("entry")), "entry")
    holding: dict[str, dict[str, set[int]]] = {}
    for r in where.collect():
        holding.setdefault(r.lang, {}).setdefault(r.entry, set()).add(r.key)
    taken: list[str] = []
    for name in sorted(holding):
        held, of = holding[name], total[name]
        taken += [e for e in cover(held, max(enough, 0.01 * of.toxic)) if e not in taken]
        for e in sorted(held, key=lambda e: (-len(held[e]), -len(e), e)):
            if copies.get((name, e), 0) >= max(enough, COMMON * of.apart) and not any(begin_alike(e, t) for t in taken):
                taken.append(e)
    lexicon = Lexicon(frozenset(t[:-1] for t in taken if t.endswith("$")), frozenset(t for t in taken if not t.endswith("$")))
    symbols = lexicon.symbols()

    def insults(texts: pa.Array) -> pa.Array:
        words, stems = symbols, tuple(lexicon.stems)
        found = ((symbol(x, words, stems) for x in TOKEN.findall((t or "").replace("’", "'"))) for t in texts.to_pylist())
        return pa.array([sum(s == "I" for s in f) for f in found], pa.int32())

    one = known.where(F.col("text").rlike(lexicon.pattern())).where(F.arrow_udf(insults, "int")("text") == 1)
    n, k = one.agg(F.count("*"), F.coalesce(F.sum((F.col("label") >= 1).cast("int")), F.lit(0))).first()
    enough_alone = binomial_tail(n - k, n, 1 - SURE) <= 0.05
    return Lexicon(lexicon.words, lexicon.stems, THRESHOLD if enough_alone else LONE)


def scored(text: Column, lexicon: Lexicon) -> Column:
    """A struct (score double, clauses int, pattern string). Python sees only texts with an insult or a threat."""
    known = lexicon.symbols()

    def score(texts: pa.Array) -> pa.Array:
        rows = [score_text(t, lexicon, known) for t in texts.to_pylist()]
        score, n, best = ([r[i] for r in rows] for i in range(3))
        return pa.StructArray.from_arrays(
            [pa.array(score, pa.float64()), pa.array(n, pa.int32()), pa.array(best, pa.string())], ["score", "clauses", "pattern"]
        )

    hit = F.when(F.lower(text).rlike(lexicon.pattern()), text)
    return F.arrow_udf(score, "score double, clauses int, pattern string")(hit)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """Each row of docs(doc_id, text): doc_id, score, clauses (how many match), pattern (the heaviest), toxic.

    The grammar composes transducers for negation, reported speech, targets and weights; a clause's score is the weight
    of its symbols' path, which has a limit, a document's that of its heaviest clause or of its two heaviest within
    WINDOW tokens, and it is toxic from `threshold` on: by an insult or a threat at a person, or by two insults, not by
    a lone word, unless the labels show that one is enough (see learn). The lexicon holds built-in words and what
    learn() finds in the labels. Texts without an insult or a threat have exactly 0. Null and empty texts have score 0;
    null ids and repeated rows are scored like any other; whole texts are read, however long. Ties between clauses go
    to the first. Further columns, but lang, are ignored. An empty table gives no rows; without labels the lexicon is
    the built-in one.
    """
    lexicon = learn(docs, labels, bound)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(F.col("text"), lexicon).alias("x")).select("doc_id", "x.*")
    return rows.withColumn("toxic", F.col("score") >= threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = LABELLED) -> DataFrame:
    """The rows of docs that classify() doesn't call toxic, with all their columns, whatever these are called.

    Null and empty texts, null ids and repeated rows stay as they are judged one by one. An empty table stays empty.
    """
    name = fresh(docs, "toxicity")
    rows = docs.withColumn(name, scored(F.col("text"), learn(docs, labels, bound)))
    return rows.where(F.col(name)["score"] < threshold).drop(name)

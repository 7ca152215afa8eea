"""Toxicity by a weighted finite-state grammar of clauses.

A lexical automaton, a trie of words and word beginnings, turns words into symbols: insult, threat, target,
negation, report, or end of a clause (a stop, an exclamation or question mark, a semicolon, or an end of line).
Five small transducers read the symbols: *targets* hold insults and threats back until a target comes in
their clause, before or after them, and weigh more then; *insults* without one weigh once; *threats* without one are none; *negations*
take weight off the next few words; *reports* off the rest of the clause.  They are composed into one table of
states before any text is read.  What is scored are matched clauses: a logistic regression, fitted by Newton
steps on sums over labelled rows, sees the sum of a document's clauses' weights, the heaviest
of them, and the text's length; an isotonic curve calibrates it.

A short list of words is fixed.  Insults of the corpus at hand, whole words and beginnings of words, are
learned from labelled rows: by the lower bound of the log odds of the different texts that have them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.calibration import FIT_ROWS, bounded, calibrated
from tessera.llm.cutting import cut

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)

#: Fixed words by symbol, in four languages; insults and threats with their weight.
WORDS = {
    INSULT: "idiot moron stupid trash pathetic worthless disgusting clown loser scum dumb imbecile crétin débile abruti connard ordure idiota imbécil estúpido basura inútil dummkopf abschaum versager trottel arschloch wertlos",
    THREAT: "kill murder hurt destroy burn die tuer brûler crever töten verbrennen sterben matar quemar morir",
    TARGET: "you your youre yourself he him she her they them tu vous toi il lui elle ils eux du dir dich ihr euch er ihn ihm sie ihnen tú ti usted ustedes vosotros él ella ellos",
    NEGATION: "not never no isnt arent dont wasnt pas jamais aucun nicht nie kein keine jamás nunca tampoco",
    REPORT: "said says called quoted wrote reported allegedly dit écrit appelé selon sagte schrieb nannte laut dijo escribió llamó según",
}
BASE_WEIGHT = 4.0
#: Beginnings of words that are learned have so many letters; longer ones are learned as whole words.
SHORTEST, LONGEST = 3, 8
#: Least lower bound of a learned entry's log odds, and the texts with label 1 that have it, at least.
LEAST_ODDS, LEAST_DOCS = 2.0, 4
#: Newton steps, the ridge, and how far raw scores go.
STEPS, RIDGE, TOP = 12, 1.0, 12.0

_NOTHING = (OTHER, 0.0)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")


class Effect(NamedTuple):
    """What a transition does: factors on its symbol's weight, put out at once or held back, and the shares of the held insults and threats
    that it lets go.  Machines that run together multiply the factors and add the shares."""

    now: float = 1.0
    held: float = 1.0
    insults: float = 0.0
    threats: float = 0.0


class Transducer:
    """States, the first of which starts, and for each (state, symbol) the next state and its Effect."""

    def __init__(self, states, step):
        self.states, self.step = list(states), step


def targets(aimed: float = 1.25) -> Transducer:
    """With a target before it in its clause an insult or a threat weighs `aimed` times at once; without, it is held back until a target comes."""

    def step(seen, symbol):
        if symbol == TARGET:
            return True, Effect(insults=aimed, threats=aimed)
        if symbol in (INSULT, THREAT):
            return seen, Effect(now=aimed, held=0.0) if seen else Effect(now=0.0)
        return seen and symbol != END, Effect()

    return Transducer((False, True), step)


def series(kind: int, alone: float, again: float = 0.5) -> Transducer:
    """Words of one kind: further ones of a clause weigh less, and what found no target weighs `alone` times at the clause's end."""

    def step(seen, symbol):
        if symbol == END:
            return False, Effect(**{"insults" if kind == INSULT else "threats": alone})
        if symbol == kind:
            return True, Effect(again, again) if seen else Effect()
        return seen, Effect()

    return Transducer((False, True), step)


def insults() -> Transducer:
    return series(INSULT, alone=1.0)


def threats() -> Transducer:
    """A threat without a target is none."""
    return series(THREAT, alone=0.0)


def negations(reach: int = 3, factor: float = 0.4) -> Transducer:
    """The `reach` words after a negation weigh less."""
    return Transducer(range(reach + 1), lambda left, symbol: (0 if symbol == END else reach if symbol == NEGATION else max(0, left - 1), Effect(factor, factor) if left else Effect()))


def reports(factor: float = 0.5) -> Transducer:
    """What follows a verb of reporting weighs less, up to the clause's end."""
    return Transducer((False, True), lambda on, symbol: (symbol != END and (on or symbol == REPORT), Effect(factor, factor) if on else Effect()))


def compose(*parts: Transducer) -> tuple[list[list[int]], list[list[Effect]]]:
    """Next states and effects, by state and symbol, of the machine that runs all parts at once; state 0 is each part's first one."""
    states = {x: k for k, x in enumerate(product(*(p.states for p in parts)))}
    nexts, effects = [], []
    for state in states:
        moves = [[p.step(s, symbol) for p, s in zip(parts, state, strict=True)] for symbol in range(7)]
        nexts.append([states[tuple(x[0] for x in m)] for m in moves])
        effects.append([Effect(math.prod(x[1].now for x in m), math.prod(x[1].held for x in m), sum(x[1].insults for x in m), sum(x[1].threats for x in m)) for m in moves])
    return nexts, effects


GRAMMAR = compose(targets(), insults(), threats(), negations(), reports())


class Lexicon(dict):
    """Word to (symbol, weight), or None for other words; remembers what it has looked up."""

    KEEP = 400_000

    def __init__(self, whole: dict[str, float], beginnings: dict[str, float]):
        super().__init__()
        self.fixed = {x: (k, BASE_WEIGHT) for k, words in WORDS.items() for x in words.split()} | {x: (END, 0.0) for x in ".!?;\n"}
        self.whole, self.beginnings = whole, beginnings

    def __missing__(self, word: str):
        found = self.fixed.get(word)
        weight = max([self.whole.get(word, 0.0), *(self.beginnings.get(word[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(word)) + 1))])
        if weight and (found is None or found[0] == INSULT and found[1] < weight):
            found = (INSULT, weight)
        if len(self) >= self.KEEP:
            self.clear()
        self[word] = found
        return found


def clause_weights(tokens: list[str], lexicon: Lexicon) -> list[float]:
    """Weights of the clauses of a text that match the grammar."""
    symbols = list(map(lexicon.__getitem__, tokens))
    if not any(x is not None and x[0] in (INSULT, THREAT) for x in symbols):
        return []
    nexts, effects = GRAMMAR
    out, state, total, held = [], 0, 0.0, {INSULT: 0.0, THREAT: 0.0}
    for symbol, weight in (*(x or _NOTHING for x in symbols), (END, 0.0)):
        effect = effects[state][symbol]
        if symbol in held:
            total += weight * effect.now
            held[symbol] += weight * effect.held
        elif symbol == TARGET or symbol == END:
            total += held[INSULT] * effect.insults + held[THREAT] * effect.threats
            held[INSULT] = held[THREAT] = 0.0
            if symbol == END:
                if total:
                    out.append(total)
                total = 0.0
        state = nexts[state][symbol]
    return out


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _counted(batches):
    """Of each batch the words, by how many of its documents with label 1 and 0 have them."""
    for batch in batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[label >= 0.5].update({x for x in tokens_of(text) if len(x) > 1})
        words = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[1][x] for x in words], pa.int64()), pa.array([found[0][x] for x in words], pa.int64())], ["word", "bad", "good"])


def different_texts(labelled: DataFrame) -> DataFrame:
    """(doc_id, label) of one document of each text and label, from (doc_id, text, label)."""
    return labelled.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))), "label").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "label").distinct()


def learned(labelled: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings of words with weights, from (text, label).

    Every entry that passes the test is learned.  The labelled rows are a bounded sample, and an entry needs `LEAST_DOCS`
    of its texts, which bounds what reaches the driver and the tasks.
    """
    totals = labelled.agg(F.coalesce(F.sum((F.col("label") >= 0.5).cast("long")), F.lit(0)), F.count("*")).first()
    bad, good = totals[0], totals[1] - totals[0]
    counts = cut(labelled.select("text", "label").mapInArrow(_counted, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    starts = counts.withColumn("n", F.explode(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)))).where(F.length("word") > F.col("n")).groupBy(F.expr("substring(word, 1, n)").alias("word")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    entries = counts.withColumn("whole", F.lit(True)).unionByName(starts.withColumn("whole", F.lit(False)))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    least = odds - 1.64 * F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = entries.where(F.col("bad") >= LEAST_DOCS).withColumn("least", least).where(F.col("least") >= LEAST_ODDS).collect()
    return {x["word"]: x["least"] for x in best if x["whole"]}, {x["word"]: x["least"] for x in best if not x["whole"]}


def _graded(whole: dict[str, float], beginnings: dict[str, float]):
    def run(batches):
        lexicon = Lexicon(whole, beginnings)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tokens = tokens_of(text)
                weights = clause_weights(tokens, lexicon)
                rows.append((math.log1p(sum(weights)), math.log1p(max(weights, default=0.0)), math.log1p(len(tokens)), len(weights)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.float64(),) * 3 + (pa.int64(),), strict=True))], ["doc_id", *INPUTS, "clauses"])

    return run


INPUTS = ("total", "heaviest", "length")


def _linear(weights: np.ndarray):
    return sum((F.lit(float(w)) * F.col(k) for k, w in zip(INPUTS, weights[1:], strict=True)), F.lit(float(weights[0])))


def fit_logistic(fitted: DataFrame) -> np.ndarray:
    """Intercept and weights of INPUTS by Newton steps; each is one sum over the rows of `fitted` (INPUTS, label)."""
    weights = np.zeros(len(INPUTS) + 1)
    columns = [F.lit(1.0), *map(F.col, INPUTS)]
    size = len(columns)
    for _ in range(STEPS):
        p = 1 / (1 + F.exp(-_linear(weights)))
        slope = [F.sum((F.col("label") - p) * x) for x in columns]
        bend = [F.sum(p * (1 - p) * columns[i] * columns[j]) for i in range(size) for j in range(i + 1)]
        sums = fitted.agg(*(x.alias(f"s{k}") for k, x in enumerate(slope + bend))).first()
        if sums[0] is None:
            return weights
        hessian = np.zeros((size, size))
        hessian[np.tril_indices(size)] = sums[size:]
        hessian += np.tril(hessian, -1).T
        step = np.linalg.solve(hessian + RIDGE * np.eye(size), np.array(sums[:size]) - RIDGE * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _curve(knots: np.ndarray, values: np.ndarray):
    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": np.interp(frame["raw"], knots, values), "clauses": frame["clauses"]})

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, score, clauses) for each row of `docs` (doc_id, text, ...): the probability of label 1, and the matched clauses.

    `labels` has (doc_id, label); rows with nulls are left out, and of more than about `fit_rows` labelled
    documents those with the smallest hashes of doc_id are taken.  Equal texts with one label are learned from
    once.  Null and empty texts match nothing.  Without any label the fixed words alone decide.  Rows may repeat and
    doc_id may be null; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null")
    known = cut(bounded(known, fit_rows))
    # At most about fit_rows rows of two numbers: small enough to send to all tasks, and no text moves.
    chosen = cut(different_texts(docs.join(F.broadcast(known), "doc_id")))
    graded = cut(docs.mapInArrow(_graded(*learned(docs.join(F.broadcast(chosen), "doc_id"))), "doc_id long, total double, heaviest double, length double, clauses long"))
    fitted = cut(graded.join(known, "doc_id").select(*INPUTS, "label"))
    weights = fit_logistic(fitted)
    knots, values = calibrated(fitted.select(_linear(weights).alias("raw"), "label"), -TOP, TOP)
    if len(knots) < 2:
        weights, knots, values = np.array([0.0, 1.0, 0.0, 0.0]), np.array([0.0, math.log1p(BASE_WEIGHT)]), np.array([0.05, 0.8])
    return graded.select("doc_id", _linear(weights).alias("raw"), "clauses").mapInPandas(_curve(knots, values), "doc_id long, score double, clauses long")

"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are mapped to classes (insult, threat, target, negation, reported speech, other).  Small deterministic transducers
for negation, reported speech, targets and threats are composed into one, which reads a clause's classes and says for each
insult or threat in which way it stands there.  What is scored are these matched clauses, never the bare word: an insult
that is denied or quoted has a weight of its own.

The insult lexicon (words and word beginnings) and the weights of the clause kinds are learned from labelled rows, of
which `per_class` of each label are used, picked by a hash of the id; the score is a probability.

Edge cases: null and empty texts get the score of a text without any match; a null id counts as empty text for the split;
labels that are null or neither 0 nor 1 are left out; with no usable label, or those of one kind only, the seeds and the prior weights
stand alone; repeated rows, and ties, are scored alike; other columns are never read: what score() adds gets underscores where
its name is taken; a clause without an end is as long as its text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, split_of_crc32, table, written

# Seed words by class, in four languages.
THREAT = "kill hurt destroy burn beat stab shoot strangle töten umbringen verprügeln erschießen tuer frapper brûler détruire matar golpear quemar destruir".split()
TARGET = "you your yours yourself u he him she her they them those dich dir euch ihr sie ihn deine tu toi te vous ton votre lui eux tú ti usted ustedes él ellos".split()
NEGATION = "not no never neither nor isn't aren't wasn't don't doesn't hardly nicht kein keine keinen nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTED = "said says say called calls wrote writes quoted quote claimed according reported sagte sagt nannte schrieb zitierte dit disait appelé écrit selon dijo dice llamó escribió según".split()
SEEDS = "idiot moron imbecile arschloch dummkopf connard imbécile idiota estúpido".split()

WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
END = re.compile(r"[.!?;\n]")
#: Tokens that a negation, a target and a threat reach.
REACH = 4
#: Clause kinds in the order of the features after the intercept and the largest insult weight.
KINDS = ("plain", "targeted", "negated", "reported", "threat")
#: Prior mean of the weights: intercept, largest insult weight, then KINDS.
PRIOR = np.array([-2.0, 1.0, 1.5, 0.5, -0.5, -0.5, 3.0])


@dataclass
class Transducer:
    """Deterministic: arcs[state][symbol] = (output, weight, next state); a symbol without an arc passes as it is."""

    arcs: list[dict[str, tuple[str, float, int]]]
    rest: list[int] = field(default_factory=list)

    def step(self, state: int, symbol: str) -> tuple[str, float, int]:
        return self.arcs[state].get(symbol) or (symbol, 0.0, self.rest[state])


def scope(opener: str, marked: dict[str, tuple[str, float]], reach: int | None) -> Transducer:
    """After an opener, symbols in `marked` are rewritten for `reach` tokens (None: to the clause's end)."""
    n = reach or 1
    arcs: list[dict] = [{opener: (opener, 0.0, n)}]
    rest = [0]
    for k in range(1, n + 1):
        after = k if reach is None else k - 1
        arcs.append({opener: (opener, 0.0, n)} | {a: (b, w, after) for a, (b, w) in marked.items()})
        rest.append(after)
    return Transducer(arcs, rest)


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """first, then second on its output; over the given input symbols."""
    width = len(second.arcs)
    arcs: list[dict] = []
    for a in range(len(first.arcs)):
        for b in range(width):
            row = {}
            for x in symbols:
                y, w1, a2 = first.step(a, x)
                z, w2, b2 = second.step(b, y)
                row[x] = (z, w1 + w2, a2 * width + b2)
            arcs.append(row)
    return Transducer(arcs, [0] * len(arcs))


#: Inputs: I insult, T threat, U target, N negation, R reported speech, O other.  Outputs besides: J targeted insult,
#: D denied insult, Q reported insult, K threat that has its target after it.
INPUT = "ITUNRO"


def grammar() -> Transducer:
    negation = scope("N", {"I": ("D", -1.0), "T": ("O", -1.0)}, REACH)
    reported = scope("R", {"I": ("Q", -1.0), "T": ("O", -1.0)}, None)
    target = scope("U", {"I": ("J", 0.5)}, REACH)
    threat = scope("T", {"U": ("K", 1.0)}, REACH)
    out = negation
    for nxt in (reported, threat, target):
        out = compose(out, nxt, INPUT)
    return out


GRAMMAR = grammar()
OUTPUT = {"I": 0, "J": 1, "D": 2, "Q": 3, "K": 4}


class Matcher:
    """Finds the clauses of a text in which the grammar accepts something."""

    def __init__(self, lexicon: dict[str, float]):
        """lexicon: weight of a word, or of a word beginning where the entry ends in '*'."""
        self.words = {w: x for w, x in lexicon.items() if w[-1] != "*"}
        self.starts = {w[:-1]: x for w, x in lexicon.items() if w[-1] == "*"}
        self.lengths = sorted({len(w) for w in self.starts})
        self.kinds = {w: c for c, ws in (("U", TARGET), ("N", NEGATION), ("R", REPORTED), ("T", THREAT)) for w in ws}
        self.search = ahocorasick.Automaton()
        for w in {*self.words, *self.starts, *THREAT}:
            self.search.add_word(w, len(w))
        self.search.make_automaton()

    def insult(self, word: str) -> float:
        """The weight of a word as an insult; 0 if it is none."""
        best = self.words.get(word, 0.0)
        for n in self.lengths:
            if n > len(word):
                break
            best = max(best, self.starts.get(word[:n], 0.0))
        return best

    def clauses(self, text: str) -> list[tuple[int, int, list[tuple[str, float]]]]:
        """(start, end, [(kind of match, weight)]) of each clause with a match; offsets in code points."""
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        out, done = [], 0
        for last, n in self.search.iter(low):
            first = last - n + 1
            if first < done or first and low[first - 1].isalpha():
                continue
            # no clause is read twice, whether it matches or not: a text takes time in proportion to its length
            start = max(done, *(low.rfind(c, done, first) + 1 for c in ".!?;\n"))
            done = m.start() if (m := END.search(low, last)) else len(low)
            if found := self.read(m[0] for m in WORDS.finditer(low, start, done)):
                out.append((start, done, found))
        return out

    def read(self, words: Iterable[str]) -> list[tuple[str, float]]:
        state, found = 0, []
        for w in words:
            x = self.insult(w)
            out, weight, state = GRAMMAR.arcs[state]["I" if x else self.kinds.get(w, "O")]
            if out in OUTPUT:
                found.append((out, x + weight if x else 2.0 + weight))
        return found

    def features(self, text: str) -> list[float]:
        counts, most = [0.0] * len(KINDS), 0.0
        for _, _, found in self.clauses(text):
            for kind, w in found:
                counts[OUTPUT[kind]] += 1
                most = max(most, w)
        return [1.0, most / 5, *(math.log1p(c) for c in counts)]


def entries(text: str) -> set[str]:
    """What of a text can enter the lexicon: words, and word beginnings of 3 to 6 letters."""
    words = {w for w in WORDS.findall(text.lower()) if len(w) < 40}
    return words | {w[:n] + "*" for w in words for n in (3, 4, 5, 6) if len(w) > n}


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def matcher(self) -> Matcher:
        return Matcher(self.lexicon)

    def score(self, features: list[list[float]]) -> np.ndarray:
        z = np.asarray(features, float).reshape(-1, len(PRIOR)) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def choose(rows: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """The lexicon: entries from (entry, toxic rows, other rows), without those that say no more than another one."""
    kept: dict[str, float] = {}
    support: dict[str, int] = {}
    scored = [(a, math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)), w) for w, a, b in rows]
    for a, x, w in sorted(scored, key=lambda r: (-r[0] * min(r[1], 4.0), -len(r[2]), r[2])):
        stem = w.rstrip("*")
        if any(stem[:n] + "*" in kept and kept[stem[:n] + "*"] >= x - 1 for n in range(3, len(stem) + 1)):
            continue
        if w[-1] == "*" and any(o.startswith(stem) and support[o] >= 0.95 * a for o in kept):
            continue
        kept[w], support[w] = x, a
    return kept


def regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression drawn to PRIOR, by Newton's method."""
    w, ridge = PRIOR.copy(), np.array([0.01, *[0.5] * (len(PRIOR) - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * (w - PRIOR)
        hess = (x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_entries: int = 4000, least_g: float = 24.0) -> Model:
    """Learn from labelled rows whose crc32(id) mod 3 is not 1: at most per_class of each label, a documented bound."""
    seeds = {w: 3.0 for w in SEEDS}
    known = labels.where(split_of_crc32(F.col("doc_id"), 3) != 1).where(F.col("toxic").isin(0, 1)).where("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(seeds, PRIOR)
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("id"), "toxic")  # at most 2 * per_class rows
    sample = written(docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("text", "toxic"), "toxic")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(seeds, PRIOR)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                found[y].update(entries(text or ""))
        keys = list({**found[0], **found[1]})
        for at in range(0, len(keys), 50_000):
            some = keys[at : at + 50_000]
            yield pa.record_batch({"entry": some, "a": [found[1][k] for k in some], "b": [found[0][k] for k in some]})

    counted = sample.mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = lambda o, e: F.when(F.col(o) > 0, F.col(o) * F.log(F.col(o) / ((F.col("a") + F.col("b")) * e))).otherwise(0.0)
    counted = counted.withColumn("g", 2 * (part("a", n1 / (n1 + n0)) + part("b", n0 / (n1 + n0))))
    ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    best = counted.where((F.col("g") >= least_g) & (ratio >= 2.0)).orderBy(F.desc("g"), "entry").limit(most_entries).collect()
    lexicon = seeds | choose([(r["entry"], r["a"], r["b"]) for r in best], n1, n0)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(lexicon)
        for batch in slices(batches):
            yield pa.record_batch({"x": pa.array([m.features(t or "") for t in batch["text"].to_pylist()], pa.list_(pa.float64())), "y": batch["toxic"].cast(pa.int32())})

    rows = sample.mapInArrow(featured, "x array<double>, y int").collect()  # at most 2 * per_class rows (per copy of an id)
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    weight = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    return Model(lexicon, regress(x, y, weight / weight.mean()))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """All columns of docs, and toxicity double, toxic_clauses array<struct<start, end, kinds>>, rejected boolean; a name
    that docs has already gets underscores.
    """
    names = ["toxicity", "rejected", "toxic_clauses"]
    for i, name in enumerate(names):
        while name.lower() in {c.lower() for c in docs.columns}:
            name += "_"
        names[i] = name
    kinds = "double", "boolean", "array<struct<start:int,end:int,kinds:string>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for batch in slices(batches):
            texts = [t or "" for t in batch["text"].to_pylist()]
            s = model.score([m.features(t) for t in texts])
            clauses = [m.clauses(t) if x >= threshold else [] for t, x in zip(texts, s, strict=True)]
            told = [[{"start": a, "end": b, "kinds": "".join(k for k, _ in f)} for a, b, f in c] for c in clauses]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= threshold), pa.array(told, kind)], names=[*batch.schema.names, *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*schema, *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))


def kept(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.matcher()
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score([m.features(t or "") for t in batch["text"].to_pylist()]) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (split_of_crc32(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("rejected").cast("int").alias("predicted"))

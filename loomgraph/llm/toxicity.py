"""Toxicity by noisy-channel deobfuscation.

Spans that look disguised (letters mixed with digits or signs that stand for letters, single letters with separators between
them, a letter three times and more) become lattices: each character may stand for itself, for the letters it resembles, or,
if it separates or repeats, for nothing. A Viterbi search under a character trigram model finds the likeliest reading; the
channel's costs are those of COSTS. The text, with its disguised spans restored, is then scored: marked words and word
beginnings, learned from labelled rows as those far more frequent in toxic than in other texts, are looked up, and a logistic
model over the strongest mark, the number of marks and of distinct ones gives the score.

The character model counts all texts, held-out ones too; it sees no labels. Marks and the logistic model are learned from a bounded sample of labelled rows that
are not held out, at most about ``sample`` whole texts, chosen by a hash of the doc_id.

Scale: the character model is 64 cubed counts whatever the corpus, aggregated by Spark; marks that reach the driver are
bounded by their least frequency in the sample; scoring is a map over the texts, one pass of an Aho-Corasick automaton.

Defined cases: a null or empty text has the score of a text without marks; without usable labels the score is the share of
toxic labels, 0 if there are none; very long texts are read whole, in time that grows with their length; several labels of a doc_id count as toxic if one is; repeated rows keep a row each; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomgraph.llm.common import lean, slices, to_python
from loomgraph.llm.lang_id import held_out, letters

THRESHOLD = 0.3
SAMPLE = 20_000
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
COSTS = {"swap": 1.0, "gap": 0.3, "repeat": 0.2, "sign": 8.0}
_L = r"[^\W\d_]"
_S = r"[0-9@$!|+€]"
MIXED = re.compile(rf"(?<!\w)(?:{_S}{{0,3}}{_L}+{_S}(?:{_L}|{_S})*|{_S}{{1,3}}{_L}(?:{_L}|{_S})*)")
SPACED = re.compile(rf"(?<!\w)(?:(?:{_L}|{_S})[ ._*\-]){{3,}}(?:{_L}|{_S})(?!\w)")
SIGN = re.compile(r"[0-9@$!|+€]")
ALPHABET = 64


def symbols(text: str) -> np.ndarray:
    """The characters of a lowered text as symbols: 0 for what is no letter, 1 to 26 for a to z, others by their code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % (ALPHABET - 27))
    return np.where(letters()[points], out, 0).astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ALPHABET**3, np.int64)
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            for at in range(0, len(text or ""), 1 << 20):
                s = symbols(text[max(0, at - 2) : at + (1 << 20)].lower())
                s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
                if len(s) > 2:
                    total += np.bincount((s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:], minlength=ALPHABET**3)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["gram", "n"])


def fit_characters(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after two others, over all texts."""
    rows = to_python(docs.select("text")).mapInArrow(lean(_count_trigrams), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ALPHABET**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    counts = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
    pairs, ones = counts.sum(0) + 0.5, counts.sum((0, 1)) + 0.5
    back = 0.9 * pairs / pairs.sum(1, keepdims=True) + 0.1 * ones / ones.sum()
    return np.log((counts + 5 * back[None]) / (counts.sum(2, keepdims=True) + 5)).astype(np.float32)


def restore(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a disguised span (lower case)."""
    states: dict[tuple, tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}  # the last two symbols and the last observed character
    for ch in span:
        choices: list[tuple[str, float]] = []
        if ch.isalpha():
            choices.append((ch, 0.0))
        elif ch in STANDS_FOR:
            choices += [(c, COSTS["swap"]) for c in STANDS_FOR[ch]] + [("", COSTS["sign"])]
        else:
            choices.append(("", COSTS["gap"]))
        after: dict[tuple, tuple[float, tuple]] = {}
        for (a, b, before), (cost, path) in states.items():
            options = choices + ([("", COSTS["repeat"])] if ch == before and ch.isalnum() else [])
            for c, price in options:
                if c:
                    k = _code(c)
                    key, to = (b, k, ch), (cost + price - float(model[a, b, k]), (path, c))
                else:
                    key, to = (a, b, ch), (cost + price, path)
                if key not in after or to[0] < after[key][0]:
                    after[key] = to
        states = after
    path, out = min(((cost - float(model[a, b, 0]), path) for (a, b, _), (cost, path) in states.items()), key=lambda x: x[0])[1], []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


@lru_cache(4096)
def _code(c: str) -> int:
    return int(symbols(c)[0])


class Restorer:
    """Finds disguised spans of lowered texts and restores them; remembers readings."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, lru_cache(20_000)(lambda span: restore(span, model))

    def read(self, span: str) -> str:
        return self.known(span) if len(span) <= 100 else restore(span, self.model)

    def readings(self, low: str) -> list[str]:
        spans = [m[0] for m in SPACED.finditer(low)]
        if SIGN.search(low):
            spans += [m[0].rstrip("!+|") or m[0] for m in MIXED.finditer(low)]
        if REPEATED_HINT.search(low):
            spans += [w for w in WORDS.findall(low) if REPEATED_HINT.search(w)]
        return [self.read(s) for s in spans]


REPEATED_HINT = re.compile(rf"({_L})\1\1")
WORDS = re.compile(rf"{_L}+")
PREFIXES = (4, 5, 6, 7)


def features(low: str, readings: list[str]) -> set[str]:
    """Words (with $ at their ends) and word beginnings of a text and its readings."""
    words = set(WORDS.findall(low)).union(*map(WORDS.findall, readings)) if readings else set(WORDS.findall(low))
    return {w + "$" for w in words} | {w[:n] for w in words for n in PREFIXES if len(w) >= n}


class Scorer:
    """Marks with their log odds, found by one automaton, and the logistic model over them."""

    def __init__(self, marks: dict[str, float], model: np.ndarray, prior: float):
        self.marks, self.model, self.prior = marks, model, prior
        self.weights = np.zeros(4)
        self.ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "restorer")} | {"ready": False}

    def prepare(self) -> None:
        if not self.ready:
            self.restorer = Restorer(self.model)
            self.automaton = ahocorasick.Automaton()
            for m, w in self.marks.items():
                self.automaton.add_word(m.removesuffix("$"), [])
            for m, w in self.marks.items():
                self.automaton.get(m.removesuffix("$")).append((m, w))
            if self.marks:
                self.automaton.make_automaton()
            self.ready = True

    def found(self, low: str) -> tuple[dict[str, float], set[int]]:
        """Marks that stand in a lowered text at a word's beginning (whole words up to its end), and where."""
        marks, places = {}, set()
        if self.marks:
            for end, here in self.automaton.iter(low):
                for m, w in here:
                    whole = m.endswith("$")
                    start = end + 1 - len(m) + whole
                    if (start == 0 or not low[start - 1].isalpha()) and not (whole and end + 1 < len(low) and low[end + 1].isalpha()):
                        marks[m] = w
                        places.add(start)
        return marks, places

    def evidence(self, text: str | None) -> np.ndarray:
        self.prepare()
        low = (text or "").lower()
        marks, places = self.found(low)
        n = len(places)
        for reading in self.restorer.readings(low):
            more, where = self.found(reading)
            marks |= more
            n += len(where)
        distinct = len({m[:4] for m in marks})
        return np.array([1.0, max(marks.values(), default=0.0), math.log1p(n), math.log1p(distinct)])

    def score(self, text: str | None) -> float:
        if not self.weights.any():
            return self.prior
        return float(1 / (1 + math.exp(-float(np.clip(self.evidence(text) @ self.weights, -30, 30)))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 4, evidence: float = 35.0) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, toxic), from rows that are not held out.

    A mark stands in at least ``least`` toxic texts of the sample, with a log-likelihood ratio of at least ``evidence``.
    """
    model = fit_characters(docs)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    some = known.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < min(1.0, sample / max(n, 1)) * (1 << 30))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("y"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, held, totals = Restorer(shared.value), {}, [0, 0]

        def out() -> pa.RecordBatch:
            both = np.array([totals[0] + (totals[1] << 32), *held.values()], np.int64)  # toxic texts in the upper half
            return pa.RecordBatch.from_arrays([pa.array(["", *held], pa.string()), pa.array(both & 0xFFFFFFFF), pa.array(both >> 32)], ["f", "clean", "toxic"])

        for batch in slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                low = (text or "").lower()
                totals[y] += 1
                for f in features(low, restorer.readings(low)):
                    held[f] = held.get(f, 0) + (1 << 32 if y else 1)
                if len(held) > 150_000:
                    yield out()
                    held, totals = {}, [0, 0]
        yield out()

    counts = to_python(rows).mapInArrow(lean(count), "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    frame = counts.filter(f"f = '' or (toxic >= {least} and toxic * 1.0 > clean)").toPandas().set_index("f")
    clean, toxic = (int(frame.loc["", c]) if "" in frame.index else 0 for c in ("clean", "toxic"))
    prior = toxic / (clean + toxic) if clean + toxic else 0.0
    if not toxic or not clean:
        return Scorer({}, model, prior)
    frame = frame.drop(index="")
    t, c = frame["toxic"].to_numpy(float), frame["clean"].to_numpy(float)
    ratio = 2 * (t * np.log(t / ((t + c) * prior)) + np.where(c > 0, c * np.log(np.maximum(c, 1e-9) / ((t + c) * (1 - prior))), 0))
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    good = ratio >= evidence
    scorer = Scorer(dict(zip(frame.index[good], odds[good].tolist(), strict=True)), model, prior)
    x, y = _evidence(rows, scorer)
    scorer.weights = _logistic(x, y)
    return scorer


def _evidence(rows: DataFrame, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f in found], pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    table = rows.mapInArrow(lean(run), "x array<double>, y int").groupBy("x", "y").count().toPandas()
    reps = table["count"].to_numpy()
    return np.repeat(np.stack(table["x"].to_list()), reps, 0), np.repeat(table["y"].to_numpy(float), reps)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with the column score: 0 to 1, higher when the text is likelier to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = pa.array([shared.value.score(t) for t in batch.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "score"])

    docs = to_python(docs.drop("score"))
    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score at least threshold."""
    return scored(docs, fit(docs, labels)).filter(F.col("score") < threshold).drop("score")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

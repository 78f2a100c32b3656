"""Toxicity (operator 8): a weighted lexicon, matched by an Aho-Corasick automaton.

Method: texts are folded first: lower-cased, look-alike letters of other alphabets and digits or signs that stand for letters become one
letter each (i, l, 1, | and ! are one). The lexicon's terms are words, and beginnings of words, each with a weight. A term counts
where a word begins (and ends, for whole words), and not within an exception phrase. The density is the sum of weights by the
number of words; density / (density + scale) is the score.

The lexicon is learned from a bounded sample of labelled rows: the terms whose share of a text parts toxic rows from others most
surely get the weights of a logistic regression without negative weights. The density that parts the sample best gets the score 0.3.

Defined cases: a null or empty text has score 0; so has every text if there is nothing to learn from; rows that repeat get the
same result; of several labels of a doc_id the toxic one counts, of several texts of a doc_id the least one may train; only ``doc_id`` and ``text`` (and ``doc_id``, ``toxic`` of the labels)
are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, with_fields
from .sampling import chosen_ids, one_row_each

#: The sample: at most so many rows of either label, of at most so many characters.
ROWS_PER_LABEL, SAMPLE_CHARS = 4_096, 32_768
#: Terms: beginnings of these lengths; toxic rows that hold one at least, by how much it is more frequent there at least, t statistic at least; how many at most.
BEGINNINGS = (4, 5, 6, 7, 8)
MIN_ROWS, MIN_RATIO, MIN_T, MAX_TERMS = 4, 1.5, 3.0, 400
#: A term's share of a text counts up to this when terms are chosen: else a few short texts would decide.
MAX_SHARE = 0.02
FIT_STEPS, PENALTY = 1500, 5e-5
CUT_SCORE = 0.3
#: Least hashes by which rows of the sample that resemble each other are told.
HASHES = 4
#: Stands after the beginning of a word; no word holds it.
_ON = "*"

#: What is written for a letter, and the letter; each text character folds to one character.
LOOKALIKES = {
    "a": "@4аαàáâãäå", "b": "8вβ", "c": "сçϲ", "d": "ԁ", "e": "3еεèéêëё", "g": "9ɡ", "h": "һн", "i": "1!|lіιìíîïӏ", "j": "ј",
    "k": "кκ", "m": "мμ", "n": "пñηո", "o": "0оοòóôõöø", "p": "рρ", "q": "ԛ", "r": "гř", "s": "5$ѕßš", "t": "7тτ", "u": "υùúûüս",
    "v": "ѵν", "w": "ԝωш", "x": "хχ×", "y": "уγýÿ", "z": "2žз",
}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash pickup", "clown fish", "circus clown", "pond scum", "stupid simple", "worthless stock", "worthless shares")

_FOLD = {ord(x): letter for letter, like in LOOKALIKES.items() for x in like} | {c + 0xFEE0: chr(c) for c in range(ord("a"), ord("z") + 1)}
_FOLD = {c: "i" if x == "l" else x for c, x in _FOLD.items()}


def fold(text: str) -> str:
    lowered = text.lower()
    return (lowered if len(lowered) == len(text) else "".join(x.lower()[:1] for x in text)).translate(_FOLD)


class Lexicon(NamedTuple):
    """words and beginnings (both folded) with their weights; exceptions; and the scale of the score."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: Sequence[str]
    scale: float


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        terms: dict[str, tuple[float, float]] = {}
        for k, table in enumerate((lexicon.words, lexicon.beginnings)):
            for term, weight in table.items():
                old = terms.get(term, (0.0, 0.0))
                terms[term] = (weight, old[1]) if k == 0 else (old[0], weight)
        self.automaton = ahocorasick.Automaton()
        for term, weights in terms.items():
            self.automaton.add_word(term, (len(term), *weights))
        self.exceptions = ahocorasick.Automaton()
        for phrase in {fold(x) for x in lexicon.exceptions if x}:
            self.exceptions.add_word(phrase, len(phrase))
        for automaton in (self.automaton, self.exceptions):
            if len(automaton):
                automaton.make_automaton()

    def weight(self, text: str) -> float:
        """Sum of the weights of a text's toxic words."""
        if not len(self.automaton):
            return 0.0
        folded = fold(text)
        found: dict[int, float] = {}
        for last, (length, word, beginning) in self.automaton.iter(folded):
            first = last - length + 1
            if first and folded[first - 1].isalpha():
                continue
            ends = last + 1 == len(folded) or not folded[last + 1].isalpha()
            found[first] = found.get(first, 0.0) + beginning + (word if ends else 0.0)
        if found and len(self.exceptions):
            spans = [(last - length + 1, last) for last, length in self.exceptions.iter(folded)]
            found = {at: w for at, w in found.items() if not any(a <= at <= b for a, b in spans)}
        return sum(found.values())

    def density(self, text: str) -> float:
        weight = self.weight(text)
        return weight / len(text.split()) if weight else 0.0


def _densities(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and density of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        density = Matcher(lexicon).density
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch([part.column("doc_id"), pa.array([density(x) if x else 0.0 for x in part.column("text").to_pylist()], pa.float64())], names=["doc_id", "density"])

    docs = docs.select("doc_id", "text")
    return map_arrow(docs, run, with_fields(docs.select("doc_id"), "density double"))


def _shares(sample: DataFrame) -> DataFrame:
    """sample with weight: rows that resemble each other share one row's weight, as copies of a text are no further evidence.

    The resemblance of two rows is the chance that their least shingle hashes agree; a row's weight is one by the mean number of rows that have its own.
    """
    words = F.split("text", r"\s+")
    hashes = lambda seed: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.lit(seed), F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    marked = sample.withColumn("w", words).select("doc_id", "text", *(hashes(k).alias(f"h{k}") for k in range(HASHES)))
    alike = sum((F.count(F.lit(1)).over(Window.partitionBy(f"h{k}")) for k in range(HASHES)), F.lit(0))
    return marked.select("doc_id", "text", (HASHES / alike).alias("weight"))


def terms_of(text: str) -> Counter[str]:
    """How often each term is in a text: its words, and their beginnings with a mark after them."""
    words = Counter("".join(x if x.isalpha() else " " for x in fold(text)).split())
    found = Counter(words)
    for word, n in words.items():
        for length in BEGINNINGS:
            if len(word) >= length:
                found[word[:length] + _ON] += n
    return found


def _candidates(sample: DataFrame, toxic: list) -> list[str]:
    """The terms whose share of a text's words parts toxic rows from the others most surely (by the t statistic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad = frozenset(toxic)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                terms, shares, weights, labels = [], [], [], []
                for doc_id, text, weight in zip(*(part.column(k).to_pylist() for k in ("doc_id", "text", "weight"))):
                    n = max(1, len(text.split()))
                    found = terms_of(text)
                    terms += found
                    shares += [min(x / n, MAX_SHARE) for x in found.values()]
                    weights += [weight] * len(found)
                    labels += [doc_id in bad] * len(found)
                yield pa.record_batch([pa.array(terms, pa.string()), pa.array(shares, pa.float64()), pa.array(weights, pa.float64()), pa.array(labels, pa.bool_())], names=["term", "x", "w", "toxic"])

    totals = sample.agg(F.sum(F.when(F.col("doc_id").isin(toxic), F.col("weight"))).alias("bad"), F.sum("weight").alias("all")).first()
    n_bad, n_good = totals["bad"], totals["all"] - totals["bad"]
    x, w, is_bad = F.col("x"), F.col("w"), F.col("toxic")
    part = lambda value, which: F.sum(F.when(which, value).otherwise(0.0))
    sums = map_arrow(sample, run, "term string, x double, w double, toxic boolean").groupBy("term").agg(
        part(w, is_bad).alias("rows"), (part(w * x, is_bad) / n_bad).alias("bad"), (part(w * x * x, is_bad) / n_bad).alias("bad2"), (part(w * x, ~is_bad) / n_good).alias("good"), (part(w * x * x, ~is_bad) / n_good).alias("good2")
    )
    t = (F.col("bad") - F.col("good")) / F.sqrt((F.col("bad2") - F.col("bad") ** 2) / n_bad + (F.col("good2") - F.col("good") ** 2) / n_good + 1e-12)
    sure = sums.filter((F.col("rows") >= MIN_ROWS) & (F.col("bad") >= MIN_RATIO * F.col("good"))).withColumn("t", t).filter(F.col("t") >= MIN_T)
    return [x["term"] for x in sure.orderBy(F.desc("t"), "term").limit(MAX_TERMS).collect()]


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights, none negative, of a logistic regression of y on the columns of x; both labels count the same in all."""
    balance = weight * np.where(y, 0.5 / max(weight[y].sum(), 1e-9), 0.5 / max(weight[~y].sum(), 1e-9))
    w, bias, m, v = np.full(x.shape[1], 0.1), -1.0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, FIT_STEPS + 1):
        wrong = balance * (1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y)
        slope = np.append(x.T @ wrong + PENALTY, wrong.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = np.maximum(w - move[:-1], 0), bias - move[-1]
    return w


def _scale(densities: list[tuple[float, bool]]) -> float:
    """The scale at which the density that parts toxic from other rows best (by F1; the middle of equally good ones) has CUT_SCORE."""
    rows = sorted(densities)
    positives = sum(toxic for _, toxic in rows)
    best, cuts, missed = -1.0, [], 0
    for i, (density, toxic) in enumerate(rows):
        if i and density > rows[i - 1][0]:
            caught = positives - missed
            f1 = 2 * caught / max(1, len(rows) - i + positives)
            if f1 > best:
                best, cuts = f1, []
            if f1 == best:
                cuts.append((rows[i - 1][0] + density) / 2)
        missed += toxic
    middle = cuts[len(cuts) // 2] if cuts else 1.0
    return middle * (1 - CUT_SCORE) / CUT_SCORE


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = ROWS_PER_LABEL, sample_chars: int = SAMPLE_CHARS, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """The lexicon of a bounded sample of the labelled rows that are not held out."""
    chosen = dict(chosen_ids(labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "toxic", rows_per_label))
    fit_for = docs.select("doc_id", "text").filter(F.length("text") <= sample_chars)
    sample = cut(one_row_each(fit_for, list(chosen)).select("doc_id", "least.text").repartition("doc_id")) if chosen else cut(fit_for.limit(0))
    present = {x["doc_id"] for x in sample.select("doc_id").collect()}
    toxic = [i for i in present if chosen[i] == 1]
    if not toxic or len(toxic) == len(present):
        return Lexicon({}, {}, tuple(exceptions), 1.0)
    sample = cut(_shares(sample))
    terms = _candidates(sample, toxic)
    place, bad = {t: i for i, t in enumerate(terms)}, frozenset(toxic)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [[(place[t], n / max(1, len(x.split()))) for t, n in terms_of(x).items() if t in place] for x in part.column("text").to_pylist()]
                columns = [pa.array([[a for a, _ in row] for row in found], pa.list_(pa.int32())), pa.array([[b for _, b in row] for row in found], pa.list_(pa.float64()))]
                yield pa.record_batch([part.column("doc_id"), part.column("weight"), *columns], names=["doc_id", "weight", "at", "x"])

    rows = sorted(map_arrow(sample, counts, with_fields(sample.select("doc_id", "weight"), "at array<int>, x array<double>")).collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), len(terms)), np.float32)
    for i, row in enumerate(rows):
        x[i, row["at"]] = np.array(row["x"], np.float32) * 100
    weights = _fit(x, np.array([r["doc_id"] in bad for r in rows]), np.array([r["weight"] for r in rows])) if terms else np.zeros(0)
    learned = {t: float(w) for t, w in zip(terms, weights) if w > 1e-3}
    draft = Lexicon({t: w for t, w in learned.items() if t[-1] != _ON}, {t[:-1]: w for t, w in learned.items() if t[-1] == _ON}, tuple(exceptions), 1.0)
    densities = [(x["density"], x["doc_id"] in bad) for x in _densities(sample, draft).collect()]
    return draft._replace(scale=_scale(densities))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row of docs."""
    density = F.col("density")
    return _densities(docs, lexicon).select("doc_id", (density / (density + lexicon.scale)).alias("score"))


def keep_clean(docs: DataFrame, lexicon: Lexicon, below: float = CUT_SCORE) -> DataFrame:
    """The rows of docs with a score under below, with all their columns."""
    place = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        density = Matcher(lexicon).density
        for batch in batches:
            for part in slices(batch, batch.schema.names[place]):
                found = [density(x) if x else 0.0 for x in part.column(place).to_pylist()]
                yield part.filter(pa.array([x / (x + lexicon.scale) < below for x in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)

"""Gibberish scores by letter bigrams: the mean of -ln p(next letter | letter) over a text's letters."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let

#: A text is gibberish over this score.
LIMIT = 4.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class BigramModel(NamedTuple):
    """ln p of each known bigram of the charset; floor for those not known. ``skip``: other characters are left out and
    their neighbours joined, or (False) part the text."""

    log_p: dict[str, float]
    charset: str
    floor: float
    limit: float = LIMIT
    skip: bool = True

    def _table(self) -> Column:
        """-ln p of each pair of the charset's characters, in order; folded to one constant."""
        costs = (-self.log_p.get(a + b, self.floor) for a in self.charset for b in self.charset)
        return F.split(F.lit(",".join(map(repr, map(float, costs)))), ",").cast("array<double>")

    def score(self, text: Column) -> Column:
        """Null for a text with no bigram."""
        inside = "".join(f"\\{c}" if not c.isalnum() else c for c in self.charset)
        whole = F.regexp_replace(text, f"[^{inside}]+", "" if self.skip else "\n")
        table, n = self._table(), len(self.charset)
        codes = F.transform(F.array_remove(F.split(whole, ""), ""), lambda c: F.instr(F.lit(self.charset), c) - 1)

        def mean(c: Column) -> Column:
            later = F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
            costs = F.zip_with(F.slice(c, 1, F.size(later)), later, lambda a, b: F.when((a >= 0) & (b >= 0), F.get(table, a * n + b)))
            known = F.array_compact(costs)
            return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))

        return F.when(F.length(whole) >= 2, let(codes, mean))

    def is_gibberish(self, text: Column) -> Column:
        return F.coalesce(self.score(text) > self.limit, F.lit(False))


def from_counts(counts: Mapping[str, Mapping[str, float]], charset: str, limit: float = LIMIT, skip: bool = True) -> BigramModel:
    """The model of nested counts (letter, next letter); a bigram that is not counted scores like half an occurrence."""
    log_p, least = {}, 1.0
    for a, row in counts.items():
        total = sum(row.values())
        for b, n in row.items():
            if n > 0:
                log_p[a + b] = math.log(n / total)
                least = min(least, 0.5 / total)
    return BigramModel(log_p, charset, math.log(least), limit, skip)


def load(path: str, limit: float = LIMIT, skip: bool = True) -> BigramModel:
    """A model file: JSON with charset, ngram_size 2 and counts."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    if made["ngram_size"] != 2:
        raise ValueError(f"a bigram model is needed, this has ngram_size {made['ngram_size']}")
    return from_counts(made["counts"], made["charset"], limit, skip)


def train(texts: DataFrame, column: str = "text", limit: float = LIMIT, skip: bool = True) -> BigramModel:
    """The model of all texts, lower-cased, within their runs of letters. Each different run is cut into bigrams once; the driver gets at most 26 x 26 counts."""
    runs = F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z]{2,}"), F.lit(0))
    counted = texts.select(F.explode_outer(runs).alias("run")).filter("run IS NOT NULL").groupBy("run").count()
    pairs = F.transform(F.sequence(F.lit(1), F.length("run") - 1), lambda i: F.substring("run", i, F.lit(2)))
    counted = counted.select(F.explode_outer(pairs).alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n"))
    counts: dict[str, dict[str, float]] = {}
    for row in counted.collect():
        counts.setdefault(row["pair"][0], {})[row["pair"][1]] = row["n"]
    return from_counts(counts, LETTERS, limit, skip)

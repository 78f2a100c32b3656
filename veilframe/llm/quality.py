"""Quality rules (operator 4): one projection, compiled from a table of thresholds.

Method: features of length, symbols, stop words and lines are computed by built-in expressions from the words and lines of the
whole text; each row of ``THRESHOLDS`` bounds one ratio of them. No user functions, no shuffle.

Words are what stands between ASCII white space. Three-word windows are compared by 64-bit hash within their document.

Defined cases: a null or empty text has no words and fails the base rules; a ratio over zero is null and fails nothing; rows that
repeat are each judged; only ``text`` is read, and the other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import every, fresh, let

#: Base rules: words at least, and percent of words in repeated windows at most.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on be with as by at this are from or an not have "
    "le la les de des du et un une en que qui dans pour pas sur est par au avec "
    "der die das und den von zu mit ein eine auf für im dem nicht ist sich als "
    "el los las y del se no una por con su para es lo como"
).split()


class Threshold(NamedTuple):
    """Keeps a text if low <= share <= high; share is the ratio of two features."""

    name: str
    part: str
    whole: str
    low: float
    high: float


#: Set so that ordinary prose is far from any bound.
THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2, 15),
    Threshold("symbols_per_word", "n_symbols", "n_words", 0, 0.1),
    Threshold("stop_words", "n_stop_words", "n_words", 0.02, 1),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", 0, 0.5),
)

NOT_SPACE = r"[^\x20\x09-\x0D]"


def _repeated(w: Column) -> Column:
    """Words that lie in a three-word window which occurs again."""

    def sorted_windows(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(placed, covered)

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    count = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(sorted_windows(h)))
    return F.when(F.size(w) < 3, 0).otherwise(count)


def features(text: Column) -> Column:
    """Struct of the features (long) of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    symbols = F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))
    in_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words"), F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).alias("n_stop_words"))

    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    c, n = let(words, counts), in_lines
    both = F.struct(c.alias("c"), n.alias("n"), symbols.alias("n_symbols"))
    names = ["n_words", "word_chars", "n_repeat_words", "n_stop_words"]
    return let(both, lambda x: F.struct(*(x["c"][k].cast("long").alias(k) for k in names), x["n_symbols"].cast("long").alias("n_symbols"), x["n"]["n"].cast("long").alias("n_lines"), x["n"]["dup"].cast("long").alias("n_dup_lines")))


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, into: str = "quality") -> DataFrame:
    """docs with the column quality (it replaces one of that name): the features, base_failed, failed (names of thresholds) and kept."""

    def verdict(f: Column) -> Column:
        base = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PERCENT * f["n_words"])
        broken = [F.when(~F.try_divide(f[t.part], f[t.whole]).between(t.low, t.high), t.name) for t in thresholds]
        failed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
        return let(failed, lambda x: F.struct(f.alias("features"), base.alias("base_failed"), x.alias("failed"), (~base & (F.size(x) == 0)).alias("kept")))

    return docs.select(*every(docs, (into,)), let(features(F.col("text")), verdict).alias(into))


def keep(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows of docs that pass."""
    into = fresh(docs, "quality")
    return judge(docs, thresholds, into).filter(F.col(into)["kept"]).select(*every(docs))

"""Language identification (operator 6).

Method: a text's vector is the mean of the embeddings of its hashed subwords (character n-grams of its lower-cased words, with a
mark at either end); a linear softmax over it gives the languages. Embeddings and softmax are trained by stochastic gradient descent in numpy
on a bounded sample of labelled rows; a part of the sample that is not trained on sets the temperature of the scores, the
score under which a prediction is rejected, and the share of subwords known from the sample under which it is. The score alone can't
reject much: the best of L chances is at least 1/L, and a text in two of two languages has just that. All of such a text is known.

To predict, embeddings and softmax are multiplied out to a table of one number for each subword bucket and language; of
a batch's texts each different word is looked up once.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and rejected; so is every text if there is nothing to
learn from; rows that repeat get the same result; of rows with one doc_id the one of least lang and text may train; any number of languages
is learned (with more of them each has fewer rows in the sample; the table takes 128 KB for each); only ``doc_id``, ``text`` and, to
learn, ``lang`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, text_keys, with_fields, without_rows
from .sampling import chosen_ids, one_row_each

#: The sample: at most so many rows of each language, of at most so many characters; and so many rows in all, but LEAST_ROWS of each language.
ROWS_PER_LANGUAGE, SAMPLE_CHARS = 512, 16_384
SAMPLE_ROWS, LEAST_ROWS = 16_384, 16
BUCKET_BITS, DIMENSIONS = 15, 16
NGRAMS = (2, 3, 4)
EPOCHS, BATCH, RATE, SEED = 12, 32, 0.5, 7
#: One row in so many of the sample calibrates.
CALIBRATE_EVERY = 4
#: Share of the calibrating rows with a right prediction that may be rejected, and the most a score must reach.
REJECTED_SHARE, MAX_THRESHOLD = 0.0, 0.3
#: Known subwords: of so many characters at least, told apart by so many bits of their hash. A text is rejected if its share of them is under
#: KNOWN_PART of the share that all but KNOWN_OUTLIERS of the calibrating rows with a right prediction reach.
KNOWN_CHARS, KNOWN_BITS, KNOWN_PART, KNOWN_OUTLIERS = 3, 22, 1 / 3, 0.005
#: Rejected rows up to this number are broadcast (some 60 bytes each) to the documents; more are joined by a shuffle.
BROADCAST_REJECTED = 200_000
#: Subwords looked up at a time.
LOOKED_UP = 1 << 17
UNDETERMINED = "und"
_MARK = 10  # newline: no word holds it


def _subwords(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, KNOWN_BITS of the hash, and start of each subword of words that stand between marks: codes begins and ends with one."""
    inner = codes != _MARK
    spread = codes.astype(np.uint64)
    for n in NGRAMS:
        last = len(codes) - n + 1
        for first in range(0, max(last, 0), LOOKED_UP):
            until = min(last, first + LOOKED_UP)
            hashed = np.full(until - first, n, np.uint64)
            whole = inner[first:until] | inner[first + 1 : until + 1]  # else it is an empty word's
            for k in range(n):
                hashed = (hashed ^ spread[first + k : until + k]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
                if 0 < k < n - 1:
                    whole &= inner[first + k : until + k]
            starts = np.flatnonzero(whole)
            yield n, (hashed[starts] >> np.uint64(64 - KNOWN_BITS)).astype(np.int64), starts + first


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return hashed >> KNOWN_BITS - BUCKET_BITS


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)


def _words(texts: pa.Array) -> pa.ListArray:
    spaced = pc.utf8_lower(texts)
    for white in "\n\t\r":
        spaced = pc.replace_substring(spaced, white, " ")
    return pc.split_pattern(spaced, " ")


class Model(NamedTuple):
    """languages, table (bucket by language), bias, temperature, the score and the share of known subwords under which a prediction is
    rejected, and the known subwords (a bit for each hash)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    least_known: float
    known: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probability of each language for each text (no null); uniform for one without words."""
        return self.judge(texts)[0]

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The scores and the share of known subwords of each text (no null); 0 for one without words."""
        split = _words(texts)
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = _codes(words)
        word_of = np.cumsum(codes == _MARK) - 1
        sums, counts = np.zeros((len(words) + 1, len(self.languages))), np.zeros(len(words) + 1)
        known, tested = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
        for n, hashed, starts in _subwords(codes):
            # A subword that begins in a word, or in the mark before it, is that word's.
            of, buckets = word_of[starts], _bucket(hashed)
            found = np.bincount(of, minlength=len(counts))
            counts += found
            if n >= KNOWN_CHARS:
                tested += found
                known += np.bincount(of, self.known[hashed >> 3] >> (hashed & 7) & 1, minlength=len(counts))
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(of, self.table[buckets, k], minlength=len(counts))
        ends = split.offsets.to_numpy()
        of = coded.indices.to_numpy()
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[of])])[ends])
        number = np.maximum(total(counts), 1)
        logits = np.stack([total(sums[:, k]) / number for k in range(len(self.languages))], axis=1) + self.bias
        return _softmax(logits / self.temperature), total(known) / np.maximum(total(tested), 1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _bags(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Buckets of each text and their shares, and the hashes of the subwords that can be known."""
    bags, hashes = [], []
    for split in _words(pa.array(texts, pa.string())).to_pylist():
        found = [(n, h) for n, h, _ in _subwords(_codes([w for w in split if w]))]
        buckets, counts = np.unique(np.concatenate([_bucket(h) for _, h in found]), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0))
        bags.append((buckets, counts / max(1, counts.sum())))
        hashes.append(np.concatenate([np.zeros(0, np.int64), *(h for n, h in found if n >= KNOWN_CHARS)]))
    return bags, hashes


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """The model of labelled texts, or None if there are none."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(SEED)
    target = np.searchsorted(languages, labels)
    bags, hashes = _bags(texts)
    order = rng.permutation(len(texts))
    held, train = order[::CALIBRATE_EVERY], np.delete(order, np.s_[::CALIBRATE_EVERY])
    if not len(train):
        train = order
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS))
    weights, bias = rng.normal(0, 0.1, (DIMENSIONS, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        train = rng.permutation(train)
        for first in range(0, len(train), BATCH):
            rows = train[first : first + BATCH]
            vectors = np.stack([bags[r][1] @ embedding[bags[r][0]] for r in rows])
            wrong = _softmax(vectors @ weights + bias)
            wrong[np.arange(len(rows)), target[rows]] -= 1
            back = wrong @ weights.T
            weights -= rate * vectors.T @ wrong / len(rows)
            bias -= rate * wrong.mean(axis=0)
            for r, step in zip(rows, back):
                # Shares are small: a text's step on its own buckets is scaled up by their number.
                embedding[bags[r][0]] -= rate * np.outer(np.minimum(bags[r][1] * len(bags[r][0]), 5), step) / len(rows)
    table = embedding @ weights
    logits = np.stack([bags[r][1] @ table[bags[r][0]] for r in held]) + bias
    truth = target[held]
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(held)), truth], 1e-12)).mean()
    temperature = min(np.geomspace(0.2, 5, 33), key=loss)
    chances = _softmax(logits / temperature)
    is_right = chances.argmax(axis=1) == truth
    right = np.sort(chances.max(axis=1)[is_right])
    threshold = min(MAX_THRESHOLD, float(right[int(REJECTED_SHARE * len(right))])) if len(right) else MAX_THRESHOLD
    known = np.zeros(1 << KNOWN_BITS, bool)
    for r in train:
        known[hashes[r]] = True
    shares = np.sort([known[hashes[r]].mean() for r in held[is_right] if len(hashes[r])])
    least_known = KNOWN_PART * float(shares[int(KNOWN_OUTLIERS * len(shares))]) if len(shares) else 0.0
    for r in held:
        known[hashes[r]] = True
    return Model(languages, table.astype(np.float32), bias, float(temperature), threshold, least_known, np.packbits(known, bitorder="little"))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """The model of a bounded sample of docs (doc_id, text, lang) that are not held out."""
    fit_for = docs.select("doc_id", "text", "lang").filter((F.length("text") <= sample_chars) & F.col("lang").isNotNull())
    chosen = chosen_ids(fit_for, "lang", rows_per_language)
    by_language: dict[str, list] = {}
    for doc_id, lang in chosen:
        by_language.setdefault(lang, []).append(doc_id)
    # In order of doc_id, which says nothing of a text: the first ones of each language.
    most = max(LEAST_ROWS, SAMPLE_ROWS // max(1, len(by_language)))
    ids = sorted({i for found in by_language.values() for i in found[:most]})
    if not ids:
        return None
    rows = sorted((x["least"]["lang"], x["doc_id"], x["least"]["text"]) for x in one_row_each(fit_for.select("doc_id", "lang", "text"), ids).collect())
    return fit([x[2] for x in rows], [x[0] for x in rows])


def _verdicts(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each text."""
    texts = pc.fill_null(texts, "")
    known = np.array(pc.match_substring_regex(texts, r"\p{L}").to_pylist(), bool) & (model is not None)
    predicted, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    rejected = ~known
    if known.any():
        chances, shares = model.judge(texts.filter(pa.array(known)))
        predicted[known] = np.array(model.languages, object)[chances.argmax(axis=1)]
        score[known] = chances.max(axis=1)
        rejected[known] = (score[known] < model.threshold) | (shares < model.least_known)
    return predicted, score, rejected


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of docs."""
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                predicted, score, rejected = _verdicts(part.column("text"), model)
                yield pa.record_batch([part.column("doc_id"), pa.array(predicted, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(docs, run, with_fields(docs.select("doc_id"), "lang_pred string, score double, rejected boolean"))


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs whose language is not rejected, with all their columns. Python gets the texts and gives back the keys of what it rejects."""
    rows = docs.select("doc_id", "text", *text_keys(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rejected = pa.array(_verdicts(part.column("text"), model)[2])
                yield pa.record_batch([part.column(k).filter(rejected) for k in ("doc_id", "k1", "k2")], names=["doc_id", "k1", "k2"])

    rejected = map_arrow(rows, run, with_fields(docs.select("doc_id"), "k1 long, k2 long")).distinct()
    return without_rows(docs, cut(rejected), BROADCAST_REJECTED)

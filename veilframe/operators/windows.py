"""Token windows, a model's probabilities over them, and the entities they spell."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters
from ..functions.gibberish import BigramModel
from ..functions.spans import no_spans, span

KEYS = ["doc_id", "segment_no"]
TOKENS = "input_ids array<int>, offset_mapping array<struct<s:int,e:int>>"


class Backend(Protocol):
    """A token classifier: for each window (with its boundary tokens) the probabilities of the labels at each of its positions."""

    labels: Sequence[str]

    def predict(self, windows: list[list[int]]) -> list[np.ndarray]: ...


class FakeBackend:
    """Deterministic: the label of a token is its id by the number of labels, with probability ``sure``."""

    def __init__(self, labels: Sequence[str], sure: float = 0.75) -> None:
        self.labels, self.sure = list(labels), sure

    def predict(self, windows: list[list[int]]) -> list[np.ndarray]:
        rest = (1 - self.sure) / max(1, len(self.labels) - 1)
        out = []
        for ids in windows:
            p = np.full((len(ids), len(self.labels)), rest)
            p[np.arange(len(ids)), np.array(ids, int) % len(self.labels)] = self.sure
            out.append(p)
        return out


class OnnxBackend:
    """A token classifier in an ONNX file with inputs input_ids and attention_mask and output logits; batches are padded and softmax taken."""

    def __init__(self, path: str, labels: Sequence[str]) -> None:
        self.path, self.labels, self._session = path, list(labels), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def predict(self, windows: list[list[int]]) -> list[np.ndarray]:
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path, providers=onnxruntime.get_available_providers())
        longest = max(map(len, windows))
        ids, mask = np.zeros((len(windows), longest), np.int64), np.zeros((len(windows), longest), np.int64)
        for i, w in enumerate(windows):
            ids[i, : len(w)], mask[i, : len(w)] = w, 1
        logits = self._session.run(None, {"input_ids": ids, "attention_mask": mask})[0]
        powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
        return [p[: len(w)] for p, w in zip(powers / powers.sum(axis=-1, keepdims=True), windows)]


#: Characters of context on either side of an entity.
AROUND = 50
#: Texts that a tokenizer gets at a time, and characters after which no more are taken.
TOKENIZED_TEXTS, TOKENIZED_CHARS = 64, 1 << 22


def _hashed(word: str, vocabulary: int = 1 << 15) -> int:
    signed = xxhash.xxh64_intdigest(word, 42)
    return (signed - (1 << 64) if signed >> 63 else signed) % vocabulary


class WordTokens(NamedTuple):
    """A tokenizer: a text's words (between ASCII white space), their ids and offsets in code points."""

    id_of: Callable[[str], int] = _hashed

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        found = [list(_WORD.finditer(text)) for text in texts]
        return [([self.id_of(m.group()) for m in words], [m.span() for m in words]) for words in found]


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class LibraryTokens(NamedTuple):
    """A tokenizer: what the tokenizers library makes of a text by a file, without special tokens. The file must be on every executor.

    prefix_space sets add_prefix_space where the file's pre-tokenizer itself (not one within a sequence) has that option; offsets are the text's own.
    """

    path: str
    prefix_space: bool = True

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[tuple[int, int]]]]:
        return [(x.ids, x.offsets) for x in _tokenizer(self.path, self.prefix_space).encode_batch(texts, add_special_tokens=False)]


#: The file of each precision in a model's folder.
PRECISIONS = {"fp32": "model.onnx", "fp16": "model_fp16.onnx"}


def _model_file(folder: str, precision: str) -> str:
    if precision not in ("auto", *PRECISIONS):
        raise ValueError(f"precision must be auto or one of {tuple(PRECISIONS)}, not {precision!r}")
    if precision != "auto":
        return f"{folder}/{PRECISIONS[precision]}"
    import onnxruntime

    on_gpu = "CUDAExecutionProvider" in onnxruntime.get_available_providers()
    half = f"{folder}/{PRECISIONS['fp16']}"
    return half if on_gpu and os.path.exists(half) else f"{folder}/{PRECISIONS['fp32']}"


def from_folder(folder: str, precision: str = "auto") -> dict:
    """backend, tokenize, first and last of the model in a folder that every executor has: an ONNX file, config.json, whose id2label are the
    labels, and tokenizer.json, whose special tokens about an empty text are the boundary tokens. precision: which ONNX file; auto is half
    precision on a GPU, if there is a file of it, and single precision else."""
    with open(f"{folder}/config.json", encoding="utf-8") as f:
        by_id = {int(k): v for k, v in json.load(f)["id2label"].items()}
    if sorted(by_id) != list(range(len(by_id))):
        raise ValueError(f"id2label of {folder} leaves ids out")
    about = _tokenizer(f"{folder}/tokenizer.json", True).encode("", add_special_tokens=True).ids
    first, last = (about[0], about[-1]) if len(about) >= 2 else (0, 0)
    return {"backend": OnnxBackend(_model_file(folder, precision), [by_id[k] for k in sorted(by_id)]), "tokenize": LibraryTokens(f"{folder}/tokenizer.json"), "first": first, "last": last}


Tokenize = Callable[[list[str]], list[tuple[list[int], list[tuple[int, int]]]]]


@lru_cache(maxsize=2)
def _tokenizer(path: str, prefix_space: bool):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if "add_prefix_space" not in (spec.get("pre_tokenizer") or {}):
        return Tokenizer.from_file(path)
    spec["pre_tokenizer"]["add_prefix_space"] = prefix_space
    return Tokenizer.from_str(json.dumps(spec))


def _some_texts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of batch of bounded size; at: the place of the text."""
    first, held = 0, 0
    for row, text in enumerate(batch.column(at)):
        size = 0 if text.as_py() is None else len(text.as_py())
        if row > first and (held + size > TOKENIZED_CHARS or row - first >= TOKENIZED_TEXTS):
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += size
    if first < batch.num_rows:
        yield batch.slice(first)


def tokens(df: DataFrame, tokenize: Tokenize) -> DataFrame:
    """df with input_ids and offset_mapping, the tokens of its text."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(TOKENS).fields])
    names, at = [*df.columns, "input_ids", "offset_mapping"], df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some_texts(batch, at):
                found = tokenize([x or "" for x in part.column(at).to_pylist()])
                offsets = [[{"s": a, "e": b} for a, b in spans] for _, spans in found]
                yield pa.record_batch([*part.columns, pa.array([ids for ids, _ in found], pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=names)

    return df.mapInArrow(run, schema)


def word_tokens(df: DataFrame, id_of: Callable[[str], int] = _hashed) -> DataFrame:
    """df with the tokens that WordTokens finds in its text."""
    return tokens(df, WordTokens(id_of))


def library_tokens(df: DataFrame, tokenizer_path: str, prefix_space: bool = True) -> DataFrame:
    """df with the tokens that LibraryTokens finds in its text."""
    return tokens(df, LibraryTokens(tokenizer_path, prefix_space))


def token_windows(df: DataFrame, window_size: int = 512, overlap: int = 0) -> DataFrame:
    """A row for each window of df's input_ids: offset (of its first token) and window_ids. A text without tokens has none."""
    step = window_size - overlap
    if window_size < 1 or overlap < 0 or step < 1:
        raise ValueError("needs 0 <= overlap < window_size")
    n = F.size("input_ids")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = df.select(*(c for c in df.columns if c != "input_ids"), "input_ids", F.explode(starts).alias("offset"))
    return rows.withColumn("window_ids", F.slice("input_ids", F.col("offset") + 1, window_size)).drop("input_ids")


def with_boundaries(ids: Column, first: int, last: int) -> Column:
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))


def predict(windows: DataFrame, backend: Backend, first: int, last: int, batch_size: int = 1) -> DataFrame:
    """Each window (doc_id, segment_no, offset, window_ids) with probs: for each of its own tokens the probabilities of the labels."""
    rows = windows.select(*KEYS, "offset", with_boundaries(F.col("window_ids"), first, last).alias("ids"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("probs array<array<double>>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                probs = [p[1:-1].tolist() for p in backend.predict(part.column("ids").to_pylist())]
                yield pa.record_batch([*(part.column(k) for k in (*KEYS, "offset")), pa.array(probs, pa.list_(pa.list_(pa.float64())))], names=[*KEYS, "offset", "probs"])

    return rows.mapInArrow(run, schema)


def combine(predicted: DataFrame, tokens: DataFrame, n_labels: int) -> DataFrame:
    """doc_id, segment_no, pos and probs: the windows' probabilities summed at each token, each by the token's sum. tokens: n_tokens of each text;
    positions from it on, which padding may leave, are dropped. A row a token and window is shuffled, after partial sums."""
    at = predicted.select(*KEYS, "offset", F.posexplode("probs").alias("i", "row")).select(*KEYS, (F.col("offset") + F.col("i")).alias("pos"), "row")
    sums = at.groupBy(*KEYS, "pos").agg(*(F.sum(F.get("row", F.lit(k))).alias(f"p{k}") for k in range(n_labels)))
    kept = sums.join(tokens.select(*KEYS, "n_tokens"), KEYS).filter("pos < n_tokens")
    whole = sum((F.col(f"p{k}") for k in range(1, n_labels)), F.col("p0"))
    return kept.select(*KEYS, "pos", F.array(*(F.col(f"p{k}") / whole for k in range(n_labels))).alias("probs"))


def best_labels(combined: DataFrame, labels: Sequence[str]) -> DataFrame:
    """doc_id, segment_no, pos, label and p of the most probable label of each token; of equal ones the first."""
    best = F.array_max("probs")
    return combined.select(*KEYS, "pos", F.get(F.array(*map(F.lit, labels)), F.array_position("probs", best).cast("int") - 1).alias("label"), best.alias("p"))


def entities(tagged: DataFrame) -> DataFrame:
    """doc_id, segment_no, type, first, last (tokens) and score (mean p) of the runs that BIO labels (doc_id, segment_no, pos, label, p) spell.

    B and S open a run; another prefix opens one after an outside tag or a change of type, and goes on with the run else; O and . close; a run also ends
    after E and S.
    """
    order = Window.partitionBy(*KEYS).orderBy("pos")
    prefix = lambda label: F.substring(F.substring_index(label, "-", 1), 1, 1)
    kind = lambda label: F.when(F.contains(label, F.lit("-")), F.substring(label, F.instr(label, "-") + 1, F.length(label))).otherwise("_")
    # What a label says is read off after the shuffle, which so carries one string a token.
    rows = tagged.select(*KEYS, "pos", "label", "p").withColumn("label_before", F.lag("label").over(order))
    label, before = F.col("label"), F.col("label_before")
    opens = prefix(label).isin("B", "S") | F.coalesce(prefix(before), F.lit("O")).isin("E", "S", "O", ".") | (kind(label) != kind(before))
    rows = rows.filter(~prefix(label).isin("O", ".")).select(*KEYS, "pos", "p", kind(label).alias("type"), opens.cast("int").alias("opens"))
    rows = rows.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*KEYS, "run", "type").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.avg("p").alias("score")).drop("run")


def trim(tag: Column, value: Column) -> Column:
    """An entity's value without punctuation at its edges: signs other than # $ % & @ at its start; unless it is a KEY, whatever is
    no word character at its end; then white space."""
    left = F.regexp_replace(value, r"^[!\"'()*+,\-./:;<=>?\[\\\]^_`{|}~]+", "")
    right = F.when(tag == "KEY", left).otherwise(F.regexp_replace(left, r"(?U)[\s\x1c-\x1f\W]+$", ""))
    return F.regexp_replace(right, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _runs(labels: list[str]) -> Iterator[tuple[str, int, int]]:
    """Type, first and last token of the runs that entities() describes, of one text's labels."""
    opened, before, kind_before = None, "O", None
    for at, label in enumerate(labels):
        prefix, kind = label[:1], label.partition("-")[2] if "-" in label else "_"
        outside = prefix in ("O", ".")
        if opened is not None and (outside or prefix in ("B", "S") or before in ("E", "S") or kind != kind_before):
            yield kind_before, opened, at - 1
            opened = None
        if not outside and opened is None:
            opened = at
        before, kind_before = prefix, kind
    if opened is not None:
        yield kind_before, opened, len(labels) - 1


def _window_sums(ids: list[list[int]], backend: Backend, window_size: int, overlap: int, batch_size: int, first: int, last: int) -> list[np.ndarray]:
    """For each text the labels' probabilities at each token, summed over its windows; a batch of windows may be of several texts."""
    sums = [np.zeros((len(x), len(backend.labels))) for x in ids]
    places = [(text, at) for text, x in enumerate(ids) for at in range(0, len(x), window_size - overlap)]
    for at in range(0, len(places), batch_size):
        some = places[at : at + batch_size]
        windows = [[first, *ids[text][begin : begin + window_size], last] for text, begin in some]
        for (text, begin), window, p in zip(some, windows, backend.predict(windows)):
            n = len(window) - 2
            sums[text][begin : begin + n] += p[1 : 1 + n]
    return sums


def model_spans(texts: DataFrame, backend: Backend, model: BigramModel, tokenize: Tokenize | None = None, window_size: int = 512, overlap: int = 0, batch_size: int = 1, first: int = 0, last: int = 0) -> DataFrame:
    """texts with entities: an array of the model branch's findings (tag, value, start, end, context, score) in each row's text.

    Tokens, windows, probabilities, labels and runs of a text are made in one pass over it, where it lies: nothing is shuffled. A text is held
    whole, with a number a token and label.
    """
    if window_size < 1 or overlap < 0 or window_size - overlap < 1:
        raise ValueError("needs 0 <= overlap < window_size")
    found_type = "array<struct<tag:string,s:int,old:string,context:string,score:double>>"
    schema = T.StructType([*texts.schema.fields, *T.StructType.fromDDL(f"entities {found_type}").fields])
    arrow = pa.list_(pa.struct([("tag", pa.string()), ("s", pa.int32()), ("old", pa.string()), ("context", pa.string()), ("score", pa.float64())]))
    names, place, cut_up = [*texts.columns, "entities"], texts.columns.index("text"), tokenize or WordTokens()
    labels = list(backend.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _some_texts(batch, place):
                bodies = [x or "" for x in part.column(place).to_pylist()]
                made = cut_up(bodies)
                every = _window_sums([ids for ids, _ in made], backend, window_size, overlap, batch_size, first, last)
                rows = []
                for body, (_, offsets), sums in zip(bodies, made, every):
                    p = sums / sums.sum(axis=1, keepdims=True)
                    best = p.argmax(axis=1) if len(p) else []
                    top = p.max(axis=1) if len(p) else []
                    runs = _runs([labels[k] for k in best])
                    found = ((kind, offsets[a][0], offsets[b][1], float(top[a : b + 1].mean())) for kind, a, b in runs)
                    rows.append([{"tag": kind, "s": s, "old": body[s:e], "context": body[max(0, s - AROUND) : e + AROUND], "score": score} for kind, s, e, score in found])
                yield pa.record_batch([*part.columns, pa.array(rows, arrow)], names=names)

    marked = texts.mapInArrow(run, schema)

    def finding(x: Column) -> Column:
        start = (x["s"] + F.greatest(F.instr(x["old"], x["value"]) - 1, F.lit(0))).cast("int")
        return F.struct(x["tag"].alias("tag"), x["value"].alias("value"), start.alias("start"), (start + F.length(x["value"])).cast("int").alias("end"), x["context"].alias("context"), x["score"].alias("score"))

    trimmed = F.transform("entities", lambda x: F.struct(x["tag"].alias("tag"), x["s"].alias("s"), x["old"].alias("old"), trim(x["tag"], x["old"]).alias("value"), x["context"].alias("context"), x["score"].alias("score")))
    kept = F.filter(F.transform(trimmed, finding), lambda x: filters.keep_entity(x["tag"], x["value"], model.is_gibberish))
    return marked.withColumn("entities", kept)


def spans_of(entities: Column) -> Column:
    """The spans (tag, value, start, end) of the entities of model_spans."""
    return F.coalesce(F.transform(entities, lambda x: span(x["tag"], x["value"], x["start"], x["end"])), no_spans())


def model_findings(texts: DataFrame, backend: Backend, model: BigramModel, tokenize: Tokenize | None = None, window_size: int = 512, overlap: int = 0, batch_size: int = 1, first: int = 0, last: int = 0) -> DataFrame:
    """A row for each finding of the model branch over texts (doc_id, segment_no, text); see model_spans."""
    found = model_spans(texts.select(*KEYS, "text"), backend, model, tokenize, window_size, overlap, batch_size, first, last)
    rows = found.select(*KEYS, F.explode_outer("entities").alias("x")).filter("x IS NOT NULL")
    return rows.select(*KEYS, "x.tag", "x.value", "x.start", "x.end", "x.context", "x.score")

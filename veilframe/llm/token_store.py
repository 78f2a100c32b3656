"""Token-id store (operator 1): documents as short, separately readable compressed id arrays.

Method: the id array of each document (an end id is appended) is serialised as little-endian unsigned integers and
compressed by itself with one zstandard dictionary that all documents share. The dictionary is trained on the serialised
arrays of a bounded sample.

File format (all of it in Parquet, so any store that Spark reaches will do, and a lost task leaves no half file):

- ``<path>/dictionary``: one row (sha256, id_bytes, end_id, dictionary).
- ``<path>/blocks``: rows in ascending doc_id order; each row is a block: the frames of consecutive documents in
  ``payload``, and as index the arrays doc_ids, frame_starts (with one more entry, the payload's length) and n_tokens;
  shard (number of the task that wrote it, ascending with doc_id), block, tokens_before (in the shard), first_doc_id,
  last_doc_id (for pruning) and dict_sha256.

Defined cases: null text is stored like an empty one (just the end id); a null doc_id comes first; rows that repeat are all
stored, those with one doc_id in order of a hash of their text; a text of 2^31 ids or more is an error; only ``doc_id`` and ``text`` are read; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_bytes, map_arrow, slices
from .sampling import one_row_each

#: The dictionary's sample: this many documents of at most so many characters (those with the least hash of doc_id; where an id repeats its least text); its size.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1_024, 8_192, 64 << 10
LEVEL = 3
BLOCK_BYTES, BLOCK_DOCS = 256 << 10, 2_048
#: Different words, and as many pre-tokens, whose ids a worker remembers: some 40 bytes each.
CACHE_WORDS = 700_000
#: Bytes of text encoded at a time: the more, the fewer times words are looked up.
ENCODED_BYTES = 8 << 20

BLOCK_SCHEMA = "shard int, block int, tokens_before long, first_doc_id long, last_doc_id long, dict_sha256 string, doc_ids array<long>, frame_starts array<int>, n_tokens array<int>, payload binary"


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for the UTF-8 bytes of each character up to U+00FF: printable bytes stand for
    themselves, the others for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def _gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[i]:starts[i] + counts[i]] for i in of, one after the other, and the index after each. All in 32 bits, which halves what is held."""
    wanted = counts[of]
    if int(wanted.sum(dtype=np.int64)) >= 1 << 31 or len(flat) >= 1 << 31:
        raise ValueError("a text of this length can't be encoded in one piece")
    after = np.cumsum(wanted, dtype=np.int32)
    total = int(after[-1]) if len(after) else 0
    shift = starts[of]
    shift -= after
    shift += wanted
    at = np.repeat(shift, wanted)
    del shift, wanted
    at += np.arange(total, dtype=np.int32)
    return flat[at], after


class _Known:
    """Strings, and the run of ids of each; looked up by Arrow, so none of them is a Python object."""

    def __init__(self) -> None:
        self.values: pa.Array | None = None
        self.starts, self.counts, self.flat, self.used = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.uint32), 0

    def places(self, values: pa.Array, runs_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of values (different ones). runs_of gives the ids, one run after the other, and their numbers, of those not known yet."""
        if self.values is None or len(self.values) + len(values) > CACHE_WORDS:
            self.__init__()
            self.values = pa.array([], values.type)
        found = pc.index_in(values, value_set=self.values)
        missing = pc.is_null(found)
        places = pc.fill_null(found, 0).to_numpy().copy()
        new = values.filter(missing)
        if len(new):
            have, need = len(self.values), len(self.values) + len(new)
            ids, counts = runs_of(new)
            if need > len(self.counts):
                self.counts, self.starts = np.resize(self.counts, 2 * need), np.resize(self.starts, 2 * need)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
            self.counts[have:need] = counts
            self.starts[have:need] = self.used + np.cumsum(counts) - counts
            self.flat[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.values = pa.concat_arrays([self.values, new])
            places[missing.to_numpy(zero_copy_only=False)] = np.arange(have, need)
        return places

    def gather(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _gather(self.flat[: self.used], self.starts, self.counts, of)


class WordEncoder:
    """Ids of many texts at once by the tokenizers library, each different word and pre-token once.

    Where a text is of Latin-1 characters alone, without odd white space, lower-casing, normalising and pre-tokenising are done for
    its different words that are not known yet (normalising changes nothing then) and the library's BPE model gets the pre-tokens. Any other text,
    any that holds an added token's name, and any text if the tokenizer is not of that make (``_MAKE``), goes through the library whole.
    """

    _MAKE = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "split": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    }
    _PRE_TOKENS = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
    #: Beyond Latin-1, no-break space, and white space other than space, tab, newline and carriage return.
    _ODD = r"[^\x00-\x08\t\n\r\x0e-\x1b -\x7f\x{a1}-\x{ff}]"

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path) as text:
            made = json.load(text)
        steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.known_make = made.get("normalizer") == self._MAKE["normalizer"] and steps[0].get("pattern") == self._MAKE["split"] and made["model"]["type"] == "BPE"
        self.added = [x["content"] for x in made.get("added_tokens", [])]
        self.letters = _byte_letters()
        self.words, self.pre_tokens = _Known(), _Known()

    def _ids_of_pre_tokens(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        ids = [[t.id for t in tokenize(x.translate(letters))] for x in new.to_pylist()]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _ids_of_words(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(new), self._PRE_TOKENS, "\\1 "), " ")
        coded = pieces.values.dictionary_encode()
        places = self.pre_tokens.places(coded.dictionary, self._ids_of_pre_tokens)
        ids, after = self.pre_tokens.gather(places[coded.indices.to_numpy()])
        return ids, np.diff(np.concatenate([np.zeros(1, np.int32), after])[pieces.offsets.to_numpy()])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        for white in "\n\t\r":
            texts = pc.replace_substring(texts, white, " ")
        split = pc.split_pattern(texts, " ")
        words = split.values.dictionary_encode()
        del texts
        places = self.words.places(words.dictionary, self._ids_of_words)
        of, ends = words.indices.to_numpy(), split.offsets.to_numpy()
        del words, split
        ids, after = self.words.gather(places[of])
        return ids, np.concatenate([np.zeros(1, np.int32), after])[ends]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; of a null one none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self._ODD) if self.known_make else pa.array([True] * len(texts), pa.bool_())
        for name in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, name, ignore_case=True))
        ids, borders = self._plain(pc.if_else(odd, "", texts))
        texts = texts.filter(odd)  # of the others their ids are all that is needed
        rest = iter(texts)
        for i, whole in enumerate(odd.to_pylist()):
            if whole:
                yield np.array(self.tokenizer.encode(next(rest).as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[borders[i] : borders[i + 1]]


@lru_cache(maxsize=1)
def word_encoder(tokenizer_path: str) -> WordEncoder:
    return WordEncoder(tokenizer_path)


def _ids_of(encoder: WordEncoder, texts: pa.Array, end_id: int) -> Iterator[np.ndarray]:
    return (np.append(ids, np.uint32(end_id)) for ids in encoder.encode(texts))


def train_dictionary(docs: DataFrame, tokenizer_path: str, end_id: int, id_bytes: int) -> bytes:
    """However large docs is, at most SAMPLE_DOCS numbers and then SAMPLE_DOCS x SAMPLE_CHARS characters reach the driver. Too few texts to train on: no dictionary (empty)."""
    hashed = F.xxhash64("doc_id")
    least = docs.filter("doc_id IS NOT NULL").groupBy(F.pmod(hashed, F.lit(SAMPLE_DOCS))).agg(F.min_by("doc_id", F.struct(hashed, "doc_id")).alias("least")).collect()
    short = docs.filter(F.length("text").between(1, SAMPLE_CHARS))
    sample = sorted(x["least"]["text"] for x in one_row_each(short, [x["least"] for x in least]).collect()) if least else []
    arrays = [ids.astype(f"<u{id_bytes}").tobytes() for ids in _ids_of(WordEncoder(tokenizer_path), pa.array(sample, pa.string()), end_id)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Stores docs (doc_id, text) under path, which must not exist; see the module for the format and the defined cases."""
    from tokenizers import Tokenizer

    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    id_bytes = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer_path, end_id, id_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared).compress
        shard = TaskContext.get().partitionId()
        block, before = 0, 0
        doc_ids, starts, counts, frames = [], [0], [], []

        def closed() -> pa.RecordBatch:
            row = [shard, block, before, doc_ids[0], doc_ids[-1], digest, doc_ids, starts, counts, b"".join(frames)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
            names = [field.split()[0] for field in BLOCK_SCHEMA.split(", ")]
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types)], names=names)

        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), _ids_of(encoder, part.column("text"), end_id)):
                    frames.append(compress(ids.astype(f"<u{id_bytes}").tobytes()))
                    doc_ids.append(doc_id)
                    counts.append(len(ids))
                    starts.append(starts[-1] + len(frames[-1]))
                    if starts[-1] >= BLOCK_BYTES or len(doc_ids) >= BLOCK_DOCS:
                        yield closed()
                        block, before = block + 1, before + sum(counts)
                        doc_ids, starts, counts, frames = [], [0], [], []
        if doc_ids:
            yield closed()

    # Rows without an id, or with one id, are parted by a hash of their text: else they would meet in one task.
    ordered = docs.withColumn("k", F.xxhash64("text")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "k").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "k").drop("k")
    with batch_bytes(spark, ENCODED_BYTES):
        map_arrow(ordered, blocks, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    head = spark.createDataFrame([(digest, id_bytes, end_id, bytearray(dictionary))], "sha256 string, id_bytes int, end_id int, dictionary binary")
    head.coalesce(1).write.parquet(f"{path}/dictionary")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (with the end id) and ids_crc32 of the store under path.

    With doc_ids only their blocks are read (Parquet's statistics of first_doc_id and last_doc_id) and only their frames decompressed.
    """
    (head,) = spark.read.parquet(f"{path}/dictionary").collect()
    dictionary, digest, id_bytes = bytes(head["dictionary"]), head["sha256"], head["id_bytes"]
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")

    # One row a shard: their number is the number of writing tasks, whatever the documents.
    shards = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens"))
    earlier = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("shard", F.coalesce(earlier, F.lit(0)).alias("shard_start"))

    wanted = None if doc_ids is None else frozenset(doc_ids)
    if wanted is not None:
        low, high = (min(wanted), max(wanted)) if wanted else (1, 0)
        blocks = blocks.filter((F.col("last_doc_id") >= low) & (F.col("first_doc_id") <= high))
    inputs = blocks.join(F.broadcast(starts), "shard").select("shard_start", "tokens_before", "dict_sha256", "doc_ids", "frame_starts", "n_tokens", "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        decompress = zstandard.ZstdDecompressor(dict_data=shared).decompress
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                if row["dict_sha256"].as_py() != digest:
                    raise ValueError(f"block written with dictionary {row['dict_sha256']}, the store has {digest}")
                start, payload = row["shard_start"].as_py() + row["tokens_before"].as_py(), row["payload"].as_buffer()
                at, out, arrays = row["frame_starts"].as_py(), [], []
                for k, (doc_id, n) in enumerate(zip(row["doc_ids"].as_py(), row["n_tokens"].as_py())):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(decompress(payload[at[k] : at[k + 1]]), f"<u{id_bytes}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc_id}: {len(ids)} ids, its index says {n}")
                        out.append((doc_id, start, n, zlib.crc32(ids.tobytes())))
                        arrays.append(ids)
                    start += n
                if out:
                    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                    columns = [pa.array(x, t) for x, t in zip(zip(*out), types)]
                    yield pa.record_batch([*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32)))], names=names)

    return map_arrow(inputs, frames, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")

"""Byte-level BPE encoding and decoding of whole texts (operator 7).

Method: overlapping chunk encoding. A text longer than ``chunk_chars`` is cut into chunks that overlap; each chunk is
pre-tokenised by itself, in parallel with the others. Matching is a function of what follows a position alone, so where two
neighbouring chunks share a boundary they agree from there on: the first shared boundary is the seam. The text between
seams is then encoded piece by piece (with what follows in view, as the pattern looks ahead). A text with no shared boundary in some overlap (one run of letters longer than
the overlap, say) is encoded as a single chunk, so the result never depends on the chunk size. Decoding concatenates the bytes of
the ids. Only boundaries are ordered by document; the chunks' texts stay where they are, so that a document's pieces are encoded by many tasks.

A pattern must be such that where a match ends is decided by at most ``MARGIN_CHARS`` characters after it (``public_tokenizers.PATTERN`` looks
ahead by one); one that looks back, or ahead over a run of any length, needs texts to be encoded whole: set ``chunk_chars`` above their length.

Defined cases: null text is encoded like an empty one (no ids); rows that repeat are each returned; only ``doc_id`` and
``text`` are read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import batched, chain, takewhile

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, slices, with_fields

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: A match that ends closer than this to the end of a chunk might go on, or be another one, in the whole text.
MARGIN_CHARS = 4
#: What tells chunks apart: document, text and number.
CHUNK = ["own", "digest", "k"]
#: Pieces whose ids a worker remembers.
CACHE_PIECES = 150_000
#: Pieces of a text that are held at a time.
HELD_PIECES = 1 << 18


class PieceEncoder:
    """Ids of a text: each match of the pattern is encoded by itself, with the ranks of a tiktoken vocabulary file. The library's
    encoder is made when first needed: decoding does without."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.known: dict[str, tuple[int, ...]] = {}

    @cached_property
    def single(self) -> Callable[[bytes], list[int]]:
        return tiktoken.Encoding("ranks", pat_str=self.pattern.pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str, until: int | None = None) -> list[int]:
        """Ids of text, or of its pieces that begin before until; what follows there still decides where the last one ends."""
        if until is None and len(text) <= HELD_PIECES:
            return self._ids(self.pieces(text))
        matches = self.pattern.finditer(text)
        pieces = (m.group() for m in (matches if until is None else takewhile(lambda m: m.start() < until, matches)))
        return list(chain.from_iterable(map(self._ids, map(list, batched(pieces, HELD_PIECES)))))

    def _ids(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return list(chain.from_iterable(map(known.__getitem__, pieces)))
        except KeyError:
            pass
        if len(known) > CACHE_PIECES:
            known.clear()
        for piece in set(pieces):
            if piece not in known:
                known[piece] = tuple(self.single(piece.encode()))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def boundaries(self, text: str) -> list[int]:
        return [match.start() for match in self.pattern.finditer(text)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> PieceEncoder:
    """One encoder a Python worker."""
    return PieceEncoder(ranks_path, pattern)


def _with_ids(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """docs with ids, and if decoded bytes, in place of the columns text and until (if there is one; see PieceEncoder.encode)."""
    kept = [c for c in docs.columns if c not in ("text", "until")]
    schema = with_fields(docs.select(*kept), "ids array<int>, bytes binary" if decoded else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        encode = bpe.encode
        for batch in batches:
            for part in slices(batch, "text"):
                untils = part.column("until").to_pylist() if "until" in part.schema.names else [None] * part.num_rows
                ids = [encode(text, until) if text else [] for text, until in zip(part.column("text").to_pylist(), untils)]
                made = [pa.array(ids, pa.list_(pa.int32()))]
                if decoded:
                    made.append(pa.array(list(map(bpe.decode, ids)), pa.binary()))
                yield pa.record_batch([*(part.column(k) for k in kept), *made], names=[*kept, *("ids", "bytes")[: len(made)]])
        bpe.known.clear()

    return map_arrow(docs, run, schema)


def _chunks(long: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """A row for each chunk of each different long row: copies says how many rows had that doc_id and text; own is doc_id as text, null too."""
    distinct = long.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    starts = F.sequence(F.lit(0), ((F.length("text") - 1) / chunk_chars).cast("int"))
    cut = F.transform(starts, lambda k: F.struct(k.alias("k"), F.substring(F.col("text"), k * chunk_chars + 1, F.lit(chunk_chars + overlap_chars)).alias("text")))
    own = F.concat(F.when(F.col("doc_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = distinct.select("doc_id", own.alias("own"), F.md5("text").alias("digest"), "copies", F.explode(cut).alias("chunk"))
    return rows.select("doc_id", "own", "digest", "copies", "chunk.k", "chunk.text").repartition(*CHUNK)


def _seams(chunks: DataFrame, ranks_path: str, pattern: str, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Each chunk's CHUNK, entry (the seam where it begins, counted from the text's start), until (the next one's) and synced (whether all
    chunks of the text have an entry)."""
    schema = with_fields(chunks.select(*CHUNK), "head array<int>, tail array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boundaries = encoder(ranks_path, pattern).boundaries
        for batch in batches:
            for part in slices(batch, "text"):
                heads, tails = [], []
                for k, text in zip(part.column("k").to_pylist(), part.column("text").to_pylist()):
                    found, base = boundaries(text), k * chunk_chars
                    trusted = len(text) - MARGIN_CHARS
                    heads.append([base + b for b in found if b <= overlap_chars])
                    tails.append([base + b for b in found if chunk_chars <= b <= trusted])
                yield pa.record_batch([*(part.column(n) for n in CHUNK), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*CHUNK, "head", "tail"])

    edges = map_arrow(chunks.select(*CHUNK, "text"), run, schema)
    whole = Window.partitionBy("own", "digest")
    entry = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(whole.orderBy("k")))))
    edges = edges.withColumn("entry", entry).withColumn("synced", F.min(F.col("entry").isNotNull()).over(whole))
    return edges.withColumn("until", F.lead("entry").over(whole.orderBy("k"))).select(*CHUNK, "entry", "until", "synced")


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs; see the module for the defined cases."""
    return _encode(docs, ranks_path, pattern, chunk_chars, overlap_chars, False)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """decode(encode(docs)): doc_id, ids and bytes of every row of docs. What is encoded in one piece is decoded by the same Python worker, so that no
    task has two at a time."""
    return _encode(docs, ranks_path, pattern, chunk_chars, overlap_chars, True)


def _encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int, overlap_chars: int, decoded: bool) -> DataFrame:
    if overlap_chars <= MARGIN_CHARS or chunk_chars <= overlap_chars:
        raise ValueError("needs chunk_chars > overlap_chars > MARGIN_CHARS")
    docs = docs.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk_chars
    short = _with_ids(docs.filter(~is_long), ranks_path, pattern, decoded)

    chunks = _chunks(docs.filter(is_long), chunk_chars, overlap_chars)
    seams = chunks.join(_seams(chunks, ranks_path, pattern, chunk_chars, overlap_chars), CHUNK)

    # From a seam on; what follows the next seam comes along, as it decides where the last piece ends.
    owned = F.expr(f"substring(text, entry - k * {chunk_chars} + 1)")
    again = F.expr("explode(sequence(1L, copies))")
    pieces = seams.filter("synced").select("doc_id", "digest", "copies", "k", owned.alias("text"), (F.col("until") - F.col("entry")).alias("until"))
    in_order = F.array_sort(F.collect_list(F.struct("k", "ids")))
    stitched = _with_ids(pieces, ranks_path, pattern).groupBy("doc_id", "digest").agg(F.max("copies").alias("copies"), F.flatten(F.transform(in_order, lambda x: x["ids"])).alias("ids"))
    stitched = stitched.select("doc_id", "ids", again.alias("copy")).drop("copy")
    if decoded:
        stitched = decode(stitched, ranks_path, pattern)

    in_order = F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, chunk_chars).alias("text"))))
    unsynced = seams.filter("NOT synced").groupBy("doc_id", "digest").agg(F.max("copies").alias("copies"), F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias("text"))
    unsynced = unsynced.select("doc_id", "text", again.alias("copy")).select("doc_id", "text")
    return short.unionByName(stitched).unionByName(_with_ids(unsynced, ranks_path, pattern, decoded))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids) with the column bytes (binary); null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(ranks_path, pattern).decode
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                column = part.column("ids")
                raw = pa.array([decode(ids.values.to_numpy(zero_copy_only=False).tolist()) if ids.is_valid else b"" for ids in column], pa.binary())
                yield pa.record_batch([part.column("doc_id"), column, raw], names=["doc_id", "ids", "bytes"])

    encoded = encoded.select("doc_id", "ids")
    return map_arrow(encoded, run, with_fields(encoded, "bytes binary"))

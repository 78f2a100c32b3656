"""SimHash near-duplicates (operator 5), with pigeonring filtering.

Fingerprint: A-Z are lower-cased, words are what stands between ASCII white space, shingles are ``shingle`` consecutive words
joined by a space, repeats included (the whole sequence if there are fewer words). A bit of the fingerprint is set if it is set
in over half of the shingles' XXH64 (seed 42). A text without words has the fingerprint zero.

Links: fingerprints that differ in at most ``distance`` bits. Candidates come from the pigeonring principle: cut the 64 bits
into ``segments`` and lay them on a ring; two fingerprints within the distance have a segment from which on every chain of
consecutive segments differs in at most (chain length x distance / segments) bits. So the first few segments of that chain are equal and
all but a few of the next ones are: these equal segments are the join key, and the whole chain condition, which ends in the
Hamming check itself, is the join's condition. Rows of equal fingerprints are one class before any join. Where a join key has very
many different fingerprints, links that connect the same are found by way of the numbers between them instead of pair by pair.

Defined cases: null text is like an empty one; rows that repeat get the same result; rows of one doc_id with different texts are each
fingerprinted, and only their fingerprints link them; a null doc_id is fingerprinted, but names no component; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, every, map_arrow, row_keys, slices, text_keys, with_fields, without_rows
from .graph import connected_components

SHINGLE_WORDS, DISTANCE_BITS, SEGMENTS = 3, 3, 8
#: Segments after the equal ones that the join key draws on.
FURTHER = 3
SEED = 42
#: Rows of a join key from which its links are no longer all listed.
CROWDED = 2_048
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16
#: Duplicates up to this number are broadcast (some 60 bytes each) to the documents; more are joined by a shuffle.
BROADCAST_DUPLICATES = 200_000

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(raw: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    words = raw.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))
    hashes = np.fromiter(map(_hash, shingles), np.uint64, len(shingles)).astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), COUNTED):
        ones += np.unpackbits(hashes[first : first + COUNTED], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (long) and k1, k2 (hashes of the text) of every row of docs."""
    docs = docs.select("doc_id", "text", *text_keys(F.col("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                prints = pa.array([fingerprint(x or b"", shingle) for x in texts], pa.int64())
                yield pa.record_batch([part.column("doc_id"), prints, part.column("k1"), part.column("k2")], names=["doc_id", "fp", "k1", "k2"])

    return map_arrow(docs, run, with_fields(docs.select("doc_id"), "fp long, k1 long, k2 long"))


def _keys(fp: Column, segments: int, distance: int) -> Column:
    """The join keys of a fingerprint: structs of key and start, its first segment."""
    bits = 64 // segments
    equal = max(n for n in range(1, segments + 1) if n * distance < segments)
    further = min(FURTHER, segments - equal)
    alike = further - (equal + further) * distance // segments
    segment = lambda i: F.shiftrightunsigned(fp, bits * (i % segments)).bitwiseAND((1 << bits) - 1)
    keys = []
    for start in range(segments):
        for case, chosen in enumerate(combinations(range(equal, equal + further), alike)):
            key = F.lit(start * 16 + case).cast("long")
            for i in (*range(equal), *chosen):
                key = F.shiftleft(key, bits).bitwiseOR(segment(start + i))
            keys.append(F.struct(key.alias("key"), F.lit(start).alias("start")))
    return F.array(*keys)


def _pairs(rows: DataFrame, distance: int, segments: int) -> DataFrame:
    """u < v of the pairs within one key that meet the chain condition."""
    bits = 64 // segments
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.expr(f"(shiftrightunsigned(a.fp ^ b.fp, {bits} * a.start) | shiftleft(a.fp ^ b.fp, 64 - {bits} * a.start))")
    chain = F.col("a.fp") < F.col("b.fp")
    for length in range(1, segments + 1):
        mask = (1 << bits * length) - 1 if length < segments else -1
        chain = chain & (F.bit_count(apart.bitwiseAND(F.lit(mask).cast("long"))) <= length * distance // segments)
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & chain)
    return pairs.select(F.least("a.rep", "b.rep").alias("u"), F.greatest("a.rep", "b.rep").alias("v")).distinct()


def _ball(fp: Column, radius: int) -> Column:
    """All numbers that differ from fp in at most radius bits."""
    flips = [sum(1 << b for b in chosen) for k in range(radius + 1) for chosen in combinations(range(64), k)]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    return F.transform(F.lit(signed).cast("array<long>"), lambda x: fp.bitwiseXOR(x))


def _stars(crowd: DataFrame, distance: int) -> DataFrame:
    """u, v: links of crowd (rep, fp) that connect whatever all its links connect, of which there may be too many to list.

    Two numbers within the distance have a number between them, near to the one by half the distance and to the other by the rest. All that
    are near such a number are linked to the least rep of those in the closer ring, which is within the distance of each. The rows grow with crowd alone.
    """
    near = distance // 2
    middles = crowd.select(F.explode(_ball(F.col("fp"), near)).alias("middle"), "rep").groupBy("middle").agg(F.min("rep").alias("least"))
    around = crowd.select("rep", F.explode(_ball(F.col("fp"), distance - near)).alias("at"))
    found = around.join(middles, F.col("at") == F.col("middle")).filter(F.col("rep") != F.col("least"))
    return found.select(F.least("rep", "least").alias("u"), F.greatest("rep", "least").alias("v")).distinct()


def links(classes: DataFrame, distance: int = DISTANCE_BITS, segments: int = SEGMENTS, crowded: int = CROWDED) -> DataFrame:
    """Pairs u < v of the column rep of classes (rep, fp; one row for each fp) whose fp differ in at most distance bits.

    All of them, but for join keys with more than ``crowded`` rows: of the fp in these, as many links as connect the same.
    """
    if 64 % segments or not 0 < distance < segments:
        raise ValueError("needs 0 < distance < segments, and segments that divide 64")
    rows = classes.select("rep", "fp", F.explode(_keys(F.col("fp"), segments, distance)).alias("k")).select("rep", "fp", "k.key", "k.start")
    large = cut(rows.groupBy("key").count().filter(F.col("count") > crowded).select("key"))
    if large.isEmpty():
        return _pairs(rows, distance, segments)
    crowd = cut(rows.join(large, "key", "left_semi").select("rep", "fp").distinct())
    return _pairs(rows.join(large, "key", "left_anti"), distance, segments).unionByName(_stars(crowd, distance)).distinct()


def _classes(marked: DataFrame, keep: Column, distance: int, segments: int) -> DataFrame:
    """class_fp and least of each fp that some row with a doc_id has: the least keep of all such rows whose fp links reach from it."""
    classes = cut(marked.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min(keep).alias("own")))
    found = connected_components(links(classes.select(F.col("fp").alias("rep"), "fp"), distance, segments))
    named = classes.join(found, F.col("fp") == F.col("node")).select("fp", "own", "component")
    least = named.groupBy("component").agg(F.min("own").alias("least"))
    linked = cut(named.join(least, "component").select(F.col("fp").alias("class_fp"), "least"))
    alone = classes.join(linked, F.col("fp") == F.col("class_fp"), "left_anti").select(F.col("fp").alias("class_fp"), F.col("own").alias("least"))
    return linked.unionByName(alone)


def components(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE_BITS, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach from it, itself included) of every row of docs."""
    marked = cut(fingerprints(docs, shingle))
    classes = _classes(marked, F.col("doc_id"), distance, segments)
    return marked.join(classes, F.col("fp") == F.col("class_fp"), "left").select("doc_id", "fp", F.col("least").alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE_WORDS, distance: int = DISTANCE_BITS, segments: int = SEGMENTS) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id (of those with one id, the one with the least fingerprint
    and hashes of its text; of equal rows one). Rows of one doc_id in different components all stay, and so do rows without doc_id."""
    marked = cut(fingerprints(docs, shingle))
    row = F.struct("doc_id", "fp", "k1", "k2")
    named = marked.filter("doc_id IS NOT NULL").join(_classes(marked, row, distance, segments), F.col("fp") == F.col("class_fp"))
    named = cut(named.select("doc_id", "k1", "k2", (row == F.col("least")).alias("stays")))
    kept = without_rows(docs, named.filter("NOT stays").distinct(), BROADCAST_DUPLICATES)
    repeated = named.filter("stays").groupBy("doc_id", "k1", "k2").count().filter("count > 1").select("doc_id", "k1", "k2")
    if repeated.isEmpty():
        return kept
    # Of rows that are equal in doc_id and text all but one go.
    marked, again, same = row_keys(kept, repeated)
    keys = ["doc_id", *marked.columns[-2:]]
    once = marked.join(bounded(again, BROADCAST_DUPLICATES), same, "left_semi").dropDuplicates(keys).select(*every(docs))
    return without_rows(kept, repeated, BROADCAST_DUPLICATES).unionByName(once)

"""Benchmark decontamination (operator 10), in DataFrame functions only.

Method: each benchmark item gives its windows of ``window`` consecutive normalised words (an item of fewer words is one window). The
distinct windows are a hash set that is broadcast if it has at most ``max_windows``: it grows with the benchmark alone. A document is
scanned by its windows' first words (``ANCHOR_WORDS`` at most) against a bitmap of bounded size; only where that bit is set is the whole
window made and looked up in the set, word by word, so no hash collision counts. A larger set is joined by a shuffle of those windows.
What is shuffled of a document is two hashes of its text, its hits and counts, never the text.

Words: A-Z are lower-cased; a word is a run of a-z, 0-9 and non-ASCII characters.

Defined cases: null and empty texts have no words and no hits; an item without words has no window; items that repeat, or share a
window, all count; rows that repeat are each judged, and so are rows of one doc_id with different texts; a row without doc_id is judged
too (rows are told apart by doc_id and 128 bits of hashes of their text); only ``doc_id`` and ``text`` (and ``item_id`` and ``text`` of
the benchmark) are read for it, and docs' other columns pass through; empty tables are no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, cut, every, fresh, let, row_keys, text_keys, without_rows

WINDOW_WORDS = 13
#: A document counts as contaminated from this share of hit words on: one in SHARE.
SHARE = 20
#: The most windows that are broadcast. About 100 bytes each: at most 100 MB.
MAX_WINDOWS = 1_000_000
#: First words of a window by which documents are scanned; 64 times 2 to the power of so many bits tell which of them the benchmark has.
ANCHOR_WORDS, ANCHOR_ROWS = 3, 12
#: Above MAX_WINDOWS a second bitmap, of whole windows, of 64 times 2 to the power of so many bits is broadcast, in as many rows of 64 bits.
BITMAP_ROWS = 20
#: Hit documents up to this number are broadcast (some 60 bytes each) to the documents; more are joined by a shuffle.
BROADCAST_DOCS = 200_000

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for a text as it is, with A-Z in words.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_OR_NOT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The normalised words of a text; none of a null one."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def build(benchmark: DataFrame, window: int = WINDOW_WORDS, max_windows: int | None = None) -> DataFrame:
    """The distinct windows of benchmark (item_id, text): n (words), window (the words, joined) and items (ids as strings).

    Only where max_windows is given are more of them an error.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    cut_at = F.sequence(F.lit(1), F.size("words") - length + 1)
    windows = items.select("item", length.alias("n"), F.explode(F.transform(cut_at, lambda i: F.array_join(F.slice("words", i, length), " "))).alias("window"))
    windows = cut(windows.groupBy("n", "window").agg(F.collect_set("item").alias("items")))
    if max_windows is not None and (found := windows.count()) > max_windows:
        raise ValueError(f"{found} windows are more than max_windows, {max_windows}")
    return windows


def _anchor(found: Column, at: Column | int, n: int) -> Column:
    return F.xxhash64(*(F.get(found, at + k) for k in range(n)))


def _bit(bits: Column, hashed: Column) -> Column:
    """Whether hashed has its bit in bits, an array of 2 to the power of ANCHOR_ROWS numbers."""
    return F.getbit(F.get(bits, F.shiftrightunsigned(hashed, 64 - ANCHOR_ROWS).cast("int")), hashed.bitwiseAND(63).cast("int")) == 1


def _anchor_bits(windows: DataFrame) -> Column:
    """The bitmap of the windows' anchors, a constant of fixed size, whatever the benchmark."""
    split = F.split("window", " ")
    hashed = F.coalesce(*(F.when(F.col("n") >= n, _anchor(split, F.lit(0), n)) for n in range(ANCHOR_WORDS, 0, -1)))
    rows = windows.select(hashed.alias("hash")).groupBy(F.shiftrightunsigned("hash", 64 - ANCHOR_ROWS).alias("place"))
    bits = [0] * (1 << ANCHOR_ROWS)
    for row in rows.agg(F.expr("bit_or(shiftleft(1L, CAST(hash & 63 AS INT)))").alias("bits")).collect():
        bits[row["place"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to one constant, unlike an array of so many


def _places(found: Column, lengths: list[int], bits: Column) -> Column:
    """pos, n and window of a document's windows of these lengths whose anchors are in bits."""

    def of_anchor(n: int) -> Column:
        these = F.array(*(F.lit(x) for x in lengths if min(x, ANCHOR_WORDS) == n))
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(0), F.size(found) - n)).otherwise(F.array().cast("array<int>"))
        likely = F.filter(starts, lambda i: _bit(bits, _anchor(found, i, n)))
        place = lambda i, m: F.struct(i.alias("pos"), m.alias("n"), F.array_join(F.slice(found, i + 1, m), " ").alias("window"))
        return F.flatten(F.transform(likely, lambda i: F.transform(F.filter(these, lambda m: i + m <= F.size(found)), lambda m: place(i, m))))

    return F.concat(*map(of_anchor, sorted({min(n, ANCHOR_WORDS) for n in lengths})))


def _possible(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows whose window has its bit set in the bitmap of the windows' hashes: all that occur there, and some others."""
    hashed = F.xxhash64("window")
    place = F.shiftrightunsigned(hashed, 64 - BITMAP_ROWS)
    bits = windows.groupBy(place.alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(xxhash64(window) & 63 AS INT)))").alias("bits"))
    is_set = F.getbit("bits", hashed.bitwiseAND(63).cast("int")) == 1
    return rows.join(F.broadcast(bits), (place == F.col("place")) & is_set).drop("place", "bits")


def _hits(docs: DataFrame, windows: DataFrame, max_windows: int) -> DataFrame:
    """doc_id, k1, k2, n_words, copies and hits (start word, words, items) of each different (doc_id, text) of docs."""
    lengths = sorted(x["n"] for x in windows.select("n").distinct().collect())  # at most WINDOW_WORDS of them
    keys = ["doc_id", "k1", "k2", "n_words"]
    rows = docs.select("doc_id", *text_keys(F.col("text")), F.col("text"))
    nothing = F.expr("CAST(array() AS array<struct<pos:int,n:int,window:string>>)")
    bits = _anchor_bits(windows)
    scanned = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (_places(w, lengths, bits) if lengths else nothing).alias("at")))
    scanned = rows.select("doc_id", "k1", "k2", scanned.alias("s")).select("doc_id", "k1", "k2", "s.n_words", F.posexplode_outer("s.at").alias("i", "at"))
    scanned = scanned.select(*keys, F.coalesce("i", F.lit(0)).alias("i"), "at.pos", "at.window")
    table = windows.select("n", F.col("window").alias("w_window"), "items")
    same = F.col("window") == F.col("w_window")
    if windows.count() <= max_windows:
        found = scanned.join(F.broadcast(table), same, "left")
    else:
        # A merge join: Spark splits what many documents share, and estimates of sizes can't make it broadcast.
        joined = _possible(scanned.filter("window IS NOT NULL"), windows).join(table.hint("merge"), same).withColumn("i", F.lit(1))
        once = scanned.filter("i = 0").withColumns({"pos": F.lit(None).cast("int"), "n": F.lit(None).cast("int"), "items": F.lit(None).cast("array<string>")})
        found = once.select(*keys, "i", "pos", "n", "items").unionByName(joined.select(*keys, "i", "pos", "n", "items"))
    hit = F.when(F.col("n").isNotNull(), F.struct("pos", "n", "items"))
    return found.groupBy(*keys).agg(F.count_if(F.col("i") == 0).alias("copies"), F.collect_set(hit).alias("hits"))


def _verdict(n_words: Column, hits: Column, share: int) -> Column:
    """The struct that judge() describes."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.sequence(x["pos"], x["pos"] + x["n"] - 1)))))

    def spans(c: Column) -> Column:
        first = F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1) < x - 1))
        last = F.filter(c, lambda x, i: F.coalesce(F.get(c, i + 1) > x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b + 1).alias("until")))

    def summary(c: Column) -> Column:
        n_hit = F.size(c).cast("long")
        items = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda x: x["items"]))))
        return F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), items.alias("items"), spans(c).alias("spans"), ((n_hit > 0) & (share * n_hit >= n_words)).alias("contaminated"))

    return let(covered, summary)


def verdicts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, share: int = SHARE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id and verdict (see judge) of every row of docs, without their other columns: no text is shuffled."""
    found = _hits(docs, build(benchmark, window), max_windows)
    found = found.select("doc_id", "copies", _verdict(F.col("n_words"), F.col("hits"), share).alias("verdict"))
    return found.select("doc_id", "verdict", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def _hit_docs(docs: DataFrame, benchmark: DataFrame, window: int, share: int, max_windows: int) -> DataFrame:
    """doc_id, k1, k2 and verdict of the different (doc_id, text) with a hit."""
    found = _hits(docs, build(benchmark, window), max_windows).filter(F.size("hits") > 0)
    return found.select("doc_id", "k1", "k2", _verdict(F.col("n_words"), F.col("hits"), share).alias("verdict"))


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, share: int = SHARE, max_windows: int = MAX_WINDOWS, into: str = "verdict") -> DataFrame:
    """docs with the column verdict (it replaces one of that name): n_words, n_hit, items (sorted), spans (of hit words: first, until)
    and contaminated.

    contaminated: some word is hit, and share x n_hit >= n_words.
    """
    found = bounded(cut(_hit_docs(docs, benchmark, window, share, max_windows)), BROADCAST_DOCS)
    marked, found, same = row_keys(docs, found)
    verdict = next(c for c in found.columns if c.startswith("found_verdict"))
    clean = _verdict(F.size(words(F.col("text"))).cast("long"), F.expr("CAST(array() AS array<struct<pos:int,n:int,items:array<string>>>)"), share)
    return marked.join(found, same, "left").select(*every(docs, (into,)), F.coalesce(F.col(verdict), clean).alias(into))


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, share: int = SHARE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the contaminated ones."""
    found = _hit_docs(docs, benchmark, window, share, max_windows).filter("verdict.contaminated").select("doc_id", "k1", "k2")
    return without_rows(docs, cut(found), BROADCAST_DOCS)


def remove_spans(docs: DataFrame, benchmark: DataFrame, **settings: int) -> DataFrame:
    """docs with the hit words, and what separates them from the next word, cut out of text."""

    def without(parts: Column, s: Column) -> Column:
        skip = F.when(parts[0].rlike(f"^{RAW_SEPARATORS}$"), 1).otherwise(0)
        # Words and separators take turns; from each span's end to the next one's start is kept, and what is before the first.
        begin = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["until"] * 2 + skip))
        end = F.concat(F.transform(s, lambda x: x["first"] * 2 + skip), F.array(F.size(parts)))
        return F.array_join(F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(parts, a + 1, F.greatest(b - a, F.lit(0))))), "")

    parts = F.regexp_extract_all("text", F.lit(WORD_OR_NOT), F.lit(0))
    into = fresh(docs, "verdict")
    spans = F.col(into)["spans"]
    cut_out = F.when(F.size(spans) == 0, F.col("text")).otherwise(let(parts, lambda p: without(p, spans)))
    return judge(docs, benchmark, into=into, **settings).withColumn("text", cut_out).select(*every(docs))

"""Cross-site line removal (operator 2), in DataFrame functions only.

Method: the spread of a line is the number of different sites (``source``) that have it. Each line hash gets a HyperLogLog sketch
of its sites; sketches merge by aggregation, also before the shuffle. A line whose estimate is clearly over ``min_sites`` is
boilerplate, one clearly under it isn't, and one within ``band`` of it gets an exact count of distinct sites. Of a boilerplate
line the first occurrence (least doc_id, then place) stays and all others are cut out.

A line is what stands between newlines, without white space at its ends; lines with nothing else don't count and stay.
Lines are compared by 96 bits of hashes. No document is dropped: one that held nothing else is left with an empty text.

Defined cases: a null text stays null; a null source is no site; rows without doc_id are neither counted nor changed; rows with one
doc_id and different texts (told apart by 128 bits of hashes) are different documents, the first of them by these hashes; rows with one
doc_id and text are one document, in which a first occurrence stays in each; all columns of docs but ``text`` pass through; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, every, fresh, let, text_keys

MIN_SITES = 10
#: Estimates within this share of min_sites are counted exactly; a sketch of 2^12 registers is off by 5 % in one case of 500.
BAND = 0.2
SKETCH_LG_K = 12
#: A line's keys and place are some 60 bytes: at most 12 MB. More boilerplate lines are joined by a shuffle.
BROADCAST_LINES = 200_000

ENDS = " \t\x0b\x0c\r"


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lines(docs: DataFrame) -> DataFrame:
    """line_doc, k1, k2 (of its text), pos, site, h and h2 of each line that counts."""
    keys = F.transform(_split(F.col("text")), lambda x: let(F.btrim(x, F.lit(ENDS)), lambda t: F.when(t != "", F.struct(F.xxhash64(t).alias("h"), F.hash(t).alias("h2")))))
    rows = docs.select(F.col("doc_id").alias("line_doc"), *text_keys(F.col("text")), F.col("source").alias("site"), F.posexplode_outer(keys).alias("pos", "k"))
    return rows.filter("k IS NOT NULL AND line_doc IS NOT NULL").select("line_doc", "k1", "k2", "pos", "site", "k.h", "k.h2")


def boilerplate(lines: DataFrame, min_sites: int, band: float) -> DataFrame:
    """h, h2 and first (line_doc, k1, k2, pos) of each line on at least min_sites sites."""
    place = F.struct("line_doc", "k1", "k2", "pos")
    spread = lines.groupBy("h", "h2").agg(F.hll_sketch_agg("site", SKETCH_LG_K).alias("sites"), F.min(place).alias("first"))
    spread = spread.select("h", "h2", "first", F.hll_sketch_estimate("sites").alias("estimate")).filter(F.col("estimate") >= min_sites * (1 - band))
    spread = cut(spread)
    clear, near = spread.filter(F.col("estimate") > min_sites * (1 + band)), spread.filter(F.col("estimate") <= min_sites * (1 + band))
    keys = bounded(near.select("h", "h2"), BROADCAST_LINES)
    counted = lines.join(keys, ["h", "h2"]).groupBy("h", "h2").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites)
    return cut(clear.unionByName(near.join(counted.select("h", "h2"), ["h", "h2"], "left_semi")).select("h", "h2", "first"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, removed_into: str | None = None) -> DataFrame:
    """docs with the boilerplate lines cut out of text. removed_into: a column for the number of lines cut out (it replaces one of that name)."""
    lines = _lines(docs)
    found = bounded(boilerplate(lines, min_sites, band), BROADCAST_LINES)
    again = lines.join(found, ["h", "h2"]).filter(F.struct("line_doc", "k1", "k2", "pos") != F.col("first"))
    doc, k1, k2, gone = (fresh(docs, name) for name in ("line_doc", "k1", "k2", "gone"))
    hits = again.groupBy("line_doc", "k1", "k2").agg(F.collect_set("pos").alias("gone"))
    hits = hits.select(F.col("line_doc").alias(doc), F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(gone))

    def rest(parts: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
        return F.array_join(F.transform(stay, lambda i: parts[i]), "\n")

    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(let(_split(F.col("text")), rest))
    own_1, own_2 = text_keys(F.col("text"))
    joined = docs.join(hits, (F.col("doc_id") == F.col(doc)) & (own_1 == F.col(k1)) & (own_2 == F.col(k2)), "left").withColumn("text", text)
    if removed_into is None:
        return joined.select(*every(docs))
    removed = F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed_into)
    return joined.select(*every(docs, (removed_into,)), F.when(F.col(gone).isNull(), F.lit(0).cast("long")).otherwise(removed).alias(removed_into))

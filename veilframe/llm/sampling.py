"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The rows that nothing may be learned from: crc32 of the id's text leaves 2 by 4. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def one_row_each(rows: DataFrame, ids: list) -> DataFrame:
    """doc_id and least, a struct of the other columns, of rows with one of these ids: where an id repeats the least row, whatever the order."""
    others = [F.col(c) for c in rows.columns if c != "doc_id"]
    return rows.filter(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least"))


def chosen_ids(rows: DataFrame, label: str, per_label: int) -> list[tuple[int, object]]:
    """doc_id and label of at most per_label rows of each label: in each of per_label hash buckets of doc_id the one of least hash.

    The driver gets per_label rows for each label, however many rows there are.
    """
    hashed = F.xxhash64("doc_id")
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    best = rows.groupBy(F.col(label).alias("label"), F.pmod(hashed, F.lit(per_label)).alias("bucket")).agg(F.min_by("doc_id", F.struct(hashed, "doc_id")).alias("doc_id"))
    return sorted((x["doc_id"], x["label"]) for x in best.select("doc_id", "label").collect())

"""Whole files as texts, and masked texts as files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Literal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_newlines, suffix

OnBadBytes = Literal["strict", "replace", "null"]


def read_files(spark: SparkSession, paths: str | list[str], universal_newlines: bool = True, errors: OnBadBytes = "strict") -> DataFrame:
    """doc_id (the path), segment_no, filename, suffix and text of each file; an empty file, which Spark does not list, gives no row.

    universal_newlines: offsets then count a carriage return and newline as one, as for detection; masking needs the text as it is.
    errors: where a file is not UTF-8, strict ends the job with an error, replace puts U+FFFD for what is wrong, null leaves the text null.
    """
    raw = F.col("content").cast("string")
    decoded = {"strict": F.validate_utf8, "replace": F.make_valid_utf8, "null": F.try_validate_utf8}
    if errors not in decoded:
        raise ValueError(f"errors must be one of {tuple(decoded)}, not {errors!r}")
    text = decoded[errors](raw)
    path = F.col("_metadata.file_path")
    files = spark.read.format("binaryFile").load(paths)
    return files.select(path.alias("doc_id"), F.lit(0).alias("segment_no"), path.alias("filename"), suffix(path).alias("suffix"), (normalize_newlines(text) if universal_newlines else text).alias("text"))


def without_blank(texts: DataFrame) -> DataFrame:
    """The rows with anything but white space in text."""
    return texts.filter(~is_blank(F.col("text")))


def write_texts(texts: DataFrame, path: str, column: str = "text") -> None:
    """One row a text, with its doc_id, as Parquet under a new path; what is read is never written over."""
    texts.select("doc_id", "segment_no", "filename", F.col(column).alias("text")).write.mode("errorifexists").parquet(path)


def _place(filename: str) -> str:
    """Where a file goes below the output folder: its own path without scheme and root."""
    parts = [x for x in re.sub(r"^[A-Za-z][A-Za-z0-9+.\-]*:", "", filename).split("/") if x not in ("", ".")]
    if not parts or ".." in parts:
        raise ValueError(f"no place for a file named {filename!r}")
    return "/".join(parts)


def write_files(texts: DataFrame, folder: str, column: str = "text") -> int:
    """Each text (filename, text) as a UTF-8 file of its own, newlines as they are, below a new folder; gives their number. A null text is no file.

    Tasks write by pyarrow's file systems (local or mounted folders, S3, GCS, HDFS), so all executors must reach the folder by its URI. A file
    gets its name when it is whole, and a task that runs again writes the same. Several texts of one name are an error: one would be lost.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else f"file:{folder}")
    if store.get_file_info(base).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    kept = texts.filter(F.col(column).isNotNull()).select("filename", F.col(column).alias("text"))
    if not kept.groupBy("filename").count().filter("count > 1").isEmpty():
        raise ValueError("several texts have one file name")
    store.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = f"{base}/{_place(name)}"
                store.create_dir(whole.rpartition("/")[0])
                with store.open_output_stream(f"{whole}.unfinished") as out:
                    out.write(text.encode())
                store.move(f"{whole}.unfinished", whole)
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return kept.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

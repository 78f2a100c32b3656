"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch between the JVM and Python in jobs that an operator runs itself, where the session keeps Spark's default: that one
#: lets an executor's tasks hold some hundreds of MB outside its heap.
BATCH_BYTES, SPARKS_BATCH_BYTES = 8 << 20, 64 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Output batches after which a worker gives back memory.
GIVE_BACK_EVERY = 16
#: Text bytes that a Python worker handles at a time; bounds what it holds besides the Arrow batch itself.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where none is named and the master is local (tests) a local one is set."""
    sc, configured = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not configured and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="checkpoint-"))
    return configured or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, stored in the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    with batch_bytes(df.sparkSession, BATCH_BYTES):
        return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch_path, in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def with_fields(df: DataFrame, fields: str) -> T.StructType:
    """df's schema and further fields, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def give_back_memory() -> None:
    """Returns what a Python worker has freed to the system: workers stay, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of size bytes for what is run within, if the session keeps Spark's default; it has its own setting back afterwards."""
    before = spark.conf.get(_BATCH_KEY)
    if before.rstrip("b") == str(SPARKS_BATCH_BYTES):
        spark.conf.set(_BATCH_KEY, str(size))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers give back memory at their end. It runs when its user runs it, with the batch size of that session."""

    def then_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for n, batch in enumerate(run(batches), 1):
                yield batch
                if not n % GIVE_BACK_EVERY:
                    give_back_memory()
        finally:
            give_back_memory()

    return df.mapInArrow(then_give_back, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row: Catalyst would copy a shared expression into each place of use."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of batch, each with at most limit bytes in column, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(lengths):
        if row > first and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    if first < len(lengths):
        yield batch.slice(first)


def text_keys(text: Column) -> tuple[Column, Column]:
    """k1 and k2, two 64-bit hashes that with doc_id tell rows apart where ids repeat."""
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def row_keys(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """docs with the keys of its rows, found (doc_id, k1, k2 and others) under names that docs doesn't have, and the condition that joins them."""
    k1, k2 = (fresh(docs, k) for k in ("k1", "k2"))
    docs = docs.withColumns(dict(zip((k1, k2), text_keys(F.col("text")))))
    names = {c: fresh(docs, f"found_{c}") for c in found.columns}
    found = found.withColumnsRenamed(names)
    same = (F.col(k1) == F.col(names["k1"])) & (F.col(k2) == F.col(names["k2"])) & F.col("doc_id").eqNullSafe(F.col(names["doc_id"]))
    return docs, found, same


def without_rows(docs: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """The rows of docs that are not in found (doc_id, k1, k2), which is broadcast if it has at most so many rows."""
    marked, found, same = row_keys(docs, bounded(found.select("doc_id", "k1", "k2"), most))
    return marked.join(found, same, "left_anti").select(*every(docs))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def every(df: DataFrame, but: tuple[str, ...] = ()) -> list[Column]:
    """df's columns, whatever signs their names hold."""
    quoted = [c.replace("`", "``") for c in df.columns if c not in but]
    return [F.col(f"`{c}`") for c in quoted]

"""Helpers that several operators share: word expressions, scratch folders, Arrow slicing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.sources.shared import shared_path

#: Separators of the words `[^\x20\x09-\x0D]+`, as a Java pattern.
SPACE_SEPARATORS = r"[\x20\x09-\x0D]+"
#: Separators of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower-cased.
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z lower-cased, every other ASCII byte but digits and letters becomes a
#: space. Bytes of 0x80 and more belong to words, as every non-ASCII character does.
ALNUM_TABLE = bytes(
    (b + 32) if 0x41 <= b <= 0x5A else b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20
    for b in range(256)
)

#: Bytes of the Arrow batches that go to Python workers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES where the session sets no bound of its own. Of Spark's 64 MB, each task has
    a vector and a stream that grow by doubling outside the heap, and the worker has them again."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() is many times faster and gives the same for ASCII text."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Words of a text, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where the body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def trimmed() -> None:
    """Gives memory that Arrow and numpy have freed back to the system, as Python workers outlive tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that `column` holds about max_bytes in each; a longer row stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 1
        if start < len(sizes):
            yield batch.slice(start)
    trimmed()


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.Table]:
    """Joins small batches and cuts large ones, to about max_bytes of `column` each."""
    held, size = [], 0
    for batch in slices(batches, column, max_bytes):
        n = (pc.sum(pc.binary_length(batch.column(column))).as_py() or 0) + batch.num_rows
        if held and size + n > max_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.Table.from_batches(held)


class Scratch:
    """A folder of its own under spark.checkpoint.dir, which driver and executors share.

    Intermediate tables are written there and read again, which cuts lineage and survives the loss
    of executors. Where the setting is unset, a local session gets a temporary folder, a cluster an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = shared_path(spark, name)
        small_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        with self.tidy():  # once the table is written, nothing reads the shuffles behind it
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """Actions in here delete their shuffles when they end; none may run a frame that ran before."""
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, "false")
        self.spark.conf.set(cleanup, "true")
        try:
            yield
        finally:
            self.spark.conf.set(cleanup, before)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

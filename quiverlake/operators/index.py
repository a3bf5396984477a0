"""The exact index: a checked, append-only table of vectors with a search strategy."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverlake.functions.vectors import as_vector, has_dimension, in_fp32_range, is_finite, sq_norm
from quiverlake.sources import index_file
from quiverlake.sources.shared import shared_path

from .search import STRATEGIES, check_strategy, topk, topk_batch

SCHEMA = "ord long, id string, values array<float>"


class SearchStrategy(Protocol):
    """A way to search of one's own: (vectors, query, k) to a table of (id, score), best first."""

    def __call__(self, vectors: DataFrame, query: list[float], k: int) -> DataFrame: ...


@dataclass
class SearchProfile:
    """Seconds of a search's phases and the bytes of vectors behind it."""

    results: list[dict] = field(default_factory=list)
    prepare_s: float = 0.0
    plan_s: float = 0.0
    execute_s: float = 0.0
    vector_bytes: int = 0


def available_backends() -> list[str]:
    """Strategies that can be asked for by name."""
    return ["scalar", "multithreaded_scalar", *STRATEGIES]


def engine_info(spark: SparkSession) -> dict[str, object]:
    sc = spark.sparkContext
    return {"spark": spark.version, "master": sc.master, "parallelism": sc.defaultParallelism, "numpy": np.__version__}


def memory_usage() -> dict[str, int]:
    """Resident and peak bytes of the driver's Python process."""
    lines = dict(line.split(":", 1) for line in open("/proc/self/status") if ":" in line) if os.path.exists("/proc/self/status") else {}
    return {name: int(lines.get(key, "0 kB").split()[0]) * 1024 for name, key in (("resident", "VmRSS"), ("peak", "VmHWM"))}


class VectorIndex:
    """Exact search over rows that were checked when they came.

    Errors: ValueError for a dimension, length, number, repeated id or name that is not allowed,
    KeyError for a missing id, RuntimeError for files and for strategies that can't run here. A failed
    append changes nothing.
    """

    def __init__(
        self,
        spark: SparkSession,
        dimension: int,
        backend: str | SearchStrategy = "scalar",
        threads: int = 1,
        allow_nonfinite: bool = False,
    ):
        if dimension <= 0:
            raise ValueError("dimension must be positive")
        if threads <= 0:
            raise ValueError("threads must be positive")
        self.strategy = check_strategy(backend) if isinstance(backend, str) else backend
        self.spark, self.dimension, self.threads, self.allow_nonfinite = spark, dimension, threads, allow_nonfinite
        self._rows = spark.createDataFrame([], SCHEMA)
        self._size = 0
        self._buffer: dict[str, np.ndarray] = {}
        self._snapshot: DataFrame | None = None

    @classmethod
    def from_dataframe(cls, df: DataFrame, dimension: int, id_col: str = "id", vector_col: str = "values", order_col: str | None = None, **options) -> VectorIndex:
        index = cls(df.sparkSession, dimension, **options)
        index.add_dataframe(df, id_col, vector_col, order_col)
        return index

    def size(self) -> int:
        return self._size + len(self._buffer)

    def thread_count(self) -> int:
        return self.threads

    def add(self, id: str, values: object) -> None:
        """One row, kept in the driver until the next search or bulk append."""
        if not isinstance(id, str):
            raise TypeError("a vector ID must be a string")
        vector = as_vector(values, self.dimension)
        self._check_numbers(vector)
        if id in self._buffer or (self._size and self._rows.where(F.col("id") == id).limit(1).count()):
            raise ValueError(f"vector ID already exists: {id}")
        self._buffer[id] = vector

    def _check_numbers(self, vector: np.ndarray) -> None:
        if not self.allow_nonfinite and not np.isfinite(vector).all():
            raise ValueError("a vector's components must be finite")
        if self.strategy in ("arrow_fp32", "arrow_naive_fp32"):
            low, high = np.sqrt(np.finfo(np.float32).tiny), np.sqrt(np.finfo(np.float32).max / (4 * self.dimension))
            size = np.abs(vector.astype(np.float64))
            if ((size != 0) & ((size < low) | (size > high))).any():
                raise ValueError("a vector's components are out of the range for 4-byte sums")

    def add_dataframe(self, df: DataFrame, id_col: str = "id", vector_col: str = "values", order_col: str | None = None) -> None:
        """Many rows at once, all or none. order_col gives the order of insertion; without it, that of ids."""
        self.flush()
        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("values"), F.col(order_col or id_col).alias("_order"))
        checks = [F.count("*").alias("n"), F.count(F.when(~has_dimension(F.col("values"), self.dimension), 1)).alias("size"), F.count(F.when(F.col("id").isNull(), 1)).alias("null")]
        if not self.allow_nonfinite:
            checks.append(F.count(F.when(~is_finite(F.col("values")), 1)).alias("finite"))
        if self.strategy in ("arrow_fp32", "arrow_naive_fp32"):
            checks.append(F.count(F.when(~in_fp32_range(F.col("values"), self.dimension), 1)).alias("range"))
        found = rows.agg(*checks).first().asDict()
        if found["size"]:
            raise ValueError(f"{found['size']} vectors do not have {self.dimension} components")
        if found["null"]:
            raise ValueError(f"{found['null']} vectors have no ID")
        if found.get("finite"):
            raise ValueError(f"{found['finite']} vectors have components that are not finite")
        if found.get("range"):
            raise ValueError(f"{found['range']} vectors have components out of the range for 4-byte sums")
        again = rows.groupBy("id").count().where("count > 1").select("id")
        if self._size:
            again = again.unionByName(rows.select("id").join(self._rows.select("id"), "id", "left_semi"))
        if twice := again.limit(1).collect():
            raise ValueError(f"vector ID already exists: {twice[0]['id']}")
        # the order is global: sorted ranges of ids alone, stored once, get numbers from their ranges' counts
        ranged = rows.select("_order", "id").repartitionByRange("_order", "id").select("_order", "id", F.spark_partition_id().alias("p"))
        path = shared_path(self.spark, "order")
        ranged.write.parquet(path)
        ranged = self.spark.read.schema(ranged.schema).parquet(path)
        numbered = ranged.select("id", "p", F.row_number().over(Window.partitionBy("p").orderBy("_order", "id")).alias("k"))
        sizes = {r["p"]: r["count"] for r in ranged.groupBy("p").count().collect()}
        firsts, total = {}, self._size
        for p in sorted(sizes):
            firsts[p], total = total, total + sizes[p]
        start = self.spark.createDataFrame(list(firsts.items()) or [(0, 0)], "p int, first long")
        numbers = numbered.join(F.broadcast(start), "p").select((F.col("first") + F.col("k") - 1).alias("ord"), "id")
        placed = rows.select("id", "values").join(numbers, "id").select("ord", "id", "values")
        self._rows = self._rows.unionByName(placed)
        self._size = total

    def flush(self) -> None:
        """Turns buffered rows into part of the table."""
        if self._buffer:
            rows = [(self._size + i, k, [float(x) for x in v]) for i, (k, v) in enumerate(self._buffer.items())]
            self._rows = self._rows.unionByName(self.spark.createDataFrame(rows, SCHEMA))
            self._size += len(rows)
            self._buffer = {}

    def rows(self) -> DataFrame:
        """(ord, id, values), in no order."""
        self.flush()
        return self._rows

    def scan(self) -> DataFrame:
        """All rows in order of insertion."""
        return self.rows().orderBy("ord")

    def for_each_vector(self, visit: Callable[[str, np.ndarray], None]) -> None:
        for r in self.scan().toLocalIterator():
            visit(r["id"], np.array(r["values"], np.float32))

    def get(self, id: str) -> np.ndarray:
        if (found := self._buffer.get(id)) is not None:
            return found.copy()
        row = self._rows.where(F.col("id") == id).select("values").first()
        if row is None:
            raise KeyError(id)
        return np.array(row["values"], np.float32)

    def build_index(self) -> None:
        """Keeps a snapshot in memory for the searches to come. Appends make it stale; the next search or
        call replaces it, and frees the old one only when the new one stands."""
        self.flush()
        new = self._rows.withColumn("sqnorm", sq_norm(F.col("values"))).persist()
        new.count()
        if self._snapshot is not None:
            self._snapshot.unpersist()
        self._snapshot, self._snapshot_size = new, self._size

    def _table(self) -> DataFrame:
        self.flush()
        if self._snapshot is not None and self._snapshot_size != self._size:
            self.build_index()
        table = self._snapshot if self._snapshot is not None else self._rows
        return table.coalesce(self.threads) if self.threads > 1 else table  # no shuffle

    def search_dataframe(self, query: object, k: int) -> DataFrame:
        vector = as_vector(query, self.dimension)
        self._check_numbers(vector)
        if k < 0:
            raise ValueError("k must not be negative")
        if callable(self.strategy):
            return self.strategy(self._table(), vector.tolist(), k)
        return topk(self._table(), vector.tolist(), k, self.strategy)

    def search(self, query: object, k: int) -> list[dict]:
        """The K best rows as dicts of id and score, best first."""
        return [{"id": r["id"], "score": r["score"]} for r in self.search_dataframe(query, k).collect()]

    def search_batch(self, queries: DataFrame, k: int, strategy: str = "arrow_exact") -> DataFrame:
        return topk_batch(self._table(), queries, k, strategy)

    def search_profiled(self, query: object, k: int) -> SearchProfile:
        t = [time.perf_counter()]
        self._table()
        t.append(time.perf_counter())
        df = self.search_dataframe(query, k)
        t.append(time.perf_counter())
        results = [{"id": r["id"], "score": r["score"]} for r in df.collect()]
        t.append(time.perf_counter())
        return SearchProfile(results, t[1] - t[0], t[2] - t[1], t[3] - t[2], self.size() * self.dimension * 4)

    def save(self, path: str) -> None:
        """Writes the index file, row by row in order."""
        index_file.write(path, self.dimension, self.size(), ((r["id"], r["values"]) for r in self.scan().toLocalIterator()))

    @classmethod
    def load(cls, spark: SparkSession, path: str, into: VectorIndex | None = None, **options) -> VectorIndex:
        """Reads an index file, all of it checked. `into` must be empty and of the file's dimension."""
        dimension, count = index_file.header(path)
        if into is not None and (into.size() or into.dimension != dimension):
            raise ValueError("the index to load into must be empty and of the same dimension")
        index = into if into is not None else cls(spark, dimension, **options)
        rows = [(i, name, values) for i, (name, values) in enumerate(index_file.records(path))]
        if len({r[1] for r in rows}) != len(rows):
            raise RuntimeError("the index file repeats an ID")
        index._rows = spark.createDataFrame(rows, SCHEMA)
        index._size = len(rows)
        return index

    def iterate(self) -> Iterator[tuple[str, np.ndarray]]:
        for r in self.scan().toLocalIterator():
            yield r["id"], np.array(r["values"], np.float32)

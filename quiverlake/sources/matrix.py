"""Headerless matrices of little-endian 4-byte floats, truth files, logs, and metadata with checksums."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def write_matrix(path: str, rows: np.ndarray) -> None:
    np.ascontiguousarray(rows, "<f4").tofile(path)


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Reader(DataSourceReader):
    """Rows have one size, so partitions are ranges of rows."""

    def __init__(self, path: str, dimension: int, rows: int | None, part_rows: int):
        self.path, self.dimension, self.part_rows = path, dimension, part_rows
        size, row = os.path.getsize(path), 4 * dimension
        if size % row or (rows is not None and size != rows * row):
            raise RuntimeError(f"{path} has {size} bytes, which is not the stated number of rows of {row}")
        self.rows = size // row

    def partitions(self) -> list[InputPartition]:
        return [RowRange(i, min(i + self.part_rows, self.rows)) for i in range(0, max(self.rows, 1), self.part_rows)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        n = partition.last - partition.first
        a = np.fromfile(self.path, "<f4", n * self.dimension, offset=partition.first * 4 * self.dimension)
        if not np.isfinite(a).all():
            raise RuntimeError(f"{self.path} has numbers that are not finite")
        bounds = pa.array(np.arange(n + 1, dtype=np.int32) * self.dimension)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first, partition.last)), pa.ListArray.from_arrays(bounds, pa.array(a.astype(np.float32)))], ["ord", "values"])


class MatrixSource(DataSource):
    """spark.read.format("f32_matrix").option("dimension", n).load(path); option rows checks the count."""

    @classmethod
    def name(cls) -> str:
        return "f32_matrix"

    def schema(self) -> str:
        return "ord long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        rows = self.options.get("rows")
        return Reader(self.options["path"], int(self.options["dimension"]), int(rows) if rows else None, int(self.options.get("part_rows", 65536)))


def truth_lines(results: DataFrame) -> DataFrame:
    """(query_id, value): each query's ids by rank, joined by commas."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    return results.groupBy("query_id").agg(F.array_join(ids, ",").alias("value"))


def write_truth(results: DataFrame, path: str) -> None:
    """One line a query, in order of queries."""
    truth_lines(results).orderBy("query_id").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_truth(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(line, rank, id) of a truth file; with k, each line must have so many ids."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    found = lines.select("line", F.split("value", ",").alias("ids"))
    if k is not None and (bad := found.where(F.size("ids") != k).count()):
        raise RuntimeError(f"{bad} lines do not have {k} ids")
    return found.select("line", F.posexplode("ids").alias("rank", "id")).withColumn("rank", F.col("rank") + 1)


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """(kind, fields): lines such as LAYER,layer=0,nodes=5 as their first word and a map."""
    lines = spark.read.text(path).where(F.col("value").rlike("^[A-Z]+,"))
    rest = F.regexp_replace("value", "^[A-Z]+,", "")
    return lines.select(F.substring_index("value", ",", 1).alias("kind"), F.str_to_map(rest, F.lit(","), F.lit("=")).alias("fields"))


def write_runs(spark: SparkSession, rows: list[dict], path: str) -> None:
    """Measured runs as CSV: a header, then a line for each run, in the order given."""
    columns = list(rows[0])
    table = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], columns)
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_metadata(path: str, files: dict[str, str], **fields: object) -> None:
    """A JSON file with fields and the SHA-256 of each file."""
    sums = {name: hashlib.sha256(open(p, "rb").read()).hexdigest() for name, p in files.items()}
    with open(path, "w") as f:
        json.dump({**fields, "sha256": sums}, f, indent=1, sort_keys=True)


def verify_metadata(spark: SparkSession, path: str, files: dict[str, str]) -> dict:
    """The fields, once each file's SHA-256 agrees; else RuntimeError."""
    found = json.load(open(path))
    for name, p in files.items():
        have = spark.read.format("binaryFile").load(p).select(F.sha2("content", 256)).first()[0]
        if have != found["sha256"].get(name):
            raise RuntimeError(f"{p} differs from its recorded checksum")
    return found


def register(spark: SparkSession) -> None:
    from .index_file import VectorIndexSource

    spark.dataSource.register(MatrixSource)
    spark.dataSource.register(VectorIndexSource)

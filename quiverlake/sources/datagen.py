"""Generated vectors: each row depends on the seed and its ordinal alone, so partitions don't matter."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, count: int, make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ordinals = batch.column("id").to_pylist()
            values = pa.array([make(i) for i in ordinals], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(str, ordinals))), values], ["ord", "id", "values"])

    return spark.range(count).mapInArrow(run, "ord long, id string, values array<float>")


def generator(seed: int, *key: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *key])))


def uniform_vectors(spark: SparkSession, count: int, dimension: int, seed: int = 42) -> DataFrame:
    """Components from -1 to 1."""
    return _rows(spark, count, lambda i: generator(seed, 0, i).uniform(-1, 1, dimension).astype(np.float32))


def clustered_vectors(spark: SparkSession, count: int, dimension: int, clusters: int = 100, seed: int = 42) -> DataFrame:
    """Unit vectors around `clusters` unit centres, taken in turn, with noise of 0.25 over the root of the dimension."""

    def make(i: int) -> np.ndarray:
        centre = generator(seed, 1, i % clusters).standard_normal(dimension)
        v = centre / np.linalg.norm(centre) + generator(seed, 2, i).standard_normal(dimension) * 0.25 / np.sqrt(dimension)
        return (v / np.linalg.norm(v)).astype(np.float32)

    return _rows(spark, count, make)


def grid_vectors(count: int, dimension: int, seed: int = 1729) -> np.ndarray:
    """Thousandths from -1 to 1, from the raw outputs of the 32-bit Mersenne Twister, row after row."""
    source = np.random.MT19937()
    source._legacy_seeding(seed)
    raw = source.random_raw(count * dimension).astype(np.int64)
    return ((raw % 2001 - 1000).astype(np.float32) / np.float32(1000)).reshape(count, dimension)


def held_out_sample(base: DataFrame, pool: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """`count` rows of pool (ord, values) that equal no row of base: the first by a seeded hash of the
    ordinal, in order of ordinals."""
    fresh = pool.join(base.select("values").distinct(), "values", "left_anti")
    return fresh.orderBy(F.xxhash64(F.lit(seed), "ord"), "ord").limit(count).orderBy("ord")


def parameter_grid(spark: SparkSession, **values: list) -> DataFrame:
    """Every combination of the given values, which are few."""
    found = None
    for name, choices in values.items():
        one = spark.createDataFrame([(c,) for c in choices], [name])
        found = one if found is None else found.crossJoin(F.broadcast(one))
    return found


def run_order(items: list, seed: int = 2026) -> list:
    order = list(items)
    random.Random(seed).shuffle(order)
    return order

"""Vector functions of columns, and their SQL names.

A score is the double sum of products in dimension order, over the root of the product of the squared
norms, as a 4-byte float; it is exactly 0 if either vector is zero. Ranking compares these floats.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLT_MIN, FLT_MAX = float(np.finfo(np.float32).tiny), float(np.finfo(np.float32).max)


def dot(a: Column, b: Column) -> Column:
    """Sum of products as doubles, in dimension order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column, a_sq: Column | None = None, b_sq: Column | None = None) -> Column:
    """Score of two vectors; squared norms may be given if they are known."""
    n = (sq_norm(a) if a_sq is None else a_sq) * (sq_norm(b) if b_sq is None else b_sq)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(n)).cast("float")


def l2_normalize(a: Column, a_sq: Column | None = None) -> Column:
    """The vector over its norm; null for a zero vector."""
    n = F.sqrt(sq_norm(a) if a_sq is None else a_sq)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float")))


def has_dimension(a: Column, dimension: int) -> Column:
    return F.coalesce(F.size(a) == dimension, F.lit(False))


def is_finite(a: Column) -> Column:
    """Whether no component is null, NaN or infinite."""
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def in_fp32_range(a: Column, dimension: int) -> Column:
    """Whether 4-byte products and their sum can neither overflow nor vanish; zeros may stand."""
    low, high = math.sqrt(FLT_MIN), math.sqrt(FLT_MAX / (4 * dimension))
    return F.forall(a, lambda x: (x == 0) | F.abs(x.cast("double")).between(low, high))


def within(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(a.cast("double") - b.cast("double")) <= tolerance


def row_name(ordinal: Column, prefix: str = "") -> Column:
    """Ids made from ordinals, such as vector-7."""
    return F.concat(F.lit(prefix), ordinal.cast("string"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def float_bits(a: pd.Series) -> pd.Series:
    """The bits of 4-byte floats, as numbers from 0 to 2^32 - 1."""
    return a.map(lambda v: None if v is None else np.asarray(v, "<f4").view("<u4").astype(np.int64))


@F.pandas_udf(T.BinaryType())
def float_bytes(a: pd.Series) -> pd.Series:
    return a.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def row_sha256(a: Column) -> Column:
    """SHA-256 of a vector's little-endian bytes, in hexadecimal."""
    return F.sha2(float_bytes(a), 256)


def fnv1a(parts: Iterator[bytes], start: int = 0xCBF29CE484222325) -> int:
    """64-bit FNV-1a over byte strings in the order given."""
    for part in parts:
        for byte in part:
            start = (start ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return start


def fnv_words(rows: Iterator[np.ndarray], start: int = 0xCBF29CE484222325) -> int:
    """FNV-1a over whole 32-bit words of vectors instead of single bytes."""
    for row in rows:
        for word in np.asarray(row, "<f4").view("<u4").tolist():
            start = (start ^ word) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return start


def sha256(row: np.ndarray) -> str:
    return hashlib.sha256(np.asarray(row, "<f4").tobytes()).hexdigest()


class VecTopk:
    """vec_topk(TABLE(rows), query, k): (id, score) of the K best rows (id, values) of each partition of its table.

    `TABLE(rows) PARTITION BY (x)` ranks each x by itself, and `TABLE(rows)` each partition that Spark reads, without
    a shuffle: ORDER BY score DESC, id LIMIT k over that ranks the whole. A task holds 2 K and 1,024 rows at most. Rows of null id or values are left out; another length than the query's is a ValueError.
    """

    def __init__(self):
        self.best: list[tuple[float, bytes]] = []
        self.query, self.k = None, 0

    def eval(self, row, query, k):
        if row["id"] is None or row["values"] is None or query is None or k is None or k <= 0:
            return
        if self.query is None:
            self.query, self.k = np.array(query, np.float32).astype(np.float64), k
            self.q_sq = np.add.accumulate(self.query * self.query)[-1] if len(query) else 0.0
        v = np.array(row["values"], np.float32).astype(np.float64)
        if len(v) != len(self.query):
            raise ValueError(f"a vector must have {len(self.query)} components, not {len(v)}")
        size = self.q_sq * np.add.accumulate(v * v)[-1] if len(v) else 0.0
        score = np.float32(np.add.accumulate(v * self.query)[-1] / math.sqrt(size)) if size else np.float32(0)
        self.best.append((-float(score), row["id"].encode()))
        if len(self.best) >= 2 * self.k + 1024:
            self.best = sorted(self.best)[: self.k]

    def terminate(self):
        for score, name in sorted(self.best)[: self.k]:
            yield name.decode(), -score + 0.0


def register(spark: SparkSession) -> None:
    """vec_dot, vec_sqnorm and vec_cosine for SQL, as expressions that the optimizer sees through; vec_topk as a table function."""
    spark.udtf.register("vec_topk", F.udtf(VecTopk, returnType="id string, score float"))
    fold = "aggregate({}, 0D, (s, x) -> s + x)"
    pair = fold.format("zip_with(a, b, (x, y) -> double(x) * double(y))")
    own = fold.format("transform({0}, x -> double(x) * double(x))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN {pair}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION vec_sqnorm(a ARRAY<FLOAT>) RETURNS DOUBLE RETURN {own.format('a')}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION vec_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS FLOAT RETURN "
        f"float(CASE WHEN {own.format('a')} * {own.format('b')} = 0 THEN 0 ELSE {pair} / sqrt({own.format('a')} * {own.format('b')}) END)"
    )


def as_vector(values: object, dimension: int | None = None) -> np.ndarray:
    """A vector from a list, tuple, range, array or buffer of real numbers, copied to 4-byte floats.

    Text, bytes, sets, nested and non-numeric values raise TypeError; other shapes than one dimension,
    wrong lengths and numbers beyond 4-byte floats raise ValueError.
    """
    if isinstance(values, (str, bytes, bytearray, set, dict)) or not hasattr(values, "__len__"):
        raise TypeError("a vector must be a sequence or buffer of real numbers")
    if isinstance(values, (list, tuple)) and any(isinstance(v, (str, bytes, list, tuple)) or v is None for v in values):
        raise TypeError("a vector's components must be real numbers")
    a = np.asarray(values)
    if a.dtype.kind not in "fiub":
        raise TypeError(f"a vector of {a.dtype} is no vector of real numbers")
    if a.ndim != 1:
        raise ValueError("a vector must have one dimension")
    if dimension is not None and len(a) != dimension:
        raise ValueError(f"a vector must have {dimension} components, not {len(a)}")
    return np.array(a, np.float32)

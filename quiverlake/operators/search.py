"""Exact Top-K search: one logical operator, several ways to work out the scores.

| strategy    | scores                                                     | contract            |
|-------------|------------------------------------------------------------|---------------------|
| sql         | Catalyst expressions                                        | exact               |
| arrow_exact | Arrow batches; matrix products say which rows can be among the K, and sums in dimension order score those | exact, the default |
| arrow       | Arrow batches, matrix products in doubles                   | within 1e-6         |
| arrow_fp32  | Arrow batches, matrix products in 4-byte floats             | within 1e-5         |
| arrow_naive_fp32 | as arrow_exact, with sums in 4-byte floats             | within 1e-5         |

Results are ordered by score, then by id as bytes. Queries are a stated set: they go to the vectors in
blocks of bounded size, each task keeps K rows a query, and only those are shuffled to the final Top-K.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions.vectors import cosine, sq_norm

STRATEGIES = ("sql", "arrow_exact", "arrow", "arrow_fp32", "arrow_naive_fp32")
#: Names of strategies that need hardware which this engine does not drive.
UNAVAILABLE = ("avx2", "multithreaded_avx2", "cuda", "cuda_per_query", "cuda_block_parallel", "cuda_fp32", "cuda_block_parallel_fp32")
RESULT = "query_id long, id string, score float"


def check_strategy(name: str) -> str:
    name = {"scalar": "sql", "multithreaded_scalar": "sql"}.get(name, name)
    if name in UNAVAILABLE:
        raise RuntimeError(f"strategy {name} is unavailable")
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}")
    return name


def exact_scores(v: np.ndarray, q: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Scores of all rows of v against all of q, every sum in dimension order and of this kind; queries' norms are doubles."""
    columns = np.ascontiguousarray(v.T, kind)
    queries = np.ascontiguousarray(q.T, kind)
    total, vn, qn = np.zeros((v.shape[0], q.shape[0]), kind), np.zeros(v.shape[0], kind), np.zeros(q.shape[0])
    for x, y in zip(columns, queries, strict=True):
        total += x[:, None] * y[None, :]
        vn += x * x
        qn += y.astype(np.float64) ** 2
    return over_norms(total, vn.astype(np.float64), qn)


def over_norms(total: np.ndarray, vn: np.ndarray, qn: np.ndarray) -> np.ndarray:
    n = vn[:, None] * qn[None, :]
    return np.where(n == 0, 0.0, total / np.sqrt(np.where(n == 0, 1.0, n))).astype(np.float32)


def matrix_scores(v: np.ndarray, q: np.ndarray, kind: type) -> np.ndarray:
    a, b = v.astype(kind), q.astype(kind)
    return over_norms((a @ b.T).astype(np.float64), (a * a).sum(1, dtype=np.float64), (b * b).sum(1, dtype=np.float64))


def score_block(strategy: str, v: np.ndarray, q: np.ndarray) -> np.ndarray:
    if strategy in ("arrow_exact", "arrow_naive_fp32"):
        return exact_scores(v, q, np.float64 if strategy == "arrow_exact" else np.float32)
    return matrix_scores(v, q, np.float64 if strategy == "arrow" else np.float32)


def best_rows(scores: np.ndarray, ids: list[str], k: int) -> list[int]:
    """Places of the K best, by score and then id."""
    at = np.arange(len(scores))
    if len(at) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    return sorted(at.tolist(), key=lambda i: (-scores[i], ids[i].encode()))[:k]


def topk(vectors: DataFrame, query: list[float], k: int, strategy: str = "sql", id_col: str = "id", vector_col: str = "values") -> DataFrame:
    """(id, score): the K best rows for one query, best first.

    K of 0, or no rows, gives none; K above the number of rows gives all. vectors has the dimension of
    the query; see VectorIndex for checked input.
    """
    strategy = check_strategy(strategy)
    if strategy == "sql":
        q = F.array(*(F.lit(float(np.float32(x))).cast("float") for x in query))
        q_sq = 0.0
        for x in query:
            q_sq += float(np.float32(x)) ** 2
        scored = vectors.select(F.col(id_col).alias("id"), cosine(F.col(vector_col), q, b_sq=F.lit(q_sq)).alias("score"))
        return scored.orderBy(F.desc("score"), F.asc("id")).limit(k)
    spark = vectors.sparkSession
    one = spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, qvalues array<float>")
    return topk_batch(vectors, one, k, strategy, id_col, vector_col).orderBy("rank").select("id", "score")


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, in blocks of bounded size."""
    ids, rows, size = [], [], 0
    for r in queries.select("query_id", "qvalues").toLocalIterator():
        ids.append(r["query_id"])
        rows.append(np.asarray(r["qvalues"], np.float32))
        size += rows[-1].nbytes
        if size >= block_bytes:
            yield np.array(ids, np.int64), np.stack(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids, np.int64), np.stack(rows)


def list_matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)


#: Scores that a task works out at a time: rows of a block times queries.
SCORES = 1 << 21
#: More than a score by a matrix product in doubles is off: such sums of products of 4-byte floats are off by
#: 1e-14 or so, and an exact score is rounded to 4 bytes, by 6e-8 at most.
SLACK = 1e-6
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 14


def sq_norms(v: np.ndarray) -> np.ndarray:
    """Squared norms, every sum in dimension order."""
    return np.add.accumulate(v * v, axis=1)[:, -1]


def near_scores(v: np.ndarray, v_sq: np.ndarray, q: np.ndarray, q_sq: np.ndarray) -> np.ndarray:
    """Scores of all queries (rows of the result) against all of v, in doubles, within SLACK of the exact ones."""
    n = np.maximum(q_sq[:, None] * v_sq[None, :], np.finfo(np.float64).tiny)  # with a zero vector the product is 0 as well
    found = q @ v.T
    found /= np.sqrt(n, out=n)
    return found


def pair_scores(v: np.ndarray, v_sq: np.ndarray, q: np.ndarray, q_sq: np.ndarray) -> np.ndarray:
    """Scores of rows of v, each against its own row of q, every sum in dimension order."""
    dots, n = np.add.accumulate(v * q, axis=1)[:, -1], v_sq * q_sq
    return np.where(n == 0, 0.0, dots / np.sqrt(np.where(n == 0, 1.0, n))).astype(np.float32)


class Kept:
    """The K best rows of each query so far, by score and then id; until `trim`, also those that tie with the last."""

    def __init__(self, count: int, k: int):
        self.k, self.least, self.room = k, np.full(count, -np.inf, np.float32), 4 * count * k + (1 << 18)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, object)

    def floor(self, near: np.ndarray) -> np.ndarray:
        """What the K best of each query score at least, now or among the rows of near; near is off by SLACK at most."""
        found = self.least.astype(np.float64) - SLACK
        fresh = np.flatnonzero(np.isneginf(self.least))
        if len(fresh) and near.shape[1] > self.k:
            at = near.shape[1] - self.k
            found[fresh] = np.partition(near[fresh], at, axis=1)[:, at] - 2 * SLACK
        return found

    def pick(self, order: np.ndarray) -> None:
        self.query, self.score, self.id = self.query[order], self.score[order], self.id[order]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.query, self.score, self.id = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids)))
        self.pick(np.lexsort((-self.score, self.query)))
        last = np.arange(len(self.query)) - np.searchsorted(self.query, self.query) == self.k - 1
        self.least[self.query[last]] = self.score[last]
        self.pick(np.flatnonzero(~(self.score < self.least[self.query])))
        if len(self.query) > self.room:
            self.trim()

    def trim(self) -> None:
        """Leaves K rows a query, in order. Code points are in the order of their bytes."""
        place = np.unique(self.id, return_inverse=True)[1] if len(self.id) else np.zeros(0, np.int64)
        self.pick(np.lexsort((place, -self.score, self.query)))
        self.pick(np.flatnonzero(np.arange(len(self.query)) - np.searchsorted(self.query, self.query) < self.k))


def local_topk(ids: np.ndarray, queries: np.ndarray, k: int, strategy: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = Kept(len(ids), k), max(1, min(4096, SCORES // len(ids)))
        q = queries.astype(np.float64)
        q_sq = sq_norms(q)
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                names, v = np.array(part.column("id").to_pylist(), object), list_matrix(part.column("values"))
                if strategy != "arrow_exact":
                    scores = score_block(strategy, v, queries).T
                    query, row = np.nonzero(~(scores < kept.floor(scores)[:, None]))
                    kept.add(query, scores[query, row], names[row])
                    continue
                v = v.astype(np.float64)
                v_sq = sq_norms(v)
                near = near_scores(v, v_sq, q, q_sq)
                query, row = np.nonzero(~(near < kept.floor(near)[:, None]))
                for at in range(0, len(row), PAIRS):
                    i, j = row[at : at + PAIRS], query[at : at + PAIRS]
                    kept.add(j, pair_scores(v[i], v_sq[i], q[j], q_sq[j]), names[i])
        kept.trim()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[kept.query], pa.int64()), pa.array(kept.id.tolist(), pa.string()), pa.array(kept.score, pa.float32())],
            ["query_id", "id", "score"],
        )

    return run


def topk_batch(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    strategy: str = "arrow_exact",
    id_col: str = "id",
    vector_col: str = "values",
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """(query_id, rank, id, score): the K best rows for each row of queries (query_id, qvalues)."""
    strategy = check_strategy(strategy)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("values"))
    found = None
    if k > 0:
        for ids, block in query_blocks(queries, block_bytes):
            if strategy == "sql":
                part = sql_scores(rows, ids, block)
            else:
                part = rows.mapInArrow(local_topk(ids, block, k, strategy), RESULT)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def sql_scores(rows: DataFrame, ids: np.ndarray, block: np.ndarray) -> DataFrame:
    """Every vector against a block of queries, which is broadcast: its size is bounded."""
    spark = rows.sparkSession
    q = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, block, strict=True)], "query_id long, qvalues array<float>")
    q = q.withColumn("q_sq", sq_norm(F.col("qvalues")))
    v = rows.withColumn("v_sq", sq_norm(F.col("values")))
    both = v.crossJoin(F.broadcast(q))
    return both.select("query_id", "id", cosine(F.col("values"), F.col("qvalues"), F.col("v_sq"), F.col("q_sq")).alias("score"))

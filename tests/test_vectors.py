"""Scores, Top-K, the index facade and its errors."""

import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiverlake.functions import vectors as V
from quiverlake.operators import metrics
from quiverlake.operators.index import VectorIndex, available_backends
from quiverlake.operators.search import exact_scores, topk, topk_batch
from quiverlake.sources.datagen import grid_vectors, run_order

SCHEMA = "ord long, id string, values array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, name, [float(x) for x in v]) for i, (name, v) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [((1, 0), (1, 0), 1), ((1, 0), (0, 1), 0), ((1, 0), (-1, 0), -1), ((1, 2, 3), (4, 5, 6), 0.9746318), ((0, 0), (1, 2), 0), ((0, 0), (0, 0), 0)],
)
def test_cosine(spark, a, b, expected):
    rows = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert rows.select(V.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(expected, abs=1e-6)


def search(spark, rows, q, k, strategy="sql"):
    return [(r["id"], r["score"]) for r in topk(table(spark, rows), q, k, strategy).collect()]


@pytest.mark.parametrize("strategy", ["sql", "arrow_exact", "arrow", "arrow_fp32", "arrow_naive_fp32"])
def test_order_ties_zero_rows_and_large_k(spark, strategy):
    rows = [("opposite", (-1, 0)), ("zero", (0, 0)), ("b", (1, 1)), ("a", (1, 1)), ("exact", (1, 0))]
    found = search(spark, rows, [1.0, 0.0], 10, strategy)
    assert [n for n, _ in found] == ["exact", "a", "b", "zero", "opposite"]
    assert dict(found)["zero"] == 0
    assert search(spark, rows, [1.0, 0.0], 0, strategy) == []


def test_ids_compare_as_bytes(spark):
    rows = [(str(i), np.ones(8)) for i in range(12, -1, -1)] + [("向量", np.ones(8)), ("", np.ones(8)), ("nul\0id", np.ones(8))]
    assert [n for n, _ in search(spark, rows, [0.0] * 8, 5)] == ["", "0", "1", "10", "11"]
    assert [n for n, _ in search(spark, rows, [1.0] * 8, 100)] == sorted((n for n, _ in rows), key=str.encode)


@pytest.mark.parametrize("dimension", [1, 3, 17, 128])
def test_strategies_agree_on_grid_vectors(spark, dimension):
    data = grid_vectors(64 + 6, dimension)
    rows = table(spark, [(f"v{i}", v) for i, v in enumerate(data[:64])] + [("zero", np.zeros(dimension))])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([np.zeros(dimension, np.float32), *data[64:]])], "query_id long, qvalues array<float>")
    read = lambda s: {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk_batch(rows, queries, 10, s).collect()}
    exact = read("sql")
    assert len(exact) == 70 and read("arrow_exact") == exact
    for strategy, tolerance in (("arrow", 1e-6), ("arrow_fp32", 1e-5), ("arrow_naive_fp32", 1e-5)):
        found = read(strategy)
        assert all(abs(found[k][1] - exact[k][1]) <= tolerance for k in exact)


def test_extreme_components():
    top, least = np.finfo(np.float32).max, np.float32(1e-45)
    v = np.array([[top, -top, 0], [least, least, least], [0, 0, 0]], np.float32)
    assert exact_scores(v, v).diagonal().tolist() == [1, 1, 0]


def test_sums_in_four_byte_floats():
    a, b = grid_vectors(2, 300)
    dot = norm = np.float32(0)
    for x, y in zip(a, b, strict=True):
        dot, norm = np.float32(dot + x * y), np.float32(norm + x * x)
    q = sum(float(y) ** 2 for y in b)
    assert exact_scores(a[None], b[None], np.float32)[0, 0] == np.float32(float(dot) / np.sqrt(float(norm) * q))


def test_table_function(spark):
    V.register(spark)
    data = grid_vectors(40, 5)
    rows = [(f"v{i}", v) for i, v in enumerate(data[:39])] + [("zero", np.zeros(5))]
    table(spark, rows).unionByName(spark.createDataFrame([(40, None, [1.0] * 5), (41, "none", None)], SCHEMA)).createOrReplaceTempView("udtf_rows")
    q = data[39].tolist()
    asked = f"array({', '.join(map(repr, q))})"
    for k in (0, 3, 100):
        found = spark.sql(f"SELECT id, score FROM vec_topk(TABLE(udtf_rows), {asked}, {k}) ORDER BY score DESC, id LIMIT {k}").collect()
        assert [(r["id"], r["score"]) for r in found] == search(spark, rows, q, k)
    whole = spark.sql(f"SELECT id, score FROM vec_topk(TABLE(udtf_rows) WITH SINGLE PARTITION, {asked}, 3)").collect()
    assert [(r["id"], r["score"]) for r in whole] == search(spark, rows, q, 3)
    parts = "TABLE(SELECT id, values, ord % 4 AS part FROM udtf_rows) PARTITION BY (part)"
    found = spark.sql(f"SELECT id, score FROM vec_topk({parts}, {asked}, 3) ORDER BY score DESC, id").collect()
    assert len(found) == 12 and [(r["id"], r["score"]) for r in found[:3]] == search(spark, rows, q, 3)


def test_a_stale_snapshot_is_replaced_by_the_next_search(spark):
    index = VectorIndex(spark, 2)
    index.add("a", [1, 0])
    index.build_index()
    old = index._snapshot
    index.add("b", [0, 1])
    assert index._snapshot is old
    assert [r["id"] for r in index.search([0, 1], 1)] == ["b"]
    assert index._snapshot is not old and index._snapshot.count() == 2 and not old.is_cached


def test_bits_of_floats_and_half_floats(spark):
    rows = spark.createDataFrame([([1.0, -2.0, 0.0],), (None,)], "a array<float>")
    assert [r[0] for r in rows.select(V.float_bits("a")).collect()] == [[0x3F800000, 0xC0000000, 0], None]
    half = V.as_vector(np.array([0.5, -2, 65504], np.float16), 3)
    assert half.dtype == np.float32 and half.tolist() == [0.5, -2, 65504]


def test_largest_score_error_and_overlap(spark):
    schema = "query_id long, rank int, score float"
    a, b = (spark.createDataFrame([(0, 1, x), (0, 2, 0.5)], schema) for x in (0.75, 1.0))
    assert metrics.max_score_error(a, b).first()[0] == 0.25
    data = table(spark, [("a", (1, 0)), ("b", (0, 1)), ("c", (0, 1))])
    assert metrics.overlap(data, data.where("id = 'b'")).first()[0] == 2


def test_batches_of_queries_go_in_blocks(spark):
    data = grid_vectors(30, 4)
    rows = table(spark, [(str(i), v) for i, v in enumerate(data)])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "query_id long, qvalues array<float>")
    one = topk_batch(rows, queries, 3).collect()
    assert sorted(one) == sorted(topk_batch(rows, queries, 3, block_bytes=100).collect()) and len(one) == 90


def test_index_accepts_rows_and_rejects_bad_ones(spark):
    index = VectorIndex(spark, 2)
    index.add("west", [-1, 0])
    index.add("b", array.array("f", [1, 1]))
    index.add("a", np.array([1, 1], ">f4"))
    index.add("east", np.array([9, 0, 1, 0, 0, 0])[2::2][:2])
    index.add("north", range(2))
    for bad, kind in (([1], ValueError), ([1, float("nan")], ValueError), ("ab", TypeError), (None, TypeError), (7, TypeError), ({1, 2}, TypeError), ([[1, 2]], TypeError), (np.zeros((1, 2)), ValueError)):
        with pytest.raises(kind):
            index.add("new", bad)
    with pytest.raises(ValueError):
        index.add("a", [0, 1])
    with pytest.raises(TypeError):
        index.add(3, [0, 1])
    assert index.size() == 5
    assert [r["id"] for r in index.search([1, 0], 4)] == ["east", "a", "b", "north"]
    assert index.get("west").tolist() == [-1, 0]
    with pytest.raises(KeyError):
        index.get("none")
    more = table(spark, [("x", (1, 0)), ("y", (0, 1))])
    index.add_dataframe(more, order_col="ord")
    assert [r["id"] for r in index.scan().collect()] == ["west", "b", "a", "east", "north", "x", "y"]
    for rows in ([("x", (1, 0))], [("p", (1, 0)), ("p", (1, 0))], [("p", (1, 0, 0))], [("p", (1, float("inf")))]):
        with pytest.raises(ValueError):
            index.add_dataframe(table(spark, rows))
    assert index.size() == 7 and index.rows().count() == 7
    index.build_index()
    assert index.search_profiled([1, 0], 1).results[0]["id"] == "east"
    index.add("later", [2, 0])
    assert len(index.search([1, 0], 100)) == 8


def test_construction_errors(spark):
    for options, kind in (({"dimension": 0}, ValueError), ({"dimension": 2, "threads": 0}, ValueError), ({"dimension": 2, "backend": "no"}, ValueError), ({"dimension": 2, "backend": "cuda"}, RuntimeError)):
        with pytest.raises(kind):
            VectorIndex(spark, **options)
    assert available_backends()[:2] == ["scalar", "multithreaded_scalar"]
    with pytest.raises(ValueError):
        VectorIndex(spark, 2, backend="arrow_fp32").add("a", [1e-30, 1])


def test_own_strategy(spark):
    index = VectorIndex(spark, 2, backend=lambda rows, q, k: rows.select("id", F.lit(0.5).cast("float").alias("score")).orderBy("id").limit(k))
    index.add("b", [1, 0])
    index.add("a", [1, 0])
    assert index.search([1, 0], 1) == [{"id": "a", "score": 0.5}]


def test_hashes():
    assert V.fnv1a([b"a"]) == 0xAF63DC4C8601EC8C
    assert V.fnv_words([np.zeros(1)]) == 0xCBF29CE484222325 * 0x100000001B3 % 2**64
    assert sorted(run_order([1, 2, 3])) == [1, 2, 3]

import struct
import zlib

import numpy as np
import pytest

from quiverlake.operators.index import VectorIndex
from quiverlake.operators.search import topk_batch
from quiverlake.sources import datagen, index_file, matrix
from quiverlake.streaming.search import search_stream


def test_golden_bytes(tmp_path):
    path = str(tmp_path / "one")
    index_file.write(path, 4, 1, [("x", [1.0, -0.0, 1e-45, 3.4028234663852886e38])])
    data = open(path, "rb").read()
    assert len(data) == 61 and struct.unpack("<4I", data[41:57]) == (0x3F800000, 0x80000000, 1, 0x7F7FFFFF)
    assert struct.unpack("<I", data[57:])[0] == zlib.crc32(data[:57])
    for n in range(len(data)):
        open(path, "wb").write(data[:n])
        with pytest.raises(RuntimeError):
            list(index_file.records(path))
    for at in (0, 8, 12, 16, 24, 32, 40, 45, 58, 60):
        open(path, "wb").write(data[:at] + bytes([data[at] ^ 0x7F]) + data[at + 1 :])
        with pytest.raises(RuntimeError):
            list(index_file.records(path))
    open(path, "wb").write(data + b"x")
    with pytest.raises(RuntimeError):
        list(index_file.records(path))


def test_save_and_load(spark, tmp_path):
    index = VectorIndex(spark, 3)
    for name in ("z", "a", "", "nul\0id", "向量"):
        index.add(name, np.arange(3) + len(name))
    path, again = str(tmp_path / "i"), str(tmp_path / "j")
    index.save(path)
    loaded = VectorIndex.load(spark, path)
    assert loaded.search([1, 2, 3], 9) == index.search([1, 2, 3], 9)
    loaded.save(again)
    assert open(path, "rb").read() == open(again, "rb").read()
    with pytest.raises(ValueError):
        VectorIndex.load(spark, path, VectorIndex(spark, 2))
    with pytest.raises(ValueError):
        VectorIndex.load(spark, path, loaded)
    with pytest.raises(RuntimeError):
        VectorIndex.load(spark, str(tmp_path / "none"))
    matrix.register(spark)
    rows = spark.read.format("vector_index").load(path)
    assert [r["id"] for r in rows.orderBy("ord").collect()] == ["z", "a", "", "nul\0id", "向量"]
    rows.orderBy("ord").coalesce(1).write.format("vector_index").option("dimension", 3).mode("append").save(str(tmp_path / "k"))
    assert open(path, "rb").read() == open(tmp_path / "k", "rb").read()
    VectorIndex(spark, 7).save(path)
    assert len(open(path, "rb").read()) == 36 and VectorIndex.load(spark, path).size() == 0
    index_file.write(path, 1, 2, [("a", [1]), ("a", [2])])
    with pytest.raises(RuntimeError):
        VectorIndex.load(spark, path)


def test_matrix_and_truth(spark, tmp_path):
    data, path = datagen.grid_vectors(10, 3), str(tmp_path / "m.f32")
    matrix.write_matrix(path, data)
    matrix.register(spark)
    rows = spark.read.format("f32_matrix").option("dimension", 3).option("part_rows", 4).load(path).orderBy("ord").collect()
    assert np.array_equal(np.array([r["values"] for r in rows], np.float32), data)
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(data)], "id string, values array<float>")
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(2)], "query_id long, qvalues array<float>")
    found = topk_batch(vectors, queries, 3)
    matrix.write_truth(found, str(tmp_path / "t"))
    truth = matrix.read_truth(spark, str(tmp_path / "t"), 3).orderBy("line", "rank").collect()
    assert [r["id"] for r in truth] == [r["id"] for r in found.orderBy("query_id", "rank").collect()]
    matrix.write_metadata(str(tmp_path / "meta"), {"m": path}, rows=10)
    assert matrix.verify_metadata(spark, str(tmp_path / "meta"), {"m": path})["rows"] == 10
    matrix.write_matrix(path, data[:9])
    with pytest.raises(RuntimeError):
        matrix.verify_metadata(spark, str(tmp_path / "meta"), {"m": path})
    (tmp_path / "log").write_text("CONFIG,n=5,d=3\nnoise\nLAYER,layer=0,nodes=5\n")
    assert [(r["kind"], r["fields"]) for r in matrix.parse_log(spark, str(tmp_path / "log")).collect()] == [("CONFIG", {"n": "5", "d": "3"}), ("LAYER", {"layer": "0", "nodes": "5"})]


def test_generated_rows_do_not_depend_on_partitions(spark):
    a = datagen.clustered_vectors(spark, 20, 5, 3)
    assert sorted(a.collect()) == sorted(a.repartition(3).collect())
    norms = [np.linalg.norm(r["values"]) for r in a.collect()]
    assert np.allclose(norms, 1, atol=1e-6)
    assert np.abs([r["values"] for r in datagen.uniform_vectors(spark, 20, 5).collect()]).max() <= 1


def test_stream_of_queries(spark, tmp_path):
    data = datagen.grid_vectors(20, 4)
    vectors = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(data)], "id string, values array<float>")
    queries = spark.createDataFrame([(i, data[i].tolist()) for i in range(5)], "query_id long, qvalues array<float>")
    queries.write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "q"))
    search_stream(vectors, stream, 3, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("query_id", "rank", "id", "score")
    assert sorted(found.collect()) == sorted(topk_batch(vectors, queries, 3).collect())

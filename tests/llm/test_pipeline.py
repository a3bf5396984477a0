"""The stages of the pipeline, each judged on its own input, and the registered queries' SQL."""

import os

import duckdb
import pytest

import corpus_pipeline
from quiverlake.llm import registry
from quiverlake.llm.decontamination import words_of

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name == "packing":
            lengths = {}
            for r in rows:
                lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
                assert lengths.keys() <= before.keys() and r["length"] * 4 == len(r["ids"])
            assert lengths == {r["doc_id"]: r["doc_tokens"] for r in rows} and lengths.keys() == before.keys()
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in rows}
        assert after.keys() <= before.keys()
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "near_duplicates":
            assert len({r["text"] for r in rows}) == len(rows)
        if name == "repeated_passages":
            assert after.keys() == before.keys() and all(r["n_chars"] == len(r["text"]) for r in rows)
            seen = set()
            for i in sorted(after):
                b = after[i]["text"].encode()
                windows = {b[j : j + 50] for j in range(len(b) - 49)} if after[i]["text"] == before[i]["text"] else set()
                assert not windows & seen
                seen |= windows
        elif name != "packing":
            assert all(before[i] == r for i, r in after.items())
        if name == "benchmark_passages":
            items = [words_of(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
            hit = {i for i, r in before.items() for w in [words_of(r["text"])] if any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))}
            assert after.keys() == before.keys() - hit
        before = after


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    found, expected = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    read = lambda x: sorted(map(repr, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).itertuples(index=False, name=None)))
    assert sorted(found.columns) == sorted(expected.columns) and read(found) == read(expected)


def test_language_accuracy_held_out(spark):
    found = registry.queries()["op5_language_id"](spark, DATA)
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = found.where("held_out").join(truth, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)

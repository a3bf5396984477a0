import pytest

from quiverlake.plans import benchmarks
from quiverlake.sources import matrix


@pytest.mark.parametrize(
    "bad",
    [
        [],
        ["exact", "--vectors", "0"],
        ["exact", "--threads", "2,2"],
        ["hnsw", "--ef-search", "40,40"],
        ["hnsw", "--ef-search", "0"],
        ["hnsw", "--preset", "small"],
        ["hnsw", "--dataset", "random"],
        ["diagnose", "--vectors", "9"],
        ["diagnose", "--dataset", "other"],
        ["grid", "--workers", "4"],
        ["grid", "--vectors", "100001"],
    ],
)
def test_options_that_are_not_allowed(bad):
    with pytest.raises(SystemExit):
        benchmarks.parse(bad)


def test_graph_settings_are_checked():
    with pytest.raises(ValueError):
        benchmarks.parse(["hnsw", "--m", "16", "--ef-construction", "8"])


def test_explicit_options_win_over_the_preset():
    found = benchmarks.parse(["hnsw", "--dimension", "32", "--preset", "large", "--ef-search=7"])
    assert (found.vectors, found.dimension, found.top_k, found.ef_search) == (1_000_000, 32, 10, [7])


def test_exact_rows_and_csv(spark, tmp_path):
    args = "exact --vectors 60 --dimension 8 --queries 2 --top-k 5 --warmups 0 --strategies sql,arrow --threads 1,2".split()
    rows = benchmarks.main([*args, "--output", str(tmp_path / "runs")], spark)
    assert [r["backend"] for r in rows] == ["sql/1", "sql/2", "arrow/1", "arrow/2"]
    assert {r["Recall@K"] for r in rows} == {1.0} and len({r["id_checksum"] for r in rows}) == 1
    read = spark.read.csv(str(tmp_path / "runs"), header=True)
    assert tuple(read.columns) == benchmarks.COLUMNS and read.count() == 4


def test_diagnosis_exports_what_the_benchmark_reads(spark, tmp_path):
    prefix = str(tmp_path / "set")
    args = f"diagnose --dataset clustered --clusters 4 --vectors 80 --dimension 8 --queries 3 --m 4 --ef-construction 20 --export-prefix {prefix}"
    benchmarks.main([*args.split(), "--output", str(tmp_path / "log")], spark)
    log = {}
    for r in matrix.parse_log(spark, str(tmp_path / "log")).collect():
        log.setdefault(r["kind"], []).append(r["fields"])
    base = [f for f in log["LAYER"] if f["layer"] == "0"]
    assert sum(int(f["nodes"]) for f in base) == sum(int(f["reachable"]) for f in base) == 80
    assert {f["n"] for f in log["VIOLATION"]} == {"0"}
    assert [f["ef_search"] for f in log["SEARCH"]] == ["40", "80", "160", "320"] and log["SEARCH"][1]["recall"] == "1.0"

    rows = benchmarks.main(f"hnsw --input-prefix {prefix} --dimension 8 --m 4 --ef-construction 20 --top-k 5 --ef-search 10,80 --warmups 0".split(), spark)
    assert [(r["backend"], r["efSearch"], r["effective_ef"]) for r in rows] == [("scalar", 0, 80), ("hnsw", 10, 10), ("hnsw", 80, 80)]
    assert rows[2]["Recall@K"] == 1.0 and rows[2]["id_checksum"] == rows[0]["id_checksum"]

    with open(f"{prefix}.queries.f32", "r+b") as f:
        f.write(b"\x01")
    with pytest.raises(RuntimeError):
        benchmarks.imported(spark, prefix)


def test_grid(spark, monkeypatch):
    monkeypatch.setattr(benchmarks, "GRID", {"dataset": ["random"], "m": [4, 6], "ef_construction": [20]})
    monkeypatch.setattr(benchmarks, "BREADTHS", [40])
    rows = benchmarks.main("grid --vectors 30 --dimension 4 --queries 2 --workers 2".split(), spark)
    assert [(r["m"], r["ef_search"], r["recall"]) for r in rows] == [(4, 40, 1.0), (6, 40, 1.0)]

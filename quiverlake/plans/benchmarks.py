"""Command lines that measure the vector engine: `python -m quiverlake.plans.benchmarks KIND --option value ...`.

`exact` times the exact strategies, `hnsw` the graphs at several breadths against exact results, `diagnose`
audits one graph, and `grid` runs `diagnose` over a grid of settings. Each returns its rows, prints them
as CSV (`diagnose`: as log lines that sources.matrix.parse_log reads) and stores them with --output.
"""

from __future__ import annotations

import argparse
import math
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from statistics import mean, median

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quiverlake.functions.vectors import fnv1a
from quiverlake.operators import hnsw, metrics
from quiverlake.operators.index import memory_usage
from quiverlake.operators.search import STRATEGIES, topk, topk_batch
from quiverlake.sources import matrix
from quiverlake.sources.datagen import clustered_vectors, parameter_grid, run_order, uniform_vectors

#: The columns of the benchmark's CSV, the large preset, and the grid.
COLUMNS = (
    "backend", "efSearch", "effective_ef", "build_ms", "mean_ms", "median_ms", "p95_ms", "QPS", "Recall@K", "rss_before_build_bytes",
    "rss_after_build_bytes", "rss_after_queries_bytes", "process_peak_rss_bytes", "gpu_database_bytes", "score_checksum", "id_checksum",
)
LARGE = {"vectors": 1_000_000, "dimension": 768, "top_k": 10, "ef_search": [40, 80, 160, 320]}
GRID = {"dataset": ["random", "clustered"], "m": [16, 32, 48], "ef_construction": [100, 200, 400]}
BREADTHS = [40, 80, 160, 320]


def positive(text: str) -> int:
    if (n := int(text)) <= 0:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def natural(text: str) -> int:
    if (n := int(text)) < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def distinct(kind: Callable[[str], object]) -> Callable[[str], list]:
    """The type of a comma-separated option that names nothing twice."""

    def read(text: str) -> list:
        found = [kind(x) for x in text.split(",")]
        if len(set(found)) != len(found):
            raise argparse.ArgumentTypeError("names a value twice")
        return found

    return read


def parser() -> argparse.ArgumentParser:
    """Every number is checked; an explicit option wins over --preset wherever it stands."""
    top = argparse.ArgumentParser(prog="quiverlake.plans.benchmarks", allow_abbrev=False)
    kinds = top.add_subparsers(dest="kind", required=True)
    kind = {}
    for name in ("exact", "hnsw", "diagnose", "grid"):
        p = kind[name] = kinds.add_parser(name, allow_abbrev=False)
        p.add_argument("--vectors", type=positive, default=10_000)
        p.add_argument("--dimension", type=positive, default=128)
        p.add_argument("--queries", type=positive, default=100)
        p.add_argument("--output", help="folder for the rows as CSV")
        if name != "grid":
            p.add_argument("--seed", type=natural, default=42)
    for name in ("exact", "hnsw"):
        kind[name].add_argument("--top-k", type=positive, default=10)
        kind[name].add_argument("--warmups", type=natural, default=1)
        kind[name].add_argument("--repetitions", type=positive, default=1)
    kind["exact"].add_argument("--threads", type=distinct(positive), default=[1])
    kind["exact"].add_argument("--strategies", type=distinct(str), default=list(STRATEGIES))
    kind["hnsw"].add_argument("--ef-search", type=distinct(positive), default=[50])
    kind["hnsw"].add_argument("--input-prefix", help="reads the files that diagnose --export-prefix wrote, once their checksums agree")
    kind["hnsw"].add_argument("--preset", choices=["large"])
    for name in ("hnsw", "diagnose"):
        kind[name].add_argument("--m", type=positive, default=16)
        kind[name].add_argument("--ef-construction", type=positive, default=200)
    for name in ("diagnose", "grid"):
        kind[name].add_argument("--clusters", type=positive, default=100)
    kind["diagnose"].add_argument("--dataset", choices=["random", "clustered"], default="random")
    kind["diagnose"].add_argument("--export-prefix")
    kind["grid"].add_argument("--workers", type=int, choices=(1, 2, 3), default=3)
    return top


def parse(args: list[str]) -> argparse.Namespace:
    top = parser()
    options = top.parse_args(args)
    if getattr(options, "preset", None):
        given = {a.split("=")[0].lstrip("-").replace("-", "_") for a in args if a.startswith("--")}
        vars(options).update({name: value for name, value in LARGE.items() if name not in given})
    if options.kind in ("diagnose", "grid") and options.vectors < 10:
        top.error("Recall@10 needs at least 10 vectors")
    if options.kind == "grid" and options.vectors > 100_000:
        top.error("the grid takes at most 100000 vectors")
    if options.kind in ("hnsw", "diagnose"):
        hnsw.HnswConfig(options.dimension, options.m, options.ef_construction)
    return options


@dataclass
class Data:
    vectors: DataFrame
    queries: DataFrame
    size: int


def generated(spark: SparkSession, options: argparse.Namespace, dataset: str = "random") -> Data:
    """Vectors and queries, stored once under the shared folder."""

    def make(count: int, seed: int) -> DataFrame:
        if dataset == "clustered":
            return clustered_vectors(spark, count, options.dimension, options.clusters, seed)
        return uniform_vectors(spark, count, options.dimension, seed)

    seed = getattr(options, "seed", 42)
    if dataset == "clustered":  # queries share the centres: they are the rows after the vectors
        rows = hnsw.stored(make(options.vectors + options.queries, seed))
        vectors, queries = rows.where(rows["ord"] < options.vectors), rows.where(rows["ord"] >= options.vectors)
    else:
        vectors, queries = hnsw.stored(make(options.vectors, seed)), hnsw.stored(make(options.queries, seed + 1))
    return Data(vectors, queries.selectExpr(f"ord - {options.vectors if dataset == 'clustered' else 0} as query_id", "values as qvalues"), options.vectors)


def files(prefix: str) -> dict[str, str]:
    return {name: f"{prefix}.{name}.f32" for name in ("vectors", "queries")}


def export(data: Data, prefix: str, **fields: object) -> None:
    """Both matrices and metadata with their checksums. The driver holds them, so only for small sets."""
    of = {"vectors": data.vectors.orderBy("ord").select("values"), "queries": data.queries.orderBy("query_id").select("qvalues")}
    for name, path in files(prefix).items():
        matrix.write_matrix(path, np.array([r[0] for r in of[name].collect()], np.float32))
    matrix.write_metadata(f"{prefix}.json", files(prefix), **fields)


def imported(spark: SparkSession, prefix: str) -> tuple[Data, int]:
    """What export() wrote, and the dimension; RuntimeError if a checksum differs."""
    matrix.register(spark)
    about = matrix.verify_metadata(spark, f"{prefix}.json", files(prefix))
    read = {n: spark.read.format("f32_matrix").option("dimension", about["dimension"]).load(p) for n, p in files(prefix).items()}
    vectors = hnsw.stored(read["vectors"].selectExpr("ord", "string(ord) as id", "values"))
    return Data(vectors, hnsw.stored(read["queries"].selectExpr("ord as query_id", "values as qvalues")), vectors.count()), about["dimension"]


def timed(search: Callable[[list[float]], DataFrame], data: Data, warmups: int, repetitions: int) -> tuple[list[float], DataFrame]:
    """Milliseconds of each single search, and the results (query_id, rank, id, score) of the last pass."""
    spark = data.vectors.sparkSession
    asked = [(r["query_id"], list(r["qvalues"])) for r in data.queries.orderBy("query_id").collect()]
    took, rows = [], []
    for turn in range(warmups + repetitions):
        rows = []
        for query_id, values in asked:
            start = time.perf_counter()
            found = search(values).collect()
            if turn >= warmups:
                took.append(1000 * (time.perf_counter() - start))
            rows += [(query_id, n, r["id"], r["score"]) for n, r in enumerate(found, 1)]
    return took, spark.createDataFrame(rows, "query_id long, rank int, id string, score float")


def measured(name: str, ef: int, search: Callable, data: Data, truth: DataFrame, k: int, options: argparse.Namespace, build_ms: float, before: dict, built: dict) -> dict:
    """A row of the CSV. Results with a wrong number, order, id or score raise RuntimeError."""
    took, found = timed(search, data, options.warmups, options.repetitions)
    if bad := metrics.validate_results(found, data.vectors, k, data.size).where("n > 0").collect():
        raise RuntimeError(f"{name} gave wrong results: {bad}")
    memory, size = memory_usage(), min(k, data.size)
    ids = [r["id"].encode() for r in found.orderBy("query_id", "rank").collect()]
    values = (
        name, ef, min(data.size, max(size, ef)) if ef else data.size, build_ms, mean(took), median(took), sorted(took)[math.ceil(0.95 * len(took)) - 1],
        1000 / mean(took), metrics.recall(found, truth, k).agg({"recall": "avg"}).first()[0], before["resident"], built["resident"],
        memory["resident"], memory["peak"], 0, metrics.score_checksum(found).first()[0], f"{fnv1a(ids):d}",
    )
    return dict(zip(COLUMNS, values, strict=True))


def run_exact(spark: SparkSession, options: argparse.Namespace) -> list[dict]:
    data, k = generated(spark, options), options.top_k
    truth = hnsw.stored(topk_batch(data.vectors, data.queries, k, "arrow_exact"))
    rows = []
    for strategy in options.strategies:
        for threads in options.threads:
            before = memory_usage()
            table = data.vectors.coalesce(threads)
            rows.append(measured(f"{strategy}/{threads}", 0, lambda q, t=table, s=strategy: topk(t, q, k, s), data, truth, k, options, 0.0, before, memory_usage()))
    return rows


def run_hnsw(spark: SparkSession, options: argparse.Namespace) -> list[dict]:
    data, dimension = imported(spark, options.input_prefix) if options.input_prefix else (generated(spark, options), options.dimension)
    k = options.top_k
    truth = hnsw.stored(topk_batch(data.vectors, data.queries, k, "arrow_exact"))
    before = memory_usage()
    rows = [measured("scalar", 0, lambda q: topk(data.vectors, q, k, "sql"), data, truth, k, options, 0.0, before, before)]
    before, start = memory_usage(), time.perf_counter()
    index = hnsw.HnswIndex.from_dataframe(data.vectors, hnsw.HnswConfig(dimension, options.m, options.ef_construction, seed=options.seed))
    build_ms, built = 1000 * (time.perf_counter() - start), memory_usage()
    for ef in options.ef_search:
        rows.append(measured("hnsw", ef, lambda q, e=ef: index.search(q, k, e), data, truth, k, options, build_ms, before, built))
    return rows


def run_diagnose(spark: SparkSession, options: argparse.Namespace) -> list[str]:
    """Log lines of one graph: BUILD, LAYER (with the nodes in reach), VIOLATION, GRAPH and SEARCH."""
    data = generated(spark, options, options.dataset)
    if options.export_prefix:
        export(data, options.export_prefix, dimension=options.dimension, dataset=options.dataset, seed=options.seed)
    start = time.perf_counter()
    index = hnsw.HnswIndex.from_dataframe(data.vectors, hnsw.HnswConfig(options.dimension, options.m, options.ef_construction, seed=options.seed))
    said: list[tuple[str, dict]] = [("BUILD", {"dataset": options.dataset, "m": options.m, "ef_construction": options.ef_construction, "build_ms": round(1000 * (time.perf_counter() - start), 3)})]
    layers = hnsw.audit_layers(index.nodes).orderBy("shard", "layer").collect()
    reach = {layer: {r["shard"]: r["reachable"] for r in hnsw.reachable(index.nodes, layer).collect()} for layer in {r["layer"] for r in layers}}
    said += [("LAYER", r.asDict() | {"reachable": reach[r["layer"]].get(r["shard"], 0)}) for r in layers]
    said += [("VIOLATION", r.asDict()) for r in hnsw.audit_violations(index.nodes, options.m).collect()]
    said.append(("GRAPH", hnsw.reciprocal_fraction(index.nodes).first().asDict()))
    truth = hnsw.stored(topk_batch(data.vectors, data.queries, 10, "arrow_exact"))
    for ef in BREADTHS:
        start = time.perf_counter()
        found = hnsw.stored(index.search_batch(data.queries, 10, ef))
        took = 1000 * (time.perf_counter() - start) / options.queries
        said.append(("SEARCH", {"ef_search": ef, "recall": metrics.recall(found, truth, 10).agg({"recall": "avg"}).first()[0], "mean_ms": round(took, 3)}))
    return [",".join([kind, *(f"{name}={value}" for name, value in fields.items())]) for kind, fields in said]


def run_grid(spark: SparkSession, options: argparse.Namespace) -> list[dict]:
    """A row for each setting and breadth; --workers settings run side by side, in a shuffled order."""

    def one(setting: dict) -> list[dict]:
        args = vars(options) | setting | {"seed": 42, "export_prefix": None}
        lines = [line.split(",") for line in run_diagnose(spark, argparse.Namespace(**args))]
        fields = [(kind, dict(x.split("=", 1) for x in rest)) for kind, *rest in lines]
        build_ms = float(fields[0][1]["build_ms"])
        return [
            setting | {"ef_search": int(f["ef_search"]), "recall": float(f["recall"]), "mean_ms": float(f["mean_ms"]), "build_ms": build_ms}
            for kind, f in fields
            if kind == "SEARCH"
        ]

    settings = run_order([r.asDict() for r in parameter_grid(spark, **GRID).orderBy(*GRID).collect()])
    with ThreadPoolExecutor(options.workers) as pool:
        found = [row for rows in pool.map(one, settings) for row in rows]
    return sorted(found, key=lambda r: tuple(r.values())[:4])


RUNS = {"exact": run_exact, "hnsw": run_hnsw, "diagnose": run_diagnose, "grid": run_grid}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> list:
    import sys

    options = parse(sys.argv[1:] if args is None else args)
    spark = spark or SparkSession.builder.appName("quiverlake benchmark").getOrCreate()
    rows = RUNS[options.kind](spark, options)
    if options.kind == "diagnose":
        print("\n".join(rows))
        if options.output:
            spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1).write.mode("overwrite").text(options.output)
    else:
        print(",".join(rows[0]), *(",".join(map(str, r.values())) for r in rows), sep="\n")
        if options.output:
            matrix.write_runs(spark, rows, options.output)
    return rows


if __name__ == "__main__":
    main()

"""Measures of results and of runs, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): the share of the exact Top-K ids that were found; ids alone count, ties get no credit."""
    truth = exact.where(F.col("rank") <= k)
    hits = truth.join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def statistics(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """mean, median (between the middle two), min, max, p95 (nearest rank) and qps (1000 over the mean) of milliseconds."""
    return samples.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"),
        (F.lit(1000.0) / F.avg(value)).alias("qps"),
    )


def speedup(base_ms: Column, ms: Column) -> Column:
    return base_ms / ms


def score_checksum(results: DataFrame) -> DataFrame:
    """(score_checksum): sum of scores as doubles; compare with a tolerance."""
    return results.agg(F.sum(F.col("score").cast("double")).alias("score_checksum"))


def max_score_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """(max_error) over equal ranks of equal queries."""
    other = b.select("query_id", "rank", F.col("score").alias("other"))
    return a.join(other, ["query_id", "rank"]).agg(F.max(F.abs(F.col("score").cast("double") - F.col("other").cast("double"))).alias("max_error"))


def score_geometry(results: DataFrame) -> DataFrame:
    """(mean_top1, mean_top10, mean_gap): mean best score, mean of each query's ten best, mean of their difference."""
    each = results.where("rank <= 10").groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score").cast("double"))).alias("top1"), F.avg(F.col("score").cast("double")).alias("top10")
    )
    return each.agg(F.avg("top1").alias("mean_top1"), F.avg("top10").alias("mean_top10"), F.avg(F.col("top1") - F.col("top10")).alias("mean_gap"))


def same_label_fraction(results: DataFrame, labels: DataFrame, query_labels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, same_label): the share of the Top-K with the query's label. labels: (id, label), query_labels: (query_id, query_label)."""
    joined = results.where(F.col("rank") <= k).join(labels, "id").join(query_labels, "query_id")
    return joined.groupBy("query_id").agg(F.avg((F.col("label") == F.col("query_label")).cast("double")).alias("same_label"))


def validate_results(results: DataFrame, ids: DataFrame, k: int, size: int) -> DataFrame:
    """(violation, n): queries with a wrong number of rows, repeated ids, scores not finite, rows out of order, unknown ids."""
    order = Window.partitionBy("query_id").orderBy("rank")
    before = results.withColumn("ps", F.lag("score").over(order)).withColumn("pi", F.lag("id").over(order))
    kinds = {
        "count": results.groupBy("query_id").count().where(F.col("count") != min(k, size)),
        "repeated": results.groupBy("query_id", "id").count().where("count > 1"),
        "finite": results.where(F.isnan("score") | (F.abs("score") == float("inf"))),
        "order": before.where((F.col("ps") < F.col("score")) | ((F.col("ps") == F.col("score")) & (F.col("pi") >= F.col("id")))),
        "unknown": results.join(ids.select("id"), "id", "left_anti"),
    }
    found = None
    for name, rows in kinds.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        found = part if found is None else found.unionByName(part)
    return found


def rank_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(differences): places at which two results have not the same id and score."""
    other = b.select("query_id", "rank", F.col("id").alias("oid"), F.col("score").alias("oscore"))
    joined = a.join(other, ["query_id", "rank"], "full_outer")
    same = F.col("id").eqNullSafe(F.col("oid")) & F.col("score").eqNullSafe(F.col("oscore"))
    return joined.agg(F.count(F.when(~same, 1)).alias("differences"))


def distinct_rows(vectors: DataFrame) -> DataFrame:
    """(rows, distinct_rows) of vectors by value."""
    return vectors.agg(F.count("*").alias("rows"), F.count_distinct("values").alias("distinct_rows"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(overlap): rows of a whose vector also stands in b."""
    return a.join(b.select("values").distinct(), "values", "left_semi").agg(F.count("*").alias("overlap"))


def grid_pivot(runs: DataFrame, keys: list[str], breadths: list[int], value: str = "recall") -> DataFrame:
    """One row for each setting, one column for each breadth."""
    return runs.groupBy(*keys).pivot("ef_search", breadths).agg(F.first(value))


def consistent_hashes(runs: DataFrame) -> DataFrame:
    """(dataset, consistent): whether all runs over a data set saw the same data and queries."""
    return runs.groupBy("dataset").agg((F.count_distinct("data_hash", "query_hash") == 1).alias("consistent"))

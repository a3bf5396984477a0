"""Approximate Top-K through hierarchical navigable small-world graphs, one graph for each shard.

A shard holds a bounded number of rows and is built in one task, in bulk: candidates come from products
of blocks of vectors. Its graph is a table: a row for each node, with its links on every layer, stored
once under the shared checkpoint folder. A search walks all shards' graphs for a block of queries, and a
window merges their results. With a breadth of all rows every shard is exact, and so is the whole.
Added rows make shards of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quiverlake.functions.vectors import has_dimension, is_finite
from quiverlake.sources.shared import shared_folder, shared_path

from .search import PAIRS, RESULT, SLACK, near_scores, query_blocks

NODES = "shard int, ord long, id string, values array<float>, level int, links array<array<long>>"


@dataclass(frozen=True)
class HnswConfig:
    dimension: int
    M: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42

    def __post_init__(self) -> None:
        if self.dimension <= 0:
            raise ValueError("dimension must be positive")
        if not 2 <= self.M <= (2**64 - 1) // 2:
            raise ValueError("M must be from 2 to half of the largest size")
        if self.ef_construction < self.M:
            raise ValueError("ef_construction must be M or more")
        if self.ef_search <= 0:
            raise ValueError("ef_search must be positive")


class Mersenne64:
    """The 64-bit Mersenne Twister (MT19937-64) in its standard seeding."""

    N, HALF, MASK = 312, 156, (1 << 64) - 1

    def __init__(self, seed: int):
        self.state = [seed & self.MASK]
        for i in range(1, self.N):
            x = self.state[-1]
            self.state.append((6364136223846793005 * (x ^ x >> 62) + i) & self.MASK)
        self.at = self.N

    def refill(self) -> None:
        s, upper, lower = self.state, self.MASK ^ 0x7FFFFFFF, 0x7FFFFFFF
        for i in range(self.N):
            x = s[i] & upper | s[(i + 1) % self.N] & lower
            s[i] = s[(i + self.HALF) % self.N] ^ x >> 1 ^ (0xB5026F5AA96619E9 if x & 1 else 0)
        self.at = 0

    def draw(self) -> int:
        if self.at == self.N:
            self.refill()
        x = self.state[self.at]
        self.at += 1
        x ^= x >> 29 & 0x5555555555555555
        x ^= x << 17 & 0x71D67FFFEDA60000
        x ^= x << 37 & 0xFFF7EEE000000000
        return (x ^ x >> 43) & self.MASK


def layer_levels(count: int, m: int, seed: int) -> list[int]:
    """Top layers of the first `count` nodes: each further layer with probability 1 / m, up to 32."""
    source, reject = Mersenne64(seed), (1 << 64) % m
    found = []
    for _ in range(count):
        level = 0
        while level < 32:
            x = source.draw()
            while x < reject:
                x = source.draw()
            if x % m:
                break
            level += 1
        found.append(level)
    return found


LOW = np.iinfo(np.int64).min


class ShardGraph:
    """One shard's graph: for each layer a matrix of links, a row for each node, filled up with -1.

    Nodes are numbered by order. A node that a query has scored is one number: the score's bits, so
    turned that numbers compare as scores do, then the id's place from the end, then whether the node's
    links are still to be followed. The largest number is the best node, ties by id included.
    """

    def __init__(self, ids: list[str], vectors: np.ndarray, config: HnswConfig, levels: list[int]):
        self.ids, self.config, self.levels = ids, config, np.array(levels, np.int64)
        self.v = vectors.astype(np.float64)
        self.sq = np.add.accumulate(self.v * self.v, axis=1)[:, -1] if len(ids) else np.zeros(0)
        norm = np.sqrt(self.sq)[:, None] if len(ids) else np.ones((0, 1))
        self.unit = np.divide(self.v, norm, out=np.zeros_like(self.v), where=norm > 0)
        self.by_place = np.array(sorted(range(len(ids)), key=lambda i: ids[i].encode()), np.int64)
        self.place = np.argsort(self.by_place)
        self.top = int(self.levels.max()) if len(ids) else 0
        self.entry = int(self.levels.argmax()) if len(ids) else 0
        self.layers: list[np.ndarray] = []

    def cap(self, layer: int) -> int:
        return min(self.config.M * (1 if layer else 2), max(len(self.ids), 2))

    def spread(self, own: np.ndarray, nodes: np.ndarray, limit: int, required: list[int]) -> list[int]:
        """Up to `limit` links of a node with scores `own` to `nodes`: the required ones, then by rank those
        nearer to the node than to any link chosen so far, then the rest by rank."""
        order = np.lexsort((self.place[nodes], -own))
        own, nodes = own[order], nodes[order]
        between = (self.unit[nodes] @ self.unit[nodes].T).astype(np.float32)
        shadowed = np.zeros(len(nodes), bool)
        chosen, spare = list(required), []
        for i in required:
            shadowed |= (self.unit[nodes] @ self.unit[i]).astype(np.float32) >= own
        for k, i in enumerate(nodes.tolist()):
            if len(chosen) >= limit:
                break
            if i in required:
                continue
            if shadowed[k]:
                spare.append(i)
            else:
                chosen.append(i)
                shadowed |= between[k] >= own
        return chosen + spare[: max(0, limit - len(chosen))]

    def connect(self, layer: int, wave: int = 256) -> np.ndarray:
        """The links of one layer, laid in three passes.

        First, waves of nodes are scored against all nodes before them in one product, and each picks up
        to M links among the ef_construction best. Then every link gets its reverse. Last, nodes with more
        links than the cap pick among those once. On the base layer the order itself is a chain of links
        that no pick may drop, so that no node is out of reach, however many vectors are alike.
        """
        members, m, cap = np.flatnonzero(self.levels >= layer), self.config.M, self.cap(layer)
        picked: list[list[int]] = [[] for _ in self.ids]
        for start in range(0, len(members), wave):
            mine = members[start : start + wave]
            scores = (self.unit[mine] @ self.unit[members[: start + len(mine)]].T).astype(np.float32)
            for row, (i, own) in enumerate(zip(mine.tolist(), scores, strict=True)):
                own = own[: start + row]
                best = np.argpartition(-own, self.config.ef_construction)[: self.config.ef_construction] if len(own) > self.config.ef_construction else np.arange(len(own))
                picked[i] = self.spread(own[best], members[best], m, []) if len(best) else []
        both = [set(x) for x in picked]
        for i, links in enumerate(picked):
            for j in links:
                both[j].add(i)
        found = np.full((len(self.ids), cap), -1, np.int32)
        for i in members.tolist():
            chain = [k for k in (i - 1, i + 1) if 0 <= k < len(self.ids)] if layer == 0 else []
            links = [*chain, *sorted(both[i].difference(chain))]
            if len(links) > cap:
                nodes = np.array(links)
                links = self.spread((self.unit[nodes] @ self.unit[i]).astype(np.float32), nodes, cap, chain)
            found[i, : len(links)] = links
        return found

    def numbers(self, q: np.ndarray, q_sq: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Nodes scored by one query each, as numbers. Scores are exact: sums in dimension order."""
        dots = np.add.accumulate(self.v[nodes] * q, axis=1)[:, -1]
        n = self.sq[nodes] * q_sq
        score = np.where(n == 0, 0.0, dots / np.sqrt(np.where(n == 0, 1.0, n))).astype(np.float32)
        return self.ranked(score, nodes)

    def ranked(self, score: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Scores of nodes as numbers."""
        bits = (score + np.float32(0)).view(np.int32).astype(np.int64)
        turned = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)
        return turned << 32 | (len(self.ids) - 1 - self.place[nodes]) << 1 | 1

    def node_of(self, numbers: np.ndarray) -> np.ndarray:
        return self.by_place[len(self.ids) - 1 - (numbers >> 1 & 0x7FFFFFFF)]

    def beam(self, q: np.ndarray, q_sq: np.ndarray, starts: np.ndarray, ef: int, layer: int) -> np.ndarray:
        """For each query the ef best nodes found from its start, as numbers in no order; all queries step together.

        In a step, each query follows the links of the best node that it has not followed yet, and is
        done once its ef best are all followed.
        """
        links, rows = self.layers[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.ids)), bool)
        seen[rows, starts] = True
        kept = np.full((len(q), ef), LOW)
        kept[:, 0] = self.numbers(q, q_sq, starts)
        while True:
            ahead = np.where(kept & 1 > 0, kept, LOW)
            at = ahead.argmax(axis=1)
            busy = np.flatnonzero(ahead[rows, at] != LOW)
            if not len(busy):
                return kept
            now = kept[busy, at[busy]]
            kept[busy, at[busy]] = now & ~1
            to = links[self.node_of(now)]
            fresh = (to >= 0) & ~seen[busy[:, None], to]
            row, column = np.nonzero(fresh)
            if len(row):
                nodes, asks = to[row, column], busy[row]
                seen[asks, nodes] = True
                found = np.full(to.shape, LOW)
                found[row, column] = self.numbers(q[asks], q_sq[asks], nodes)
                kept[busy] = np.partition(np.concatenate([kept[busy], found], axis=1), to.shape[1], axis=1)[:, to.shape[1] :]

    def reach(self, start: int) -> np.ndarray:
        """Which nodes the base layer's links lead to from a node, breadth first."""
        seen, front = np.zeros(len(self.ids), bool), np.array([start])
        while len(front):
            seen[front] = True
            to = self.layers[0][front]
            ahead = np.zeros(len(self.ids), bool)
            ahead[to[to >= 0]] = True
            front = np.flatnonzero(ahead & ~seen)
        return seen

    def chained(self) -> bool:
        """Whether each node links to its neighbours by order on the base layer: then all nodes are in reach of any."""
        base, nodes = self.layers[0], np.arange(len(self.ids))[:, None]
        return bool((base[:-1] == nodes[1:]).any(axis=1).all() and (base[1:] == nodes[:-1]).any(axis=1).all())

    def whole(self, q: np.ndarray, q_sq: np.ndarray, starts: np.ndarray, count: int, cells: int = 1 << 20) -> np.ndarray:
        """The `count` best of what beam() finds on the base layer with a breadth of all nodes, in no order.

        With that breadth no node is ever pushed out, so a walk ends with every node in reach of its
        start, whatever the query: the links are followed once for each start, and all nodes in reach are
        scored together, `cells` at a time. A matrix product says which can be among the best; these are
        scored exactly.
        """
        step, best = max(1, cells // len(self.ids)), np.full((len(q), count), LOW)
        for start in np.unique(starts).tolist():
            nodes, rows = np.flatnonzero(self.reach(start)), np.flatnonzero(starts == start)
            v, v_sq, at = self.v[nodes], self.sq[nodes], max(0, len(nodes) - count)
            for first in range(0, len(rows), step):
                mine = rows[first : first + step]
                near = near_scores(v, v_sq, q[mine], q_sq[mine])
                row, column = np.nonzero(~(near < np.partition(near, at, axis=1)[:, at, None] - 2 * SLACK))
                found = np.empty(len(row), np.int64)
                for k in range(0, len(row), PAIRS):
                    asks = mine[row[k : k + PAIRS]]
                    found[k : k + PAIRS] = self.numbers(q[asks], q_sq[asks], nodes[column[k : k + PAIRS]])
                order = np.lexsort((-found, row))
                row, found = row[order], found[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                top = rank < count
                best[mine[row[top]], rank[top]] = found[top]
        return best

    def search(self, queries: np.ndarray, k: int, ef: int, cells: int = 1 << 22) -> Iterator[tuple[int, list[tuple[str, float]]]]:
        """(query's number, [(id, score), ...], best first); `cells` bounds queries at a time times rows."""
        count = min(k, len(self.ids))
        width = min(len(self.ids), max(count, ef))
        step = max(1, cells // max(len(self.ids), 1))
        whole, chained = width == len(self.ids), count > 0 and self.chained()
        for first in range(0, len(queries) if count else 0, step):
            q = np.asarray(queries[first : first + step], np.float32).astype(np.float64)
            q_sq = np.add.accumulate(q * q, axis=1)[:, -1]
            at = np.full(len(q), self.entry)
            for layer in () if whole and chained else range(self.top, 0, -1):
                at = self.node_of(self.beam(q, q_sq, at, 1, layer)[:, 0])
            found = self.whole(q, q_sq, at, count) if whole else self.beam(q, q_sq, at, width, 0)
            best = np.sort(found, axis=1)[:, ::-1][:, :count]
            turned = best >> 32
            scores = np.where(turned < 0, turned ^ 0x7FFFFFFF, turned).astype(np.int32).view(np.float32)
            within = best != LOW  # others are out of reach
            for row, (nodes, own, there) in enumerate(zip(self.node_of(best).tolist(), scores.tolist(), within.tolist(), strict=True)):
                yield first + row, [(self.ids[i], x) for i, x, y in zip(nodes, own, there, strict=True) if y]

    def links(self) -> list[list[list[int]]]:
        """Each node's links by layer."""
        return [[[j for j in self.layers[x][i].tolist() if j >= 0] for x in range(level + 1)] for i, level in enumerate(self.levels.tolist())]

    @classmethod
    def build(cls, ids: list[str], vectors: np.ndarray, config: HnswConfig, seed: int) -> ShardGraph:
        graph = cls(ids, vectors, config, layer_levels(len(ids), config.M, seed))
        graph.layers = [graph.connect(layer) for layer in range(graph.top + 1)]
        return graph

    @classmethod
    def restore(cls, rows: pd.DataFrame, config: HnswConfig) -> ShardGraph:
        rows = rows.sort_values("ord", kind="stable")
        links = rows["links"].tolist()
        graph = cls(rows["id"].tolist(), np.stack(rows["values"].to_list()).astype(np.float32), config, [len(x) - 1 for x in links])
        for layer in range(graph.top + 1):
            found = np.full((len(links), graph.cap(layer)), -1, np.int32)
            for i, own in enumerate(links):
                if len(own) > layer:
                    found[i, : len(own[layer])] = own[layer]
            graph.layers.append(found)
        return graph


def check_rows(vectors: DataFrame, dimension: int) -> None:
    """Raises ValueError for wrong lengths, numbers that are not finite and repeated ids, in this order."""
    bad = vectors.agg(
        F.count(F.when(~has_dimension(F.col("values"), dimension), 1)).alias("size"), F.count(F.when(~is_finite(F.col("values")), 1)).alias("finite")
    ).first()
    if bad["size"]:
        raise ValueError(f"{bad['size']} vectors do not have {dimension} components")
    if bad["finite"]:
        raise ValueError(f"{bad['finite']} vectors have components that are not finite")
    if vectors.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("vector ID already exists")


def build_graph(vectors: DataFrame, config: HnswConfig, shards: int = 1, first: int = 0) -> DataFrame:
    """The node table of graphs over vectors (ord, id, values), with shards numbered from `first`. One task holds one shard's rows."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable").reset_index(drop=True)
        shard = int(rows["shard"].iloc[0])
        graph = ShardGraph.build(rows["id"].tolist(), np.stack(rows["values"].to_list()).astype(np.float32), config, config.seed + shard)
        return rows.assign(level=graph.levels, links=graph.links())[["shard", "ord", "id", "values", "level", "links"]]

    rows = vectors.select((F.pmod("ord", F.lit(shards)) + first).cast("int").alias("shard"), F.col("ord").cast("long").alias("ord"), "id", "values")
    # a partition for each shard; hashed, several shards would share a task
    return rows.repartitionById(shards, "shard").groupBy("shard").applyInPandas(build, NODES)


def walker(config: HnswConfig, ids: np.ndarray, block: np.ndarray, k: int, ef: int):
    """A function from one shard's rows to its results for a block of queries."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        graph = ShardGraph.restore(rows, config)
        out = [(int(ids[i]), name, score) for i, found in graph.search(block, k, ef) for name, score in found]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "score": "float32"})

    return walk


def stored(nodes: DataFrame) -> DataFrame:
    """The table, written once to the shared checkpoint folder."""
    path = shared_path(nodes.sparkSession, "graph")
    nodes.write.parquet(path)
    return nodes.sparkSession.read.schema(nodes.schema).parquet(path)


class HnswIndex:
    """An approximate index over a table of vectors; immutable but for the default breadth."""

    def __init__(self, nodes: DataFrame, config: HnswConfig, shards: int = 1):
        self.nodes, self.config, self.shards = nodes, config, shards

    @classmethod
    def from_dataframe(cls, vectors: DataFrame, config: HnswConfig, shards: int | None = None, shard_rows: int = 5000) -> HnswIndex:
        """Checks, builds and stores. Without `shards`, one for each shard_rows rows."""
        check_rows(vectors, config.dimension)
        shards = shards or max(1, -(-vectors.count() // shard_rows))
        return cls(stored(build_graph(vectors, config, shards)), config, shards)

    def add(self, vectors: DataFrame, shard_rows: int = 5000) -> HnswIndex:
        """An index with further rows (ord, id, values), in shards of their own; the graphs so far stay as they are."""
        check_rows(vectors, self.config.dimension)
        if not vectors.join(self.nodes.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("vector ID already exists")
        more = max(1, -(-vectors.count() // shard_rows))
        nodes = stored(build_graph(vectors, self.config, more, self.shards))
        return HnswIndex(self.nodes.unionByName(nodes), self.config, self.shards + more)

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: HnswConfig) -> HnswIndex:
        """A saved index; config is the one that it was built with."""
        nodes = spark.read.parquet(path).select(*(F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(NODES)))
        return cls(nodes, config, (nodes.agg(F.max("shard")).first()[0] or 0) + 1)

    def set_ef_search(self, ef: int) -> None:
        if ef <= 0:
            raise ValueError("ef_search must be positive")
        self.config = replace(self.config, ef_search=ef)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").partitionBy("shard").parquet(path)

    def size(self) -> int:
        return self.nodes.count()

    def search_batch(self, queries: DataFrame, k: int, ef_search: int | None = None, block_bytes: int = 1 << 20) -> DataFrame:
        """(query_id, rank, id, score) for queries (query_id, qvalues)."""
        ef = self.config.ef_search if ef_search is None else ef_search
        config = self.config
        bad = queries.agg(
            F.count(F.when(~has_dimension(F.col("qvalues"), config.dimension), 1)).alias("size"), F.count(F.when(~is_finite(F.col("qvalues")), 1)).alias("finite")
        ).first()
        if bad["size"]:
            raise ValueError(f"{bad['size']} queries do not have {config.dimension} components")
        if bad["finite"]:
            raise ValueError(f"{bad['finite']} queries have components that are not finite")
        if ef <= 0:
            raise ValueError("ef_search must be positive")
        found = None
        for ids, block in query_blocks(queries, block_bytes) if k > 0 else ():
            walk = walker(config, ids, block, k, ef)
            part = self.nodes.repartitionById(self.shards, "shard").groupBy("shard").applyInPandas(walk, RESULT)
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.nodes.sparkSession.createDataFrame([], RESULT)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def search(self, query: list[float], k: int, ef_search: int | None = None) -> DataFrame:
        one = self.nodes.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id long, qvalues array<float>")
        return self.search_batch(one, k, ef_search).orderBy("rank").select("id", "score")


def edges(nodes: DataFrame) -> DataFrame:
    """(shard, layer, src, dst, pos): src and dst number the nodes of a shard by insertion."""
    order = Window.partitionBy("shard").orderBy("ord")
    numbered = nodes.withColumn("src", F.row_number().over(order) - 1)
    layers = numbered.select("shard", F.col("src").cast("long").alias("src"), F.posexplode("links").alias("layer", "to"))
    return layers.select("shard", "layer", "src", F.posexplode("to").alias("pos", "dst"))


def audit_layers(nodes: DataFrame) -> DataFrame:
    """(shard, layer, nodes, edges, min_degree, max_degree, mean_degree)."""
    layers = nodes.select("shard", F.posexplode("links").alias("layer", "to")).withColumn("degree", F.size("to").cast("long"))
    return layers.groupBy("shard", "layer").agg(
        F.count("*").alias("nodes"), F.sum("degree").alias("edges"), F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"), F.avg("degree").alias("mean_degree")
    )


def audit_violations(nodes: DataFrame, m: int) -> DataFrame:
    """(violation, n): degree caps, self links, repeated links, links to nodes that lack the layer, gaps in the chain."""
    e = edges(nodes)
    order = Window.partitionBy("shard").orderBy("ord")
    numbered = nodes.withColumn("node", (F.row_number().over(order) - 1).cast("long")).select("shard", "node", "level")
    degree = e.groupBy("shard", "layer", "src").count().where(F.col("count") > F.when(F.col("layer") == 0, 2 * m).otherwise(m))
    absent = e.join(numbered, (e["shard"] == numbered["shard"]) & (e["dst"] == numbered["node"]) & (e["layer"] <= numbered["level"]), "left_anti")
    last = numbered.groupBy("shard").agg(F.max("node").alias("last"))
    chain = numbered.join(last, "shard").select("shard", F.col("node").alias("src"), F.explode(F.filter(F.array(F.col("node") - 1, F.col("node") + 1), lambda x: (x >= 0) & (x <= F.col("last")))).alias("dst"))
    gaps = chain.join(e.where("layer = 0"), ["shard", "src", "dst"], "left_anti")
    kinds = (("degree", degree), ("self", e.where("src = dst")), ("repeated", e.groupBy("shard", "layer", "src", "dst").count().where("count > 1")), ("layer", absent), ("chain", gaps))
    found = None
    for name, rows in kinds:
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        found = part if found is None else found.unionByName(part)
    return found


def reciprocal_fraction(nodes: DataFrame) -> DataFrame:
    """(reciprocal): the share of base links whose reverse is a link too; 1 without links."""
    e = edges(nodes).where("layer = 0").select("shard", "src", "dst")
    back = e.select("shard", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("both"))
    return e.join(back, ["shard", "src", "dst"], "left").agg(F.coalesce(F.avg(F.coalesce("both", F.lit(0)).cast("double")), F.lit(1.0)).alias("reciprocal"))


def reachable(nodes: DataFrame, layer: int = 0, without_chain: bool = False, rounds: int | None = None) -> DataFrame:
    """(shard, reachable): nodes in reach of the entry on a layer, by breadth-first search over the links.

    Goes on until nothing new is in reach; a limit of rounds that ends before raises RuntimeError. Each round is written to the shared checkpoint folder, so plans stay short and survive lost executors.
    """
    spark = nodes.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    e = edges(nodes).where(F.col("layer") == layer).select("shard", "src", "dst")
    if without_chain:
        e = e.where(F.abs(F.col("src") - F.col("dst")) != 1)
    e = e.checkpoint()
    order = Window.partitionBy("shard").orderBy("ord")
    numbered = nodes.withColumn("node", (F.row_number().over(order) - 1).cast("long"))
    entry = numbered.groupBy("shard").agg(F.min_by("node", F.struct(-F.col("level"), F.col("node"))).alias("node"))
    seen = entry.checkpoint()
    front = seen
    done = 0
    while True:
        front = front.withColumnRenamed("node", "src").join(e, ["shard", "src"]).select("shard", F.col("dst").alias("node")).distinct()
        front = front.join(seen, ["shard", "node"], "left_anti").checkpoint()
        if front.isEmpty():
            break
        if done == rounds:
            raise RuntimeError(f"{rounds} rounds did not reach all nodes")
        done += 1
        seen = seen.unionByName(front).checkpoint()
    return seen.groupBy("shard").agg(F.count("*").alias("reachable"))



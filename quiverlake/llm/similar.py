"""Near-duplicates by the Jaccard similarity of word-shingle sets.

Candidates come from op6's operator: what its fingerprints link, through covering masks, in groups of any
size. Pairs further apart come from MinHash: 32 bands of five minima. A pair at similarity s shares a band
with probability 1 - (1 - s^5)^32, so one at exactly 0.8 is missed once in 330,000 times. No candidate
counts before its shingle sets were compared in full.

Rows of equal sets are one node. Each node of a band's bucket is linked to the bucket's lowest node, so
candidates grow with the nodes and not with their pairs; what such links connect is compared together.
Groups of many shingles are dealt into chunks, and each two chunks meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, to_bytes
from .simhash import components, first_of_groups, near_duplicates, shingle_hashes

BANDS, ROWS = 32, 5
_rng = np.random.default_rng(11)
XORS, FACTORS = (_rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
LAST = (1 << 63) - 1


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words, sorted; a text without words has the one hash 0."""
    found = np.unique(shingle_hashes(to_bytes(text).lower().split(), n))
    return found if len(found) else np.zeros(1, np.uint64)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """A number for each set and band, equal where a band's minima are; bands do not share numbers."""
    hashes = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    found = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS):
        for j in range(k * ROWS, (k + 1) * ROWS):
            found[:, k] = found[:, k] * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat((hashes ^ XORS[j]) * FACTORS[j], starts)
        found[:, k] ^= XORS[k]
    return found.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, hash, node, size, bands): node numbers the shingle set, size counts it, hash is of the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = [shingle_set(t, n) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands(sets).reshape(-1)))
            columns = [batch.column("doc_id"), batch.column("hash"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), held]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "node", "size", "bands"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return rows.mapInArrow(scan, "doc_id long, hash long, node long, size long, bands array<long>")


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of at least this similarity that connect what all such edges connect. A member is compared
    with those that have a shingle in common with it."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    posted = owner[np.argsort(index, kind="stable")]
    many = np.bincount(index, minlength=len(values))
    begin = np.cumsum(many) - many
    ends = np.cumsum(sizes)
    left = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        queue = [first]
        while queue:
            a = queue.pop()
            mine = index[ends[a] - sizes[a] : ends[a]]
            k = many[mine]
            at = np.repeat(begin[mine] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            shared = np.bincount(posted[at], minlength=len(sets))
            near = np.flatnonzero(left & (shared >= similarity * (sizes + sizes[a] - shared) - 1e-9)).tolist()
            left[near] = False
            edges += [(a, b) for b in near]
            queue += near
    return edges


def similar_links(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, n: int, similarity: float, chunk: int = 1 << 20) -> DataFrame:
    """(a, b): links of nodes within each root that connect all its pairs of at least this similarity.

    members: (node, size, root, doc_id, hash), the last two of a row that has the node's text.
    """
    totals = members.groupBy("root").agg(F.ceil(F.sum("size") / chunk).cast("long").alias("chunks"))
    c = F.pmod(F.xxhash64("node"), F.col("chunks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != c)
    pairs = F.transform(others, lambda j: F.least(j, c) * F.col("chunks") + F.greatest(j, c))
    dealt = members.join(totals, "root").withColumn("parts", F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(pairs))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    found = rows.join(dealt.select("doc_id", "hash", "node", "root", "parts"), ["doc_id", "hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = pa.array([shingle_set(t, n).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("node", "root", "parts")), sets], ["node", "root", "parts", "shingles"])

    def compare(group: pa.Table) -> pa.Table:
        of = dict(zip(group.column("node").to_pylist(), group.column("shingles").to_pylist(), strict=True))
        nodes = sorted(of)
        edges = similar_forest([np.frombuffer(of[x], np.uint64) for x in nodes], similarity)
        return pa.table({"a": pa.array([nodes[a] for a, _ in edges], pa.int64()), "b": pa.array([nodes[b] for _, b in edges], pa.int64())})

    sets = found.select("node", "root", "parts", "text").mapInArrow(cut, "node long, root long, parts array<long>, shingles binary")
    return sets.select("node", "root", F.explode("parts").alias("part"), "shingles").groupBy("root", "part").applyInArrow(compare, "a long, b long")


def fingerprint_candidates(docs: DataFrame, prints: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(a, b): each node of a component of near_duplicates with the component's lowest node. A text's hash says where it is in both."""
    groups = near_duplicates(docs, id_col, text_col).select("hash", F.col("root").alias("print")).distinct()
    member = scratch.write(prints.select("hash", "node").distinct().join(groups, "hash").select("print", "node").distinct(), "member")
    lowest = member.groupBy("print").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("print", "b")
    return member.join(lowest, "print").where("node <> b").select(F.col("node").alias("a"), "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, hash, root, component_id) for every row: component_id is the smallest doc_id reachable
    by links of at least this Jaccard similarity between sets of n-word shingles.

    Fewer words than n make one shingle; rows without words, null text included, are alike. Null
    doc_ids keep their rows; a component of null ids alone has a null component_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    prints = scratch.write(signatures(docs, id_col, text_col, n), "prints")
    row = F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "hash")
    nodes = scratch.write(prints.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("size").alias("size"), F.min(row).alias("row")), "nodes")
    banded = prints.select("node", "bands").dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    banded = scratch.write(banded, "banded")
    lowest = banded.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("band", "b")
    near = banded.join(lowest, "band").where("node <> b").select(F.col("node").alias("a"), "b")
    near = scratch.write(near.unionByName(fingerprint_candidates(docs, prints, id_col, text_col, scratch)).distinct(), "near")
    scratch.drop("banded")
    scratch.drop("member")
    plain = nodes.select(F.col("node").alias("fp"), "low")
    ends = near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).distinct()
    tied = scratch.write(components(plain.join(ends, "fp", "left_semi"), near, Scratch(spark, "similar-near")), "tied")
    members = nodes.join(tied.select(F.col("fp").alias("node"), "root"), "node").select("node", "size", "root", "row.doc_id", "row.hash")
    links = scratch.write(similar_links(docs, members, id_col, text_col, n, similarity).distinct(), "links")
    named = scratch.write(components(plain, links, Scratch(spark, "similar-links")), "named")
    named = named.select(F.col("fp").alias("node"), "root", F.col("low").alias("component_id"))
    found = scratch.write(prints.join(named, "node").select("doc_id", "hash", "root", "component_id"), "found")
    for name in ("prints", "nodes", "near", "tied", "links", "named"):
        scratch.drop(name)
    return found


def drop_similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component stays, as with drop_near_duplicates."""
    return first_of_groups(docs, similar_documents(docs, id_col, text_col, n, similarity), id_col, text_col)

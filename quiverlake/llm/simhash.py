"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Every bit gets a vector of radius + 1 bits, and every non-zero such vector v gives a table: its mask
keeps the bits whose vector has an odd product with v. Any `radius` differing bits leave some v whose
mask keeps none of them, so a pair within the radius agrees under that mask: no pair is missed.

Only distinct fingerprints are compared. A bucket with very many of them is divided again by masks over
the bits that its own mask leaves out. The guarantee holds there too, and a bucket ends, at the latest,
where all bits agree. Inside a bucket links are found in blocks and reduced to a spanning forest, so
what a bucket sends on grows with its members, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, slices, to_bytes

BITS = 64


def shingle_hashes(words: list[bytes], n: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of all runs of n words, joined by spaces, with repeats; fewer words make one run."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it; no hashes give zero."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, fp): hash is of the text, fp the fingerprint as a signed long. Null text has no
    words, hence fingerprint zero."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [simhash(shingle_hashes(to_bytes(t).lower().split())) for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), fp], ["doc_id", "hash", "fp"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).mapInArrow(scan, "doc_id long, hash long, fp long")


def covering_masks(bits: int, radius: int, seed: int = 0) -> list[int]:
    """The 2^(radius+1) - 1 masks over the set bits of `bits`. Vectors are dealt evenly, in shuffled order."""
    places = [b for b in range(BITS) if bits >> b & 1]
    size = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(len(places)) % size)
    return [sum(1 << b for b, x in zip(places, vectors.tolist(), strict=True) if (x & v).bit_count() & 1) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_keys(rows: DataFrame, masks: list[int], radius: int, path: Column, agreed: Column) -> DataFrame:
    """Each fingerprint under every mask: path numbers the tables so far; agreed has all bits that a bucket shares."""
    tables = F.array(*(F.struct(F.lit(i + 1).alias("table"), F.lit(signed(m)).alias("mask")) for i, m in enumerate(masks)))
    exploded = rows.withColumn("t", F.explode(tables))
    agreed = agreed.bitwiseOR(F.col("t.mask"))
    return exploded.select(
        "fp", (path * (2 << radius) + F.col("t.table")).alias("path"), agreed.alias("agreed"), F.col("fp").bitwiseAND(agreed).alias("value")
    )


def forest(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges within the radius that connect what all such edges connect: each member is compared once
    with those not reached yet."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(x))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            a = queue.pop()
            near = np.bitwise_count(x[left] ^ x[a]) <= radius
            if near.any():
                reached = left[near].tolist()
                edges += [(a, b) for b in reached]
                queue += reached
                left = left[~near]
    return edges


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): links in buckets, whose rows come together and sorted. Most buckets hold two."""

    def links(fp: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        x = fp.view(np.uint64)
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
        pairs = starts[ends - starts == 2]
        near = pairs[np.bitwise_count(x[pairs] ^ x[pairs + 1]) <= radius]
        a, b = [fp[near]], [fp[near + 1]]
        more = ends - starts > 2
        for s, e in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            if found := forest(x[s:e], radius):
                found = np.array(found) + s
                a.append(fp[found[:, 0]])
                b.append(fp[found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in zip(held, ("path", "value", "fp"), strict=True)]
            path, value, fp = held
            cuts = np.flatnonzero((path[1:] != path[:-1]) | (value[1:] != value[:-1])) + 1
            if len(cuts):  # the last bucket may go on in the next batch
                yield links(fp[: cuts[-1]], cuts[:-1])
                held = [x[cuts[-1] :] for x in held]
        if len(held[2]):
            yield links(held[2], np.zeros(0, np.int64))

    picked = keyed.select("path", "value", "fp").repartition("path", "value").sortWithinPartitions("path", "value", "fp")
    return picked.mapInArrow(scan, "a long, b long")


def fingerprint_links(distinct: DataFrame, scratch: Scratch, radius: int = 3, most: int = 1024) -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect all pairs within the radius.

    Buckets of more than `most` are divided by further masks instead of being compared, as long as
    their free bits allow; with few free bits they hold a bounded number.
    """
    everything = (1 << BITS) - 1
    keyed = with_keys(distinct.select("fp"), covering_masks(everything, radius), radius, F.lit(0).cast("long"), F.lit(0).cast("long"))
    found, level = None, 0
    while keyed is not None:
        level += 1
        sizes = scratch.write(keyed.groupBy("path", "value", "agreed").count().where("count > 1"), f"sizes{level}")
        crowded = sizes.where(F.col("count") > most)
        paths = crowded.select("path", "agreed").distinct().collect()  # no more than tables, a fixed number at each level
        free = {r["path"]: everything & ~(r["agreed"] & everything) for r in paths}
        divided = [p for p in free if free[p].bit_count() >= 4 << radius]
        compared = sizes.where((F.col("count") <= most) | ~F.col("path").isin(divided)).select("path", "value")
        links = scratch.write(bucket_links(keyed.join(compared, ["path", "value"]), radius).distinct(), f"links{level}")
        found = links if found is None else found.unionByName(links)
        rest, keyed = keyed, None
        for path in divided:
            inside = rest.where(F.col("path") == path).join(crowded.select("path", "value"), ["path", "value"])
            part = with_keys(inside.select("fp"), covering_masks(free[path], radius, level), radius, F.lit(path).cast("long"), F.lit(signed(everything & ~free[path])))
            keyed = part if keyed is None else keyed.unionByName(part)
        if keyed is not None:
            keyed = scratch.write(keyed, f"keyed{level}")
    return found


def components(nodes: DataFrame, links: DataFrame, scratch: Scratch, rounds: int = 100) -> DataFrame:
    """(fp, root, low): a fingerprint of each component that stands for it, and its smallest label.

    nodes: (fp, low), links: (a, b). Rounds of large stars and small stars shorten all paths until
    every member points to the root. Neighbours are only ever aggregated to a minimum, never collected.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    before = None
    for i in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(lowest, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.write(small, f"edges{i}")
        scratch.drop(f"edges{i - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = nodes.join(edges.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    roots = roots.select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return roots.join(roots.groupBy("root").agg(F.min("low").alias("least")), "root").select("fp", "root", F.col("least").alias("low"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, hash, fp, root, component_id) for every row: component_id is the smallest doc_id
    reachable by links of up to radius bits; root names the component, hash the text.

    Rows without words, null text included, have fingerprint zero and link like any other. Null doc_ids
    keep their rows; a component of null ids alone has a null component_id. Repeated rows share a
    component. An empty table gives no rows. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col), "prints")
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    named = scratch.write(components(nodes, fingerprint_links(nodes, scratch, radius), scratch), "named")
    # a fingerprint that very many documents share is one row of `named`; the adaptive plan splits its other side
    return prints.join(named.withColumnRenamed("low", "component_id"), "fp").select("doc_id", "hash", "fp", "root", "component_id")


def first_of_groups(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root in rows(doc_id, hash, root), with all its columns."""
    last = F.lit((1 << 63) - 1)
    keep = rows.groupBy("root").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("_id"), F.col("hash").alias("_hash"))).alias("k"))
    keep = Scratch(docs.sparkSession, "simhash").write(keep.select("k._id", "k._hash"), "keep")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    keyed = docs.select(row, F.coalesce(F.col(id_col).cast("long"), last).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_hash"))
    kept = keyed.join(keep, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])  # copies are combined before they are dealt
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row of each component stays, with all its columns: one of the smallest id; null ids come last.

    Rows alike in id and text count as one, of which the first met stays. Columns may have any name; an
    empty table stays empty, and texts of any length are read whole.
    """
    return first_of_groups(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Sharding over fixed virtual slots.

A record's hash names one of a few thousand slots, for good. Bytes are summed by slot, and a versioned
map assigns slots to shards so that the shards' bytes are near equal. Rebalancing and growth edit the
map and move whole slots; records are never hashed anew. Records alike in id and text can't be told
apart by a hash. Where they make a slot heavy, the map names them by a second hash, their mark, and deals
them over parts of their own; part 0 holds all other records of the slot. So the map alone says which
shard holds a record, or which few share the copies of it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

MAP_SCHEMA = "version int, shards int, slot int, part int, mark long, shard int, bytes long, rows long"


@dataclass(frozen=True)
class SlotMap:
    """Which shard each part of each slot belongs to. A slot has part 0 alone unless copies make it heavy.

    parts: (slot, part) to (shard, bytes, rows), with what was measured when the version was made.
    marks: (slot, part) to the mark of the copies that are dealt over it and its neighbours.
    """

    version: int
    shards: int
    parts: dict[tuple[int, int], tuple[int, int, int]] = field(default_factory=dict)
    marks: dict[tuple[int, int], int] = field(default_factory=dict)

    def copies(self) -> dict[tuple[int, int], list[int]]:
        """The parts of each (slot, mark) that has parts of its own."""
        found: dict[tuple[int, int], list[int]] = {}
        for (slot, part), mark in sorted(self.marks.items()):
            found.setdefault((slot, mark), []).append(part)
        return found

    def shards_of(self, slot: int, mark: int) -> set[int]:
        """The shards that hold the records of a slot and a mark: one, but for copies that were dealt out."""
        return {self.parts[slot, part][0] for part in self.copies().get((slot, mark), [0]) if (slot, part) in self.parts}

    def loads(self) -> list[int]:
        found = [0] * self.shards
        for shard, size, _ in self.parts.values():
            found[shard] += size
        return found

    @classmethod
    def balanced(cls, sizes: dict[tuple[int, int], tuple[int, int]], shards: int, marks: dict[tuple[int, int], int] | None = None) -> SlotMap:
        """The heaviest part first, each to the shard that has least."""
        heap = [(0, s) for s in range(shards)]
        parts = {}
        for key, (size, rows) in sorted(sizes.items(), key=lambda x: (-x[1][0], x[0])):
            load, shard = heapq.heappop(heap)
            parts[key] = (shard, size, rows)
            heapq.heappush(heap, (load + size, shard))
        return cls(1, shards, parts, marks or {})

    def measured(self, sizes: dict[tuple[int, int], tuple[int, int]], marks: dict[tuple[int, int], int] | None = None) -> SlotMap:
        """The same assignment with new sizes; parts that were empty go to the lightest shard."""
        parts = {k: (self.parts[k][0], *v) for k, v in sizes.items() if k in self.parts}
        found = SlotMap(self.version, self.shards, parts, self.marks if marks is None else marks)
        for key in sorted(sizes.keys() - parts.keys()):
            loads = found.loads()
            parts[key] = (loads.index(min(loads)), *sizes[key])
        return found

    def rebalanced(self, tolerance: float = 0.02) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest until all are within tolerance of the mean."""
        parts, loads = dict(self.parts), self.loads()
        mean = sum(loads) / self.shards
        while max(loads) > mean * (1 + tolerance):
            a, b = loads.index(max(loads)), loads.index(min(loads))
            gap = loads[a] - loads[b]
            fits = [(abs(gap / 2 - size), key) for key, (shard, size, _) in parts.items() if shard == a and 0 < size < gap]
            if not fits:
                break
            key = min(fits)[1]
            parts[key] = (b, *parts[key][1:])
            loads[a] -= parts[key][1]
            loads[b] += parts[key][1]
        return SlotMap(self.version + 1, self.shards, parts, self.marks)

    def grown(self) -> SlotMap:
        """The next version with one more shard, which takes slots from the fullest ones; no other slot moves."""
        parts, loads = dict(self.parts), [*self.loads(), 0]
        target = sum(loads) / (self.shards + 1)
        new = self.shards
        while loads[new] < target:
            a = loads.index(max(loads[:new]))
            room = max(target - loads[new], 0)
            fits = [(abs(min(loads[a] - target, room) - size), key) for key, (shard, size, _) in parts.items() if shard == a and 0 < size <= 1.05 * room]
            if loads[a] <= target or not fits:
                break
            key = min(fits)[1]
            parts[key] = (new, *parts[key][1:])
            loads[a] -= parts[key][1]
            loads[new] += parts[key][1]
        return SlotMap(self.version + 1, new + 1, parts, self.marks)

    def rows(self) -> list[tuple]:
        return [(self.version, self.shards, slot, part, self.marks.get((slot, part)), *x) for (slot, part), x in sorted(self.parts.items())]

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends this version; earlier ones stay, for readers that still use them."""
        spark.createDataFrame(self.rows(), MAP_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/at={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        table = spark.read.schema(MAP_SCHEMA + ", at int").parquet(path)
        version = table.agg(F.max("version")).first()[0] if version is None else version
        rows = table.where(F.col("version") == version).collect()
        parts = {(r["slot"], r["part"]): (r["shard"], r["bytes"], r["rows"]) for r in rows}
        return cls(version, rows[0]["shards"] if rows else 0, parts, {(r["slot"], r["part"]): r["mark"] for r in rows if r["mark"] is not None})


def record_slots(docs: DataFrame, id_col: str, text_col: str, slots: int, copies: dict[tuple[int, int], list[int]]) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot, mark, part)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    number = F.col(id_col).cast("long")
    slot: Column = F.pmod(F.xxhash64(number, text), F.lit(slots)).cast("int")
    rows = docs.select(
        number.alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        slot.alias("virtual_slot"),
        F.xxhash64(F.lit(1), number, text).alias("mark"),
    )
    part = F.lit(0)
    for (k, mark), parts in sorted(copies.items()):  # at most a few for each shard
        turn = F.pmod(F.monotonically_increasing_id(), F.lit(len(parts))).cast("int")
        part = F.when((F.col("virtual_slot") == k) & (F.col("mark") == mark), F.get(F.array(*map(F.lit, parts)), turn)).otherwise(part)
    return rows.withColumn("part", part)


def measure(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Bytes and rows of each part of each slot; their number has a fixed bound."""
    found = rows.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return {(r["virtual_slot"], r["part"]): (r["bytes"], r["rows"]) for r in found}


def shard_documents(
    docs: DataFrame, shards: int = 24, slots: int = 4096, id_col: str = "doc_id", text_col: str = "text", known: SlotMap | None = None
) -> tuple[DataFrame, SlotMap]:
    """(doc_id, size, text_crc32, shard, slot, virtual_slot, map_version) for every row, and the map used.

    size is the text's UTF-8 bytes plus 8. shard follows the map: a new one, or `known` rebalanced for
    the present sizes. slot is the row's place in its shard, without gaps from 0, by virtual slot and
    then doc_id. Null text counts as empty; null and repeated doc_ids keep their rows. An empty table
    gives no rows and a map without slots. Other columns are not looked at. Records alike are interchangeable:
    how many of them a part has may differ by a few between runs, which no other record's place depends on
    but through the bytes that are balanced.

    No task holds more than a part of a virtual slot: places are counted inside it, and its first place
    follows from the map's row counts.
    """
    rows = record_slots(docs, id_col, text_col, slots, {})
    sizes = measure(rows)
    most = sum(size for size, _ in sizes.values()) / (shards * 4) + 1
    marks = {} if known is None else dict(known.marks)
    heavy = [slot for (slot, _), (size, count) in sizes.items() if size > most and count > 1]
    if heavy:  # at most four for each shard, and no more groups of copies than that
        alike = rows.where(F.col("virtual_slot").isin(heavy)).groupBy("virtual_slot", "mark")
        alike = alike.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where((F.col("rows") > 1) & (F.col("bytes") > most)).collect()
        for slot, mark, size, count in sorted(alike):
            if (slot, mark) not in {(k, m) for (k, _), m in marks.items()}:
                free = max((part for k, part in marks if k == slot), default=0) + 1
                marks |= {(slot, free + i): mark for i in range(min(int(size // most) + 1, count, shards * 8))}
    if marks:
        # parts follow the rows' places, which another look at docs might change
        copies = SlotMap(0, shards, {}, marks).copies()
        rows = Scratch(docs.sparkSession, "slots").write(record_slots(docs, id_col, text_col, slots, copies), "rows")
        sizes = measure(rows)
    used = SlotMap.balanced(sizes, shards, marks) if known is None else known.measured(sizes, marks).rebalanced()
    firsts, places = [0] * used.shards, []
    for (slot, part), (shard, _, count) in sorted(used.parts.items()):
        places.append((slot, part, shard, firsts[shard]))
        firsts[shard] += count
    placed = docs.sparkSession.createDataFrame(places, "virtual_slot int, part int, shard int, first long")
    order = Window.partitionBy("virtual_slot", "part").orderBy("doc_id", "text_crc32", "size")
    found = rows.withColumn("n", F.row_number().over(order)).join(F.broadcast(placed), ["virtual_slot", "part"])  # at most slots and heavy parts
    return (
        found.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("n") - 1).alias("slot"), "virtual_slot", F.lit(used.version).alias("map_version")),
        used,
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, used = shard_documents(read_table(spark, sf_dir, "documents"), shards=24)
    used.save(spark, Scratch(spark, "slotmap").path)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )

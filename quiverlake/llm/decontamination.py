"""Benchmark decontamination with suffix arrays over the training text.

The training text is cut into shards of whole documents. A shard's words become numbers and all its
suffixes are sorted. Every suffix of every benchmark item is looked up by binary search, word by word:
the range of training suffixes that share its first words narrows until it is empty, which gives the
places of each verbatim run and its greatest length. All test suffixes of a block take each step
together. The benchmark comes in blocks of bounded size; a pass over the documents holds blocks of
`held_bytes` at most, and a larger benchmark takes further passes, in which each row brings what was
found before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, Scratch, gathered, read_table, to_bytes

SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
MATCHES = "doc_id long, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:long,length:long,item:string,item_start:long>>, longest long"


def words_of(text: str | None) -> list[bytes]:
    return to_bytes(text).translate(ALNUM_TABLE).split()


@dataclass
class Block:
    """Part of the benchmark: its items' words as numbers, and every suffix of an item that is long enough."""

    names: list[str]
    words: list[bytes]
    tokens: np.ndarray
    suffixes: np.ndarray  # where each test suffix starts in tokens
    item: np.ndarray  # its item,
    needs: np.ndarray  # the words that a window has,
    length: np.ndarray  # and all words up to the item's end
    starts: np.ndarray  # of items in tokens

    @classmethod
    def of(cls, rows: list[tuple[str, list[bytes]]], window: int) -> Block:
        numbers: dict[bytes, int] = {}
        tokens = np.array([numbers.setdefault(w, len(numbers)) for _, words in rows for w in words], np.int64)
        sizes = np.array([len(words) for _, words in rows], np.int64)
        starts = np.cumsum(sizes) - sizes
        need = np.minimum(sizes, window)
        count = sizes - need + 1
        item = np.repeat(np.arange(len(rows)), count)
        first = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        return cls([name for name, _ in rows], list(numbers), tokens, starts[item] + first, item, need[item], sizes[item] - first, starts)


class SuffixArray:
    """All suffixes of a shard in order. Words are numbered from `ends`; each document ends in a number of its own below that."""

    def __init__(self, texts: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        ends = len(texts)
        flat: list[int] = []
        for k, words in enumerate(texts):
            flat += [numbers.setdefault(w, ends + len(numbers)) for w in words]
            flat.append(k)
        self.numbers, self.tokens = numbers, np.array(flat, np.int64)
        self.sizes = np.fromiter(map(len, texts), np.int64, ends)
        self.doc = np.repeat(np.arange(ends), self.sizes + 1)
        self.firsts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.order = self.sort()
        self.heads = self.tokens[self.order]

    def sort(self) -> np.ndarray:
        """Sorts by as many words as fit a number, then by twice as many, until no two suffixes tie."""
        tokens, n = self.tokens, len(self.tokens)
        if not n:
            return np.zeros(0, np.int64)
        bits = int(tokens.max() + 1).bit_length()
        step = max(1, 62 // bits)
        key = tokens.copy()
        for d in range(1, step):
            key <<= bits
            key[: n - d] += tokens[d:]
        order, rank = np.arange(n), np.zeros(n, np.int64)
        slots = np.arange(n)
        while len(slots):
            places = order[slots]
            o = np.argsort(key)
            key, places = key[o], places[o]
            order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots = slots[tied]
            places = order[slots]
            key = rank[places] * np.int64(n) + rank[np.minimum(places + step, n - 1)]
            step *= 2
        return order

    def edge(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> np.ndarray:
        """Of each range, where the suffixes begin whose word at `depth` is `word` or a later one."""
        lo, hi = lo.copy(), hi.copy()
        busy = np.flatnonzero(lo < hi)
        while len(busy):
            mid = (lo[busy] + hi[busy]) >> 1
            below = self.tokens[self.order[mid] + depth] < word[busy]
            lo[busy[below]] = mid[below] + 1
            hi[busy[~below]] = mid[~below]
            busy = busy[lo[busy] < hi[busy]]
        return lo

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of each range whose suffixes go on with `word`; ranges share `depth` words, none of them an end."""
        if not depth:
            return np.searchsorted(self.heads, word, "left"), np.searchsorted(self.heads, word, "right")
        return self.edge(lo, hi, depth, word), self.edge(lo, hi, depth, word + 1)


@dataclass
class Found:
    """What a shard has of a block: the longest run from each place (0: none), a test suffix that has it,
    and (document, item) pairs as document * items + item."""

    best: np.ndarray
    source: np.ndarray
    pairs: np.ndarray


def spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of all ranges, one range after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def search(array: SuffixArray, block: Block) -> Found | None:
    """Looks up all suffixes of a block. None if no window occurs."""
    known = np.array([array.numbers.get(w, -1) for w in block.words], np.int64)
    tokens = known[block.tokens]
    alive = np.flatnonzero(tokens[block.suffixes] >= 0) if len(tokens) else np.zeros(0, np.int64)
    lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(array.order))
    best, source = np.zeros(len(array.tokens), np.int64), np.zeros(len(array.tokens), np.int64)
    pairs, depth, some = [], 0, False
    while len(alive):
        lo, hi = array.narrow(lo, hi, depth, tokens[block.suffixes[alive] + depth])
        depth += 1
        keep = lo < hi
        alive, lo, hi = alive[keep], lo[keep], hi[keep]
        whole = np.flatnonzero(block.needs[alive] <= depth)
        if len(whole):
            # test suffixes alike so far have one range; it counts once
            _, one = np.unique(lo[whole], return_index=True)
            one = whole[one]
            places = array.order[spread(lo[one], hi[one])]
            best[places], source[places] = depth, np.repeat(alive[one], hi[one] - lo[one])
            some = True
        just = np.flatnonzero(block.needs[alive] == depth)
        if len(just):
            key = np.unique(lo[just] * np.int64(len(block.names)) + block.item[alive[just]])
            at, item = np.divmod(key, len(block.names))
            upto = dict(zip(lo[just].tolist(), hi[just].tolist(), strict=True))
            ends = np.array([upto[x] for x in at.tolist()], np.int64)
            docs = array.doc[array.order[spread(at, ends)]]
            pairs.append(np.unique(docs * np.int64(len(block.names)) + np.repeat(item, ends - at)))
        keep = block.length[alive] > depth
        alive, lo, hi = alive[keep], lo[keep], hi[keep]
    return Found(best, source, np.unique(np.concatenate(pairs))) if some else None


def covered(spans: list[dict]) -> int:
    """Words inside spans."""
    count = reach = 0
    for x in sorted(spans, key=lambda x: x["start"]):
        end = x["start"] + x["length"]
        count += max(0, end - max(reach, x["start"]))
        reach = max(reach, end)
    return count


def match_rows(table: pa.Table, blocks: list[Broadcast]) -> pa.RecordBatch:
    """The rows of MATCHES for one shard; items and spans that the rows bring along are kept."""
    array = SuffixArray([words_of(x) for x in table.column("text").to_pylist()])
    before = "spans" in table.column_names
    spans: list[list[dict]] = [x or [] for x in table.column("spans").to_pylist()] if before else [[] for _ in range(table.num_rows)]
    items: list[set[str]] = [set(x or ()) for x in table.column("items").to_pylist()] if before else [set() for _ in range(table.num_rows)]
    for sent in blocks:
        block = sent.value
        found = search(array, block)
        if found is None:
            continue
        # a run that only continues the one found a word earlier is not listed again
        goes_on = np.zeros(len(found.best), bool)
        goes_on[1:] = (found.best[1:] > 0) & (found.best[:-1] == found.best[1:] + 1)
        for p in np.flatnonzero((found.best > 0) & ~goes_on).tolist():
            d, q = int(array.doc[p]), int(found.source[p])
            k = int(block.item[q])
            spans[d].append({"start": p - int(array.firsts[d]), "length": int(found.best[p]), "item": block.names[k], "item_start": int(block.suffixes[q] - block.starts[k])})
        for key in found.pairs.tolist():
            items[key // len(block.names)].add(block.names[key % len(block.names)])
    columns = [
        table.column("doc_id").combine_chunks(),
        table.column("text").combine_chunks(),
        pa.array(array.sizes),
        pa.array([covered(x) for x in spans], pa.int64()),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.array([sorted(x, key=lambda y: (y["start"], -y["length"], y["item"])) for x in spans], pa.list_(SPAN)),
        pa.array([max((y["length"] for y in x), default=0) for x in spans], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "n_hit", "items", "spans", "longest"])


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_bytes: int) -> Iterator[Block]:
    """Reads the benchmark partition by partition, as blocks of about max_bytes of text; an item is never cut."""
    picked = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    rows, size = [], 0
    for r in picked.toLocalIterator():
        words = words_of(r["text"])
        if rows and size + len(r["text"] or "") > max_bytes:
            yield Block.of(rows, window)
            rows, size = [], 0
        if words:
            rows.append((r["name"] or "", words))
            size += len(r["text"])
    yield Block.of(rows, window)


def passes(spark: SparkSession, blocks: Iterator[Block], held: int) -> Iterator[list[Broadcast]]:
    """Blocks, broadcast, `held` at a time; those of a pass leave the driver and the executors after it."""
    group: list[Broadcast] = []
    for block in blocks:
        if len(group) == held:
            yield group
            for sent in group:
                sent.unpersist()
            group = []
        group.append(spark.sparkContext.broadcast(block))
    yield group


def find_benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 8 << 20,
    held_bytes: int = 64 << 20,
    shard_bytes: int = 2 << 20,
) -> DataFrame:
    """Every document with its verbatim runs of `window` or more benchmark words.

    A benchmark item of fewer words, but not none, is one window. Columns: doc_id, n_words, n_hit
    (words inside a run), items (distinct ids as strings, sorted), spans (start and length in words,
    item, start in the item; each as long as it can be, with one of the items that go so far) and
    longest. One row per row of docs, in one pass and without a shuffle for each `held_bytes` of
    benchmark text.

    Null text has no words; a null item id counts as the id "". Null and repeated doc_ids keep their
    rows. A very long text makes a shard of its own. An empty table gives no rows, an empty benchmark
    leaves all documents clean. Other columns are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontamination")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    found = None
    for k, group in enumerate(passes(spark, blocks, max(1, held_bytes // block_bytes))):
        if found is not None:  # what the last pass found travels with the rows
            rows = scratch.write(found, f"pass{k}")

        def scan(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for table in gathered(batches, "text", shard_bytes):
                yield match_rows(table, group)

        found = rows.mapInArrow(scan, MATCHES)
    return found.drop("text")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = 8 << 20,
    held_bytes: int = 64 << 20,
    shard_bytes: int = 2 << 20,
) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns, whatever their names. No shuffle.

    Options as for find_benchmark_matches. Rows of null text stay, repeated rows stay or go together, and
    an empty table stays empty.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontamination")
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    at, kept = docs.columns.index(text_col), None
    for k, group in enumerate(passes(spark, blocks, max(1, held_bytes // block_bytes))):
        source = docs if kept is None else scratch.write(kept, f"pass{k}")

        def clean(batches: Iterator[pa.RecordBatch], group=group) -> Iterator[pa.RecordBatch]:
            for table in gathered(batches, text_col, shard_bytes):
                array, clear = SuffixArray([words_of(x) for x in table.column(at).to_pylist()]), np.ones(table.num_rows, bool)
                for sent in group:
                    found = search(array, sent.value)
                    if found is not None:
                        clear[array.doc[found.best > 0]] = False
                yield from table.filter(pa.array(clear)).combine_chunks().to_batches()

        kept = source.mapInArrow(clean, docs.schema)
    return kept


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
  from (select item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
dw as (select rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as s
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)),
m as (select rid, i, n, item from dw join bw using (n, s)),
h as (select rid, count(distinct p) as hit from (select rid, unnest(range(i, i + n)) as p from m) group by rid),
t as (select rid, count(*) as items, string_agg(item, ',' order by item) as ids from (select distinct rid, item from m) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit, 0) as bigint) as n_hit, cast(coalesce(items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(hit, 0) > 0 as contaminated
from d left join h using (rid) left join t using (rid)
"""

"""Removal of repeated byte strings, found in suffix-array intervals of a Burrows-Wheeler transform.

1. Anchors. The smallest hash among the short strings of a window is the same wherever the window
   stands, so it tells which parts of the corpus can hold equal windows. A grouped minimum and maximum
   of doc_id finds the anchors of two documents or more; text around other anchors has no repeats and
   goes no further. Neighbouring windows of one anchor form a string.
2. Intervals. Distinct strings, with the smallest doc_id of each, are dealt out by anchor. A task
   builds the transform of its strings and extends intervals backward, breadth first: the boundaries
   found in step v are the common prefixes of length v, so they come in increasing order, and after
   min_len steps every interval left holds the suffixes that share min_len bytes or more. An interval's
   smallest doc_id decides for all windows in it.
3. Removal. Decisions join back to the documents.

An anchor with very many distinct strings (a passage that half of the corpus cites in differing
contexts) is not left to one task: its strings are cut into single windows, which are pre-aggregated
and dealt out by their content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table, slices

LAST = (1 << 63) - 1
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
#: Bytes of the short strings that anchors are chosen from; see anchor_hashes.
ANCHOR = 20
#: Symbols that the first sort of suffixes compares; nine bits each fit a 64-bit number.
FIRST = 7
#: Windows are looked at in blocks of so many, whose arrays stay in the processor's cache; a place in a block and its
#: window fits 20 bits. The runs of so many blocks come together.
BLOCK, BLOCKS = 1 << 16, 32
#: Bits of anchors by which they are dealt out to be counted: 1,024 groups.
GROUP_BITS = 10
#: Bytes of text from which a sample says how many rounds there are.
ENOUGH = 1 << 28
#: Bits of one bitmap of Spark's bitmap functions.
MAP_BITS = 1 << 15


def binary_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins and ends in them."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= ODD[0]
    return h ^ (h >> np.uint64(29))


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20 bytes that start at each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    by = {1: h}
    for k, odd in zip((1, 2, 4, 8), ODD, strict=False):
        h = h[:-k] * odd + h[k:]
        by[2 * k] = h
    return mixed(by[16][:-4] * ODD[4] + by[4][16:])


def smallest_ahead(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values."""
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    return np.minimum(h[: len(h) - (width - k)], h[width - k :]) if width > k else h


class Runs:
    """Runs of neighbouring windows that have their anchor in one place: all in one block of a column, or `joined` those of several.

    key is the anchor's hash, doc the row; start and end bound the windows' first bytes in the text, and
    first says where the text's bytes begin in the column. sid is a 64-bit hash of the run's string: the
    sum of its 20-byte strings' hashes, each mixed with the one behind it, so equal strings have it equal.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, last: int, min_len: int, strings: bool):
        base, data = first, data[first : last + min_len - 1]
        h = anchor_hashes(data)
        place = np.uint64((1 << 20) - 1)
        at = (smallest_ahead((h & ~place) | np.arange(len(h), dtype=np.uint64), min_len - ANCHOR + 1) & place).astype(np.int64)
        inside = np.ones(len(at), bool)
        k = int(np.searchsorted(bounds, first, "right"))
        for b in bounds[k : int(np.searchsorted(bounds, last + min_len, "right")) + 1].tolist():
            inside[max(0, b - min_len + 1 - first) : max(0, b - first)] = False
        cuts = np.flatnonzero((at[1:] != at[:-1]) | (inside[1:] != inside[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]])
        keep = inside[starts]
        starts, ends = starts[keep], ends[keep]
        self.key = h[at[starts]].view(np.int64)
        self.doc = np.searchsorted(bounds, starts + base, "right") - 1
        self.first = bounds[self.doc]
        self.start, self.end = starts + base - self.first, ends + base - self.first
        if not strings:
            return
        sums = np.zeros(len(h), np.uint64)
        np.cumsum(mixed(h[:-1] * ODD[1] + h[1:]), out=sums[1:])
        whole = sums[ends + min_len - 1 - ANCHOR] - sums[starts]
        self.sid = mixed(whole * ODD[2] + h[starts] + (ends - starts).astype(np.uint64) * ODD[3]).view(np.int64)

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        found = cls.__new__(cls)
        for name in vars(parts[0]):
            setattr(found, name, np.concatenate([getattr(x, name) for x in parts]))
        return found


def batch_runs(texts: pa.Array, min_len: int, strings: bool = True) -> Iterator[Runs]:
    """Runs of a column, some blocks at a time; blocks may cut a text, and then a run. sid only if strings are asked for."""
    data, bounds = binary_view(texts)
    held, windows = [], len(data) - min_len + 1
    for first in range(0, windows, BLOCK):
        runs = Runs(data, bounds, first, min(first + BLOCK, windows), min_len, strings)
        if len(runs.key):
            held.append(runs)
        if held and (len(held) == BLOCKS or first + BLOCK >= windows):
            yield Runs.joined(held)
            held = []


def numbers_in(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values that hold the numbers between neighbouring bounds."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


GROUPED = "part int, anchors binary, low binary, high binary, width binary"


def grouped_anchors(key: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Anchors with their smallest and largest document, a row for each group: the anchors, turned so that the
    group's bits lead, in order, and the smallest document in two halves and how far the largest is from it,
    as most bytes of those are zero. So many numbers as rows of their own would cost more than to find them."""
    turned = key.view(np.uint64) >> np.uint64(GROUP_BITS) | key.view(np.uint64) << np.uint64(64 - GROUP_BITS)
    order = np.argsort(turned)
    turned, own = turned[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], turned[1:] != turned[:-1]]))
    turned, low, high = turned[starts], np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
    part = (turned >> np.uint64(64 - GROUP_BITS)).astype(np.int32)
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = np.append(begins, len(part))
    halves = low.view(np.uint32).reshape(-1, 2)
    columns = [numbers_in(bounds, x) for x in (turned, halves[:, 0], halves[:, 1], high - low)]
    return pa.RecordBatch.from_arrays([pa.array(part[begins]), *columns], ["part", "anchors", "low", "high", "width"])


def shared_anchors(table: pa.Table) -> pa.Table:
    """The anchors of one group that stand in two documents or more."""
    turned, low, high, width = (
        np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in (("anchors", np.uint64), ("low", np.uint32), ("high", np.uint32), ("width", np.int64))
    )
    low = np.column_stack([low, high]).view(np.int64)[:, 0]
    order = np.argsort(turned)
    turned, low, high = turned[order], low[order], (low + width)[order]
    starts = np.flatnonzero(np.concatenate([[True], turned[1:] != turned[:-1]]))
    several = np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts)
    turned = turned[starts[several]]
    return pa.table([(turned << np.uint64(GROUP_BITS) | turned >> np.uint64(64 - GROUP_BITS)).view(np.int64)], ["anchor"])


class Filter:
    """A bit for each value of the last bits of keys; says no only if no key has them. Anchors are smallest
    hashes, so their leading bits are mostly zero and tell few of them apart.

    Its size grows with the number of keys up to 64 MB and stays there. It only spares work: strings that
    it lets through without need turn out to have no repeats, and once it is full an exact join follows.
    """

    MOST = 29

    def __init__(self, bits: int, data: np.ndarray, count: int):
        self.bits, self.data = bits, data
        #: Whether so many keys share the bits that it lets too much through.
        self.full = count << 3 > 1 << bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @classmethod
    def of(cls, keys: DataFrame, column: str, count: int) -> Filter:
        """Set bits are gathered in bitmaps of 4 KB, map side first; the driver gets those, 64 MB in all at most."""
        bits = min(cls.MOST, max(16, count.bit_length() + 5))
        at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        rows = keys.select((at / MAP_BITS).cast("int").alias("part"), F.pmod(at, F.lit(MAP_BITS)).alias("bit"))
        data = np.zeros((1 << bits) // MAP_BITS * (MAP_BITS // 8), np.uint8).reshape(-1, MAP_BITS // 8)
        for r in rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("data")).toLocalIterator():
            data[r["part"]] = np.frombuffer(r["data"], np.uint8)
        return cls(bits, data.reshape(-1), count)


def suffix_order(letters: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes in order, each one's rank, and where those of equal first letters begin. Strings end at `ends`, each in a symbol of its own
    that is smaller than any letter and than those of later strings.

    The first sort compares FIRST symbols. Later ones double the length, and only sort what still ties.
    """
    n = len(letters)
    symbols = letters.astype(np.int64) + 1
    symbols[ends] = 0
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # letters ahead of the string's end
    key = symbols.copy()
    for d in range(1, FIRST):
        key <<= 9
        key[: n - d] += symbols[d:]
    ended = left < FIRST
    short = np.flatnonzero(ended)
    behind = 9 * (FIRST - 1 - left[short])  # bits of what stands behind the end, which count for nothing
    key[short] = key[short] >> behind << behind
    order = np.argsort(key)
    begins = np.ones(n, bool)  # where a group of ties begins; a suffix that has ended ties with none
    closed = ended[order]
    at, short = np.flatnonzero(closed), np.sort(order[closed])
    order[at] = short[np.argsort(key[short], kind="stable")]
    sorted_ = key[order]
    begins[1:] = (sorted_[1:] != sorted_[:-1]) | closed[1:] | closed[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    step, intervals = FIRST, begins
    tied = ~begins
    tied[:-1] |= ~begins[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        places = order[slots]
        key = rank[places] * np.int64(n) + rank[places + step]
        o = np.argsort(key)
        key, places = key[o], places[o]
        order[slots] = places
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank[places] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        step *= 2
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
    return order, rank, intervals


def prefix_intervals(letters: np.ndarray, ends: np.ndarray, order: np.ndarray, rank: np.ndarray, bound: np.ndarray, min_len: int) -> np.ndarray:
    """Marks, in suffix order, where an interval of suffixes that share min_len letters or more begins.

    Works on the Burrows-Wheeler transform, from the intervals of FIRST letters in `bound`. Each step
    extends the boundaries found in the last one backward by every letter: the two rows around a
    boundary, of those that the letter stands before, come apart too, unless they have done so before. A
    boundary found in step v is a longest common prefix of v. Most letters stand before both rows next to
    the boundary: `follow` has what these extend to. Pairs further apart are looked up among the
    step's boundaries.
    """
    n = len(letters)
    ended = np.zeros(n, bool)
    ended[ends] = True
    transform, rows = letters[order - 1], np.flatnonzero(~ended[order - 1])
    # the suffix that each one extends: symbols that end strings come first, then the letters in order
    extends = np.concatenate([rank[(ends + 1) % n], rows[np.argsort(transform[rows], kind="stable")]])
    open_ = np.flatnonzero(~bound)
    above, below = extends[open_ - 1], extends[open_]
    near = above + 1 == below
    follow = np.full(n, -1)
    follow[below[near]] = open_[near]
    open_, above, below = open_[~near], above[~near], below[~near]
    fresh = np.flatnonzero(bound)
    for _ in range(FIRST, min_len):
        found = follow[fresh]
        apart = np.searchsorted(fresh, above, "right") < np.searchsorted(fresh, below, "right")
        fresh = np.sort(np.concatenate([found[found >= 0], open_[apart]]))
        if not len(fresh):
            break
        bound[fresh] = True
        open_, above, below = open_[~apart], above[~apart], below[~apart]
    return bound


def window_minimums(strings: list[bytes], lows: np.ndarray, min_len: int) -> list[np.ndarray]:
    """For each window of each string, the smallest `lows` of the strings that hold the same window."""
    count = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, count)
    letters = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    order, rank, bound = suffix_order(letters, ends)
    bound = prefix_intervals(letters, ends, order, rank, bound, min_len)
    owner = np.repeat(np.arange(count), sizes + 1)
    whole = ends[owner] - np.arange(len(letters)) >= min_len
    rows = np.flatnonzero(whole[order])
    places = order[rows]
    interval = np.cumsum(bound)[rows]
    starts = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    least = np.minimum.reduceat(lows[owner[places]], starts)
    found = np.empty(len(letters), np.int64)
    found[places] = np.repeat(least, np.diff(np.concatenate([starts, [len(places)]])))
    return [found[e - n : e - min_len + 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def decision_runs(strings: list[bytes], lows: np.ndarray, highs: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of one string with the same smallest document, as (string, first
    window, last window + 1, smallest document); without those that no document of the string is above."""
    found = window_minimums(strings, lows, min_len)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begins = np.cumsum(sizes) - sizes
    flat = np.concatenate(found)
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begins] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(flat))
    owner = np.searchsorted(begins, starts, "right") - 1
    keep = flat[starts] < highs[owner]
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    return owner, starts - begins[owner], ends - begins[owner], flat[starts]


def rounds_for(text: int, strings: int, least: int, share: float, sampled: int) -> int:
    """In how many rounds a sample's strings are `share` times its text each; `least` where the whole text is under ENOUGH."""
    return least if not text or text * sampled < ENOUGH else max(least, -(-strings // max(1, int(share * text))))


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_len: int = 50,
    task_bytes: int = 1 << 20,
    hot_bytes: int = 8 << 20,
    rounds: int = 2,
    share: float = 1.0,
    sampled: int = 64,
) -> tuple[DataFrame, Scratch]:
    """Byte strings to remove, as (_id, _hash, _spans): _spans is an array of numbers, each with the first
    byte of a span in its upper 32 bits and the byte after its last in the lower ones. Spans may overlap.

    A window goes if the same min_len bytes also start in a document of a smaller id. See `removed`,
    which applies the result. A null id counts as larger than all others. Rows of one id never count
    against each other, and rows alike in id and text get one set of spans. Null and short texts have no
    windows; an empty table gives no rows. Very long texts are looked at in blocks that overlap. Other
    columns are not looked at.

    Anchors are handled in rounds, each with its share of them by hash, so that the strings of one
    round alone take disk at a time. There are `rounds` or as many more as it takes to hold a round's
    strings to `share` times the bytes of the texts: of a larger corpus, more of the text is around
    anchors of two documents, or passes a filter that is dense. One text in `sampled`, by hash, says how
    much that is; it plans the rounds and nothing else.
    """
    if min_len < ANCHOR + 2:
        raise ValueError(f"min_len must be {ANCHOR + 2} or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = keyed(docs, id_col, text_col).select("_id", "_hash", F.coalesce("_text", F.lit("")).cast("binary").alias("bytes"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 2 << 20):
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            for runs in batch_runs(batch.column("bytes"), min_len, strings=False):
                yield grouped_anchors(runs.key, ids[runs.doc])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = sent.value
        for batch in slices(batches, "bytes", 2 << 20):
            size = 0
            for runs in batch_runs(batch.column("bytes"), min_len, strings=False):
                size += int((runs.end - runs.start + (min_len - 1 + 24))[passes(runs.key)].sum())  # three numbers go with a string
            yield pa.RecordBatch.from_arrays([pa.array([len(binary_view(batch.column("bytes"))[0])]), pa.array([size])], ["text", "strings"])

    def cutter(mine: int, whole: bool):
        """Strings around the anchors of one round: their bytes, or where they stand."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            passes = sent.value
            for batch in slices(batches, "bytes", 2 << 20):
                ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_hash"))
                data = binary_view(batch.column("bytes"))[0].tobytes() if whole else b""
                for runs in batch_runs(batch.column("bytes"), min_len):
                    at = np.flatnonzero((runs.key % rounds == mine) & passes(runs.key))
                    if not len(at):
                        continue
                    first, start, end, doc = runs.first[at], runs.start[at], runs.end[at], runs.doc[at]
                    columns = [pa.array(runs.key[at]), pa.array(runs.sid[at]), pa.array(ids[doc])]
                    if whole:
                        strings = [data[a:b] for a, b in zip((first + start).tolist(), (first + end + min_len - 1).tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(strings, pa.binary())], ["anchor", "sid", "_id", "string"])
                    else:
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(hashes[doc]), pa.array(start)], ["anchor", "sid", "_id", "_hash", "start"])

        return cut

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("anchor")
        anchor, lows, highs, sid = (table.column(c).to_numpy() for c in ("anchor", "lo", "hi", "sid"))
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
        # a string alone at its anchor has its windows to itself: a transform of it would be one of one document
        alone = edge[:-1][np.diff(edge) == 1]
        gone = alone[lows[alone] < highs[alone]]
        windows = pc.binary_length(table.column("string")).to_numpy()[gone].astype(np.int64) - (min_len - 1)
        found = [(anchor[gone], sid[gone], np.zeros(len(gone), np.int64), windows, lows[gone])]
        tied = np.ones(len(anchor), bool)
        tied[alone] = False
        strings = table.column("string").filter(pa.array(tied)).to_pylist()
        lows, highs, anchor, sid = lows[tied], highs[tied], anchor[tied], sid[tied]
        sizes = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
        # anchors have no windows in common: a few at a time keep the arrays small
        cuts = [0]
        for k in [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(strings)] if strings else ():
            if sizes[k - 1] - (sizes[cuts[-1] - 1] if cuts[-1] else 0) >= 1 << 16 or k == len(strings):
                cuts.append(k)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            owner, *run = decision_runs(strings[a:b], lows[a:b], highs[a:b], min_len)
            found.append((anchor[a:b][owner], sid[a:b][owner], *run))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["anchor", "sid", "a", "b", "least"])

    shared = rows.mapInArrow(anchors, GROUPED).groupBy("part").applyInArrow(shared_anchors, "anchor long")
    shared = scratch.write(shared, "anchors")
    sent = spark.sparkContext.broadcast(Filter.of(shared, "anchor", shared.count()))

    some = rows.where(F.pmod(F.xxhash64("_hash"), F.lit(sampled)) == 0).mapInArrow(measure, "text long, strings long")
    rounds = rounds_for(*some.agg(F.coalesce(F.sum("text"), F.lit(0)), F.coalesce(F.sum("strings"), F.lit(0))).first(), rounds, share, sampled)

    def cut(mine: int, whole: bool, kind: str) -> DataFrame:
        strings = rows.mapInArrow(cutter(mine, whole), kind)
        return strings.join(shared, "anchor") if sent.value.full else strings

    found = None
    for mine in range(rounds):
        # strings are cut from the texts twice, which takes less disk than to keep them
        strings = cut(mine, True, "anchor long, sid long, _id long, string binary")
        distinct = strings.groupBy("anchor", "sid", "string").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"))
        distinct = scratch.write(distinct, f"distinct{mine}")
        sizes = distinct.groupBy("anchor").agg(F.sum(F.octet_length("string")).alias("bytes"))
        total, crowded = sizes.agg(F.sum("bytes"), F.count(F.when(F.col("bytes") > hot_bytes, 1))).first()
        tasks = max(1, -(-(total or 0) // task_bytes))
        kind = "anchor long, sid long, a long, b long, least long"
        bucket = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(tasks)).alias("bucket")
        plain = distinct
        if crowded:
            hot = sizes.where(F.col("bytes") > hot_bytes).select("anchor")
            plain = distinct.join(hot, "anchor", "left_anti")
            windows = distinct.join(hot, "anchor").select(
                "anchor", "sid", "lo", "hi", F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("string") - (min_len - 1)), lambda k: F.substring("string", k, F.lit(min_len)))).alias("at", "window")
            )
            # two hashes, of 64 bits each, stand for a window
            place = [F.xxhash64("window"), F.xxhash64(F.lit(1), "window")]
            one = windows.groupBy("window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            one = one.select(bucket("window"), place[0].alias("anchor"), place[1].alias("sid"), F.col("window").alias("string"), "lo", "hi")
            one = one.groupBy("bucket").applyInArrow(decide, kind)
            crowd = (
                windows.select("anchor", "sid", "hi", "at", place[0].alias("_a"), place[1].alias("_s"))
                .join(one.select(F.col("anchor").alias("_a"), F.col("sid").alias("_s"), "least"), ["_a", "_s"])
                .where("least < hi")
                .select("anchor", "sid", F.col("at").cast("long").alias("a"), (F.col("at") + 1).cast("long").alias("b"), "least")
            )
        decided = plain.select(bucket("anchor"), "anchor", "sid", "string", "lo", "hi").groupBy("bucket").applyInArrow(decide, kind)
        if crowded:
            decided = decided.unionByName(crowd)
        decided = scratch.write(decided, f"decided{mine}")
        scratch.drop(f"distinct{mine}")
        span = F.shiftleft(F.col("start") + F.col("a"), 32) + F.col("start") + F.col("b") + (min_len - 1)
        spans = (
            cut(mine, False, "anchor long, sid long, _id long, _hash long, start long")
            .join(decided, ["anchor", "sid"])
            .where("least < _id")
            .groupBy("_id", "_hash")
            .agg(F.collect_set(span).alias("_spans"))
        )
        part = scratch.write(spans, f"spans{mine}")
        found = part if found is None else found.unionByName(part)
        scratch.drop(f"decided{mine}")
    scratch.drop("anchors")
    # a document's spans are no more than its bytes
    return found.groupBy("_id", "_hash").agg(F.flatten(F.collect_list("_spans")).alias("_spans")), scratch


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _id, _hash, _text): the caller's columns in one, the id with null last, the text's hash and
    the text; rows alike in id and hash get the same decisions."""
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))


def removed(bounds: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Which bytes of a column of texts go; bounds says where each text begins, spans has its list."""
    counts = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False)
    values = spans.flatten().to_numpy(zero_copy_only=False)
    base, size = np.repeat(bounds[:-1], counts), int(bounds[-1]) + 1
    edge = np.bincount(base + (values >> 32), minlength=size) - np.bincount(base + (values & 0xFFFFFFFF), minlength=size)
    return np.cumsum(edge[:-1]) > 0


def kept_bytes(data: np.ndarray, bounds: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of a column of texts, and where each of them begins in it."""
    before = np.concatenate([[0], np.cumsum(~gone)])
    return data[~gone], before[bounds]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 50, **options: int) -> DataFrame:
    """The columns of docs with repeated strings cut out of the text.

    Every byte goes that lies in min_len bytes which also start in a document of a smaller id, judged
    on the input. A character goes only with all its bytes, so the text stays valid. Rows of null text
    stay as they are; a text may become empty. Repeated rows are all cut alike, an empty table gives an
    empty one, and columns may have any name. Options: see repeated_spans.
    """
    spans, _ = repeated_spans(docs, id_col, text_col, min_len, **options)
    names, at = docs.columns, docs.columns.index(text_col)
    others = F.struct(*(F.col("_row").getField(c).alias(c) for c in names if c != text_col))  # the text goes along once

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 2 << 20):
            own = batch.column("_text")
            data, bounds = binary_view(pc.fill_null(own, "").cast(pa.binary()))
            gone = removed(bounds, batch.column("_spans"))
            if len(data):
                begins = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.minimum.reduceat(gone, begins), np.diff(np.append(begins, len(data))))
            left, ends = kept_bytes(data, bounds, gone)
            columns = batch.column("_row").flatten()
            text = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(left)])
            columns.insert(at, pc.if_else(own.is_null(), pa.scalar(None, pa.string()), text))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = keyed(docs, id_col, text_col).select(others.alias("_row"), "_id", "_hash", "_text")
    return rows.join(spans, ["_id", "_hash"], "left").select("_row", "_text", "_spans").mapInArrow(cut, docs.schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, min_len = read_table(spark, sf_dir, "documents").select("doc_id", "text"), 50
    spans, _ = repeated_spans(docs, min_len=min_len)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 2 << 20):
            data, bounds = binary_view(batch.column("bytes"))
            gone = removed(bounds, batch.column("_spans"))
            left, ends = kept_bytes(data, bounds, gone)
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = bounds[:-1][np.diff(bounds) > 0]
            opens[inner] = gone[inner]
            n_spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[bounds])
            sizes, kept, ends = np.diff(bounds), left.tobytes(), ends.tolist()
            hashes = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array(sizes), pa.array(sizes - np.diff(ends)), pa.array(n_spans), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed(docs, "doc_id", "text").join(spans, ["_id", "_hash"], "left")
    picked = joined.select(F.col("_row.doc_id").cast("long").alias("doc_id"), F.coalesce("_text", F.lit("")).cast("binary").alias("bytes"), "_spans")
    return picked.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

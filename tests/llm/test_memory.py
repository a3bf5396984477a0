"""What operators hold in workers and on disk."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import functions as F

from quiverlake.llm import perplexity, substrings
from quiverlake.llm.common import BATCH_BYTES, Scratch


def test_batches_to_python_are_small(spark):
    """What a task holds outside the heap follows the batches: 64 MB each, once for each of vector, stream and worker, do not fit."""
    Scratch(spark, "small")
    wide = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("lorem "), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    found = wide.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 400
    assert max(r["size"] for r in found) <= 2 * BATCH_BYTES


def test_a_text_goes_once_to_be_cut(spark):
    """The row's other columns travel beside the text, and each finds its place again."""
    twice = "a passage of more than fifty bytes that stands in both of these two documents. "
    rows = [(7, "x", 1, f"{twice}one"), (5, None, 2, twice), (6, "y", 3, None)]
    docs = spark.createDataFrame([(a, b, t, n) for a, b, n, t in rows], "`a.id` long, `od d` string, text string, n int").withColumnRenamed("a.id", "doc_id")
    found = substrings.dedup_substrings(docs)
    assert found.columns == docs.columns
    got = {r["doc_id"]: (r["od d"], r["n"], r["text"]) for r in found.collect()}
    assert got == {7: ("x", 1, "one"), 5: (None, 2, twice), 6: ("y", 3, None)}


def test_entries_of_contexts_take_little_disk():
    """What goes through op4's largest shuffle: a third of the 14 bytes an entry, and the same entries come back."""
    rng = np.random.default_rng(3)
    n = 1 << 14
    context, word, doc = np.sort(rng.integers(0, 3000, n)), rng.integers(0, 4000, n), rng.integers(0, 1700, n)
    columns = [context, word, doc, np.ones(n, np.int64)]
    value = perplexity.pressed(columns, zstandard.ZstdCompressor(level=1))
    assert len(value) < 14 * n / 3
    assert all(np.array_equal(a, b) for a, b in zip(columns, perplexity.entries_of(value), strict=True))
    words = [b"", b"a", b"\xff"]
    table = perplexity.rare_rows(words, np.zeros(2, np.int64), np.array([1, 2]), np.array([0, 5]), np.array([1, 2**32 - 1]), 1, 9)
    assert perplexity.words_in(table.column("contexts")[0].as_py()) == [b""]
    assert [x.tolist() for x in perplexity.entries_of(table.column("entries")[0].as_py())] == [[0, 0], [0, 1], [0, 5], [1, 2**32 - 1]]


def test_words_come_to_their_parts_together(spark):
    """Millions of words a part asks for are not a row each: what a task has of a part is one."""
    rows = spark.range(0, 6000, 1, 2).select((F.col("id") % 3).cast("int").alias("part"), (F.lit(5999) - F.col("id")).alias("place"), F.col("id").alias("came"), F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("unigram"))
    found = perplexity.dealt(rows, ("came", "<i8"), ("unigram", "V8"))
    table = found.toArrow()
    assert table.num_rows == 6
    for part in range(3):
        came, unigram = perplexity.in_place(table.filter(pc.equal(table.column("part"), part)).column("entries"), "<i8", "V8")
        expected = np.arange(5999 - (5999 - part) % 3, -1, -3)
        assert came.tolist() == expected.tolist()
        assert unigram.view(">i8").tolist() == expected.tolist()

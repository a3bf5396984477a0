"""Packing by power-of-two decomposition.

Each document's token count is written in binary: as many pieces of the longest length as fit, then
one piece for each set bit of the rest. A piece is a sequence of its own, so no sequence holds two
documents, and as every length is a power of two, none needs padding. Sequences of equal length form
a bucket from which batches are drawn.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"

#: Fixed values of the word-level tokenizer's own pre-tokenization, on normalized text.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
WHITE = r"\t-\r \x85\xa0  -     　"
ASCII_WORDS = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
UNICODE_WORDS = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
#: str.split() cuts at these, which are no white space to the tokenizer.
SPLITS_TOO = re.compile("[\x1c-\x1f]")
SPECIALS = ("<|startoftext|>", "<|endoftext|>")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the others, in order, for the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    Equal to Tokenizer.encode(text, add_special_tokens=False). Normalization and the cut into words
    happen here, and the vocabulary's merges run once for each distinct word. Runs of text between
    white space are cached too, as most recur. A cache starts anew when it is full, so memory has a
    bound. Texts that name a special token go through the tokenizer whole.
    """

    def __init__(self, path: str, max_runs: int = 500_000, max_words: int = 500_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        self.letters = byte_letters()
        self.runs: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.max_runs, self.max_words = max_runs, max_words

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # str.lower() alone looks at a sigma's neighbours
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        return UNICODE_WORDS.findall(text)

    def encode_word(self, word: str) -> bytes:
        if (ids := self.known.get(word)) is None:
            shown = word if word.isascii() and word.isprintable() else "".join(self.letters[b] for b in word.encode())
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.merge(shown))
            if len(self.known) >= self.max_words:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIALS[0] in text or SPECIALS[1] in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if SPLITS_TOO.search(text):
            return b"".join(map(self.encode_word, self.words(text)))
        runs, cache = text.split(), self.runs
        try:
            return b"".join(map(cache.__getitem__, runs))
        except KeyError:
            pass
        new = {r for r in runs if r not in cache}
        if len(cache) + len(new) > self.max_runs:
            cache.clear()
            new = set(runs)
        for run in new:
            cache[run] = b"".join(map(self.encode_word, self.words(run)))
        return b"".join(map(cache.__getitem__, runs))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def binary_lengths(n: int, max_len: int) -> list[int]:
    """Lengths of the pieces of n tokens, longest first: 2500 gives 2048, 256, 128, 64, 4."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, max_len: int = 2048
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset, bucket.

    bucket is log2 of the length; offset is always 0, since a sequence holds one piece. sequence_id is
    unique, made of the partition's number and a count in it, and the same when a task runs again.
    There is no shuffle.

    Null text counts as empty, which leaves the end id alone. Null and repeated doc_ids keep their rows.
    Very long texts are encoded whole. An empty table gives no rows. Other columns are not looked at.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer_path), int(end_id).to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 4 << 20):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = (enc.encode(text) if text else b"") + end
                total, start = len(ids) // 4, 0
                for length in binary_lengths(total, max_len):
                    for column, value in zip(
                        out,
                        (doc_id, start, length, ids[4 * start : 4 * (start + length)], total, sequence, length.bit_length() - 1),
                        strict=True,
                    ):
                        column.append(value)
                    start += length
                    sequence += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            a = [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)]
            offset = pa.array(np.zeros(len(a[0]), np.int64))
            yield pa.RecordBatch.from_arrays(
                [*a[:6], offset, a[6]], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"]
            )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(pack, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Stores pieces with one folder for each length, from which a loader draws batches of equal length."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )

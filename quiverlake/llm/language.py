"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A text is encoded with every
dictionary, and the one that gives the fewest bytes names the language. A narrow margin to the next
one, as for tables of numbers or mixed text, marks the text as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, slices, small_batches

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: About what a frame takes besides its content.
FRAME = 8


def letters_only(text: str) -> bytes:
    """Lower-cased words of letters, one space between them."""
    return (" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass")


def coders(samples: dict[str, bytes], level: int) -> dict[str, zstandard.ZstdCompressor]:
    found = {}
    for lang, sample in samples.items():
        held = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        found[lang] = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
    return found


@dataclass
class LanguageModel:
    """Dictionaries by language, and the share of each in the training rows, which breaks ties."""

    samples: dict[str, bytes]
    share: dict[str, float]
    chunk_bytes: int = 1024
    min_margin: float = 0.02
    level: int = 6
    _coders: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_coders": {}}

    def sizes(self, text: str) -> dict[str, int]:
        """Bytes that the whole text takes with each dictionary, encoded in chunks, so that the
        dictionary rather than the text's own beginning explains each chunk."""
        data, step = letters_only(text), self.chunk_bytes
        if not self._coders:
            self._coders = coders(self.samples, self.level)
        chunks = [data[i : i + step] for i in range(0, len(data), step)]
        return {lang: sum(len(coder.compress(c)) - FRAME for c in chunks) for lang, coder in self._coders.items()}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected.

        The score is the best language's weight if each byte less counts as twice as likely.
        """
        if not text or not self.samples or next(filter(str.isalpha, text), None) is None:
            return UNKNOWN, 0.0, True
        ranked = sorted((n, -self.share[lang], lang) for lang, n in self.sizes(text).items())
        best = ranked[0][0]
        score = 1 / sum(2.0 ** -min(n - best, 1000) for n, _, _ in ranked)
        margin = (ranked[1][0] - best) / max(1, ranked[1][0]) if len(ranked) > 1 else 1.0
        return ranked[0][2], score, margin < self.min_margin


def cleaned(parts: dict[str, list[bytes]], level: int = 6, piece: int = 300) -> dict[str, bytes]:
    """Dictionaries without the pieces that the other half of the sample takes for another language,
    such as quotations. A language that would lose all keeps all."""
    halves = [{lang: p[h::2] for lang, p in parts.items() if p[h::2]} for h in (0, 1)]
    kept: dict[str, list[bytes]] = {lang: [] for lang in parts}
    for h in (0, 1):
        judge = coders({lang: b"".join(p) for lang, p in halves[1 - h].items()}, level)
        for lang, texts in halves[h].items():
            for text in texts:
                for i in range(0, len(text), piece):
                    part = text[i : i + piece]
                    if lang not in judge or min((len(c.compress(part)), other != lang) for other, c in judge.items())[1] is False:
                        kept[lang].append(part)
    return {lang: b"".join(kept[lang] or parts[lang]) for lang in sorted(parts)}


def fit_languages(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 600,
    bytes_per_language: int = 1_200_000,
    **options: object,
) -> LanguageModel:
    """A model of the labelled rows' languages, fitted on a bounded sample that the driver reads.

    The sample: of each language the rows of the smallest hashes, whole texts, until there are
    rows_per_language of them or they take bytes_per_language, which the last may exceed. Rows alike in
    id and text count once. Rows without id or language, and texts without a letter, are left out, as is
    a language whose sample has less than 8 bytes. With no rows left, every prediction is `und`. Other
    columns are not looked at.

    No task sorts a language: about twice the rows wanted are kept by a bound on the hash, which the
    number of distinct hashes gives, and only these are ranked.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("id", "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("hash").alias("hashes")).collect()
    total = sum(r["count"] for r in counts)
    samples: dict[str, list[str]] = {}
    if counts:
        bounds = [(r["lang"], -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * 2 * rows_per_language / r["hashes"]))) for r in counts]
        limits = labelled.sparkSession.createDataFrame(bounds, "lang string, most long")  # a row for each language
        few = rows.join(F.broadcast(limits), "lang").where("hash <= most").select("lang", "id", "text", "hash").distinct()
        order = Window.partitionBy("lang").orderBy("hash", "id", "text")
        before = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        few = few.select("lang", "text", F.row_number().over(order).alias("n"), F.coalesce(before, F.lit(0)).alias("before"))
        for r in few.where((F.col("n") <= rows_per_language) & (F.col("before") < bytes_per_language)).orderBy("lang", "n").collect():
            samples.setdefault(r["lang"], []).append(r["text"])
    parts = {lang: [letters_only(x) for x in found] for lang, found in samples.items()}
    texts = {lang: t for lang, t in cleaned(parts).items() if len(t) >= 8}
    return LanguageModel(texts, {r["lang"]: r["count"] / total for r in counts}, **options)


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The columns of docs with lang_pred, lang_score and lang_rejected; columns of these names go.

    Whole texts are encoded. Null text, text without a letter, or a model of no language gives `und`,
    score 0, rejected. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = ("lang_pred", "lang_score", "lang_rejected")
    docs = docs.drop(*added)
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, text_col, 1 << 20):
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(added, kinds, strict=True))])
    return docs.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training; rows without id are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify_languages(picked, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

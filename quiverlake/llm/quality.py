"""Quality rules, line first: lines that fail go, then documents that lose too much. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_SEPARATORS, let, read_table

#: Fixed patterns of the line rules; the SQL below uses them too.
SENTENCE_MARK = r"[.!?;:…。！？]"
SYMBOLS = r"[#*$%&|<>{}=_~^@\\/]"
NAVIGATION_MARK = r"[|»›•·]"
BOILERPLATE = (
    r"(?i)\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|enable javascript|click here|"
    r"sign (in|up)|log in|subscribe (now|to)|powered by|skip to (main )?content|lorem ipsum)\b"
)
WORD, LONG_LINE, MARKS = r"[^\x20\x09-\x0D]+", 10, 3


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule: ten words without a sentence mark, symbols for a third of its
    characters or more, three navigation marks, or a boilerplate phrase."""
    words = F.regexp_count(line, F.lit(WORD))
    chars = F.length(line) - F.regexp_count(line, F.lit(r"[\x20\x09-\x0D]"))
    return (
        ((words >= LONG_LINE) & (F.regexp_count(line, F.lit(SENTENCE_MARK)) == 0))
        | (3 * F.regexp_count(line, F.lit(SYMBOLS)) >= F.greatest(chars, F.lit(1)))
        | (F.regexp_count(line, F.lit(NAVIGATION_MARK)) >= MARKS)
        | F.rlike(line, F.lit(BOILERPLATE))
    )


def repeated_window_words(words: Column, n: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    A window's hash, its low bits replaced by the window's place, is sorted as a plain number: equal
    windows become neighbours, which are then compared word by word. No window is looked up in a list,
    so a text of n words takes n log n steps.
    """
    one = F.lit(1).cast("long")

    def pack(words: Column, low: Column) -> Column:
        return F.transform(
            F.slice(words, 1, F.size(words) - 2),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
        )

    low = F.call_function("shiftleft", one, F.length(F.bin(n))) - 1
    count = let(low, lambda low: let(words, lambda words: let(F.sort_array(pack(words, low)), lambda order: covered(order, low, words))))
    return F.when(n < 4, F.lit(0)).otherwise(count)


def covered(order: Column, low: Column, words: Column) -> Column:
    """Size of the union of the windows whose neighbour in `order` has the same words."""

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        hashes = a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(low)) == 0
        return hashes & (F.get(words, i) == F.get(words, j)) & (F.get(words, i + 1) == F.get(words, j + 1)) & (F.get(words, i + 2) == F.get(words, j + 2))

    found = F.filter(order, lambda x, k: F.coalesce(same(x, F.get(order, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(order, k + 1)), F.lit(False)))
    places = F.sort_array(F.transform(found, lambda x: x.bitwiseAND(low)))
    zero = F.lit(0).cast("long")
    end = F.struct(zero.alias("n"), zero.alias("to"))
    return F.aggregate(
        places,
        end,
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["to"])).alias("n"), (p + 3).alias("to")),
        lambda a: a["n"],
    )


def clean_lines(
    docs: DataFrame, text_col: str = "text", min_words: int = 50, repeat_percent: int = 50, lost_percent: int = 50
) -> DataFrame:
    """The columns of docs, then: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, lines_removed, clean_text, kept. Columns of these names in docs go; others may have any
    name. An empty table gives no rows, and very long texts are judged whole.

    clean_text has the lines that pass. A document is kept if it has min_words words, at most
    repeat_percent of them in repeated 3-word windows, and loses at most lost_percent of its
    characters to the line rules. Null text has no words and is not kept; its clean_text is empty. Rows
    are judged one by one, so repeated rows and null ids change nothing. No shuffle.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines_removed", "clean_text", "kept")
    own = [c for c in docs.columns if c not in names]
    row = F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row") if own else F.lit(None).alias("_row")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = docs.select(
        row,
        text.alias("_text"),
        F.array_remove(F.split(text, SPACE_SEPARATORS), "").alias("_words"),
        F.split(text, "\n").alias("_lines"),
    )
    worded = F.filter("_lines", lambda x: F.rlike(x, F.lit(WORD)))
    parts = parts.select("*", F.size("_words").alias("_n"), worded.alias("_worded"), F.filter("_lines", lambda x: ~line_fails(x)).alias("_passed"))
    lengths = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    found = parts.select(
        "_row",
        F.col("_n").cast("long").alias("n_words"),
        (F.length("_text") - F.regexp_count("_text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("_words"), F.col("_n")).cast("long").alias("n_repeat_words"),
        (F.size("_lines") - F.size("_passed")).cast("long").alias("lines_removed"),
        F.array_join("_passed", "\n").alias("clean_text"),
        lengths(F.col("_lines")).alias("_all"),
        lengths(F.col("_passed")).alias("_left"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    kept = ~F.col("base_failed") & (100 * (F.col("_all") - F.col("_left")) <= lost_percent * F.col("_all"))
    return found.withColumn("base_failed", failed).withColumn("kept", kept).select(*(F.col("_row").getField(c).alias(c) for c in own), *names)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = clean_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed")


OP9_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '{WORD}') as ws, string_split(t, chr(10)) as ls from d),
n as (select *, len(ws) as nw, list_filter(ls, lambda x: regexp_matches(x, '{WORD}')) as wl,
  list_filter(ls, lambda x: not (
    (len(regexp_extract_all(x, '{WORD}')) >= {LONG_LINE} and not regexp_matches(x, '{SENTENCE_MARK}'))
    or 3 * len(regexp_extract_all(x, '{SYMBOLS}')) >= greatest(length(x) - len(regexp_extract_all(x, '[\x20\x09-\x0D]')), 1)
    or len(regexp_extract_all(x, '{NAVIGATION_MARK}')) >= {MARKS}
    or regexp_matches(x, '{BOILERPLATE}'))) as ok from w),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from (select rid, ws, unnest(range(1, nw - 1)) as i from n)),
c as (select rid, i, count(*) over (partition by rid, s) as k from g),
r as (select rid, count(distinct i + j) as nr from c, (values (0), (1), (2)) as o(j) where k > 1 group by rid),
x as (select doc_id, cast(nw as bigint) as n_words, cast(length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')) as bigint) as word_chars,
  cast(len(regexp_extract_all(t, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(wl) - len(list_distinct(wl)) as bigint) as n_dup_lines,
  cast(coalesce(nr, 0) as bigint) as n_repeat_words, cast(len(ls) - len(ok) as bigint) as lines_removed,
  coalesce(list_sum(list_transform(ls, lambda y: length(y))), 0) as al, coalesce(list_sum(list_transform(ok, lambda y: length(y))), 0) as lf
  from n left join r using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 100 * (al - lf) <= 50 * al as kept, lines_removed from f
"""

"""Each operator against a brute-force version on small texts, with nulls, empty and long texts, ties,
repeated rows, empty tables and columns of clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from quiverlake.llm import decontamination, language, licenses, packing, perplexity, quality, sharding, simhash, substrings, urls
from quiverlake.llm.common import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of amber light"
#: doc_id, text: null and repeated ids, null, empty and long texts, copies, other scripts, odd spaces.
ROWS = [
    (1, PASSAGE + ". And then some words of its own."),
    (2, PASSAGE + ". And then some words of its own."),
    (3, "Before it. " + PASSAGE.upper() + ". After it, in capitals."),
    (4, ""),
    (5, None),
    (6, "one two"),
    (7, "Ünï İstanbul ΣΑΣ é漢字 " * 40),
    (8, "a" * 300 + " " + "na " * 200),
    (9, "\x00\x1c tabs\tand\x0blines\n\nRéleased under the MIT License.\nReleased under the MIT License."),
    (None, PASSAGE),
    (None, None),
    (3, "Before it. " + PASSAGE.upper() + ". After it, in capitals."),
    (10, ". ".join([PASSAGE[i:] for i in range(0, 60, 3)] * 12)),
    (11, "x " + PASSAGE[:49]),
    (12, "y " + PASSAGE[:50]),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), 0, "k", 1) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start int, key string, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ordered(rows):
    return sorted(rows, key=repr)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER).encode
    found = packing.pack_documents(docs, TOKENIZER, max_len=64).collect()
    assert len({r["sequence_id"] for r in found}) == len(found) and {r["offset"] for r in found} == {0}
    assert all(r["length"] == 1 << r["bucket"] <= 64 and len(r["ids"]) == 4 * r["length"] for r in found)
    whole = Counter()
    for key in {(r["doc_id"], r["doc_tokens"]) for r in found}:
        pieces = sorted((r["start"], r["ids"]) for r in found if (r["doc_id"], r["doc_tokens"]) == key)
        copies = sum(start == 0 for start, _ in pieces)
        ids = b"".join(p for _, p in pieces[::copies])
        whole[key[0], ids] += copies
    assert whole == Counter((i, np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in ROWS)
    assert packing.pack_documents(empty, TOKENIZER).count() == 0
    assert packing.binary_lengths(2500, 2048) == [2048, 256, 128, 64, 4]
    with pytest.raises(ValueError):
        packing.pack_documents(docs, TOKENIZER, max_len=100)


@pytest.mark.parametrize("text", ["it's we'll DON'T 's", "x²½ Ⅷ 12", "<|endoftext|> a <|startoftext|>", "é é ﬁ K Å", "a\x85b c d\x1ce", "😀😀 #!? ...", "ΑΣ Σ ΣΑ", "​﻿"])
def test_encoder_equals_the_tokenizer(text):
    enc = packing.WordEncoder(TOKENIZER, 4, 4)
    for t in (text, text.upper(), text * 3):
        assert enc.encode(t) == np.array(enc.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_licenses(spark, docs, empty):
    found = licenses.scan_licenses(docs).collect()
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES}
    expected = []
    for i, t in ROWS:
        w = alnum_words(t)
        at = [(k, label) for k in range(len(w)) for p, label in phrases.items() if tuple(w[k : k + len(p)]) == p]
        expected.append((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, sorted({x for _, x in at})))
    assert ordered((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found) == ordered(expected)
    assert licenses.scan_licenses(empty).count() == 0
    notice = licenses.TEMPLATES[1][1]
    words = notice.split()
    changed = " ".join([*words[:8], "indeed", *words[8:]])
    texts = [(1, f"Some text. {notice}. More."), (2, changed), (3, " ".join(words[:7])), (4, f"{notice} {PASSAGE} {notice}")]
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows[1]["labels"] == ["mit"] and rows[1]["score"] == 1 and rows[1]["spans"][0]["start"] == 2
    assert rows[2]["labels"] == ["mit"] and len(rows[2]["spans"]) == 1 and rows[2]["score"] > 0.6
    assert rows[3]["labels"] == [] and rows[3]["score"] == 0
    assert len(rows[4]["spans"]) == 2
    # both kinds of join, and spans by brute force: template words in runs that stand in the text
    everything = ROWS + [(i, t) for i, t in texts]
    table = spark.createDataFrame(everything, "doc_id long, text string")
    both = [sorted(map(str, licenses.scan_licenses(table, broadcast_bytes=n).collect())) for n in (0, 1 << 20)]
    assert both[0] == both[1]
    found = {}
    for r in licenses.scan_licenses(table).collect():
        for x in r["spans"]:
            found.setdefault((r["doc_id"], x["template"]), []).append((x["start"], x["end"], round(x["coverage"], 9)))
    expected = {}
    for i, t in dict.fromkeys(everything):
        w = alnum_words(t)
        for n, (_, text) in enumerate(licenses.TEMPLATES):
            p = alnum_words(text)
            hits = sorted((a - b, a, b) for a in range(len(w) - 3) for b in range(len(p) - 3) if w[a : a + 4] == p[b : b + 4])
            groups = []
            for hit in hits:
                if groups and hit[0] - groups[-1][-1][0] <= 3:
                    groups[-1].append(hit)
                else:
                    groups.append([hit])
            for g in groups:
                covered = {b + j for _, _, b in g for j in range(4)}
                if len(covered) / len(p) >= 0.6:
                    expected.setdefault((i, n), []).append((min(a for _, a, _ in g), max(a for _, a, _ in g) + 4, round(len(covered) / len(p), 9)))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()} and expected
    with pytest.raises(ValueError, match="fewer than 4 words"):
        licenses.scan_licenses(docs, templates=[("x", "too short")])


def brute_removal(rows, size):
    first = {}
    rank = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(first.get(b[k : k + size], 1 << 63), rank(i))
    found = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < rank(i):
                gone[k : k + size] = b"\1" * size
        found.append((i, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest(), sum(gone)))
    return found


@pytest.mark.parametrize("hot", [1 << 23, 60])
def test_substrings(spark, docs, empty, tmp_path, hot):
    spans, _ = substrings.repeated_spans(docs, hot_bytes=hot, task_bytes=500)
    by = {(r["_id"], r["_hash"]): r["_spans"] for r in spans.collect()}
    keys = substrings.keyed(docs, "doc_id", "text").select("_row.doc_id", "_text", "_id", "_hash").collect()
    found = []
    for r in keys:
        b = (r["_text"] or "").encode()
        gone = substrings.removed(np.array([0, len(b)]), pa.array([by.get((r["_id"], r["_hash"]))], pa.list_(pa.int64())))
        found.append((r["doc_id"], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(gone.sum())))
    assert ordered(found) == ordered(brute_removal(ROWS, 50))
    if hot > 60:
        cut = substrings.dedup_substrings(docs)
        assert cut.columns == docs.columns and cut.count() == docs.count()
        assert substrings.dedup_substrings(empty).count() == 0


def test_filter_tells_smallest_hashes_apart(spark):
    """Anchors are minimums of some thirty hashes: nearly all begin with zeros."""
    hashes = np.random.default_rng(5).integers(0, 1 << 64, (40_000, 31), np.uint64).min(axis=1).view(np.int64)
    keys, others = hashes[:20_000], hashes[20_000:]
    passes = substrings.Filter.of(spark.createDataFrame([(x,) for x in keys.tolist()], "anchor long"), "anchor", len(keys))
    assert passes(keys).all() and passes(others).mean() < 0.05


def test_rounds_bound_the_strings_of_each(spark, monkeypatch):
    """Where all anchors are shared, strings take several times the text: more rounds come, and none holds more than its share."""
    write, sizes = substrings.Scratch.write, []

    def spy(self, df, name):
        found = write(self, df, name)
        if name.startswith("distinct"):
            sizes.append(found.selectExpr("coalesce(sum(octet_length(string) + 24), 0)").first()[0])
        return found

    monkeypatch.setattr(substrings.Scratch, "write", spy)
    monkeypatch.setattr(substrings, "ENOUGH", 0, raising=False)
    text = " ".join(str(k * k) for k in range(4000))
    rows = [(i, text[i:] if i % 2 else text[: len(text) - i]) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans, _ = substrings.repeated_spans(docs, **{"sampled": 1} if hasattr(substrings, "rounds_for") else {})
    assert [r["_id"] for r in spans.collect()] == [1]
    assert len(sizes) >= 5 and max(sizes) <= 2 * len(text)
    assert substrings.rounds_for(1 << 20, 1 << 19, 2, 0.9, 64) == 2 and substrings.rounds_for(10 << 20, 27 << 20, 2, 0.9, 64) == 3


def test_cuts_keep_whole_characters(spark):
    rows = [(1, "é" * 40 + "x"), (2, "ab" + "é" * 40 + "ü"), (3, None)]
    cut = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert cut == {1: "é" * 40 + "x", 2: "abü", 3: None}


@pytest.mark.parametrize("full", [False, True])
def test_blocks_and_repeated_rows(spark, monkeypatch, full):
    """Texts that cross the blocks, a filter so full that the exact join follows, and equal rows of no id."""
    build = substrings.Filter.of.__func__

    def of(cls, *args):
        made = build(cls, *args)
        made.full = full
        return made

    monkeypatch.setattr(substrings.Filter, "of", classmethod(of))
    long = " ".join(str(k * k) for k in range(30_000 if full else 70_000))
    edge = substrings.BLOCK
    rows = [(1, long), (2, long[100:1500] + " and so on"), (3, long[edge - 300 : edge + 300] + long[700:900])] + [(None, "y" + long[30:200])] * 60
    spans, _ = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    by = {(r["_id"], r["_hash"]): r["_spans"] for r in spans.collect()}
    assert len(by) == 3 and max(map(len, by.values())) < 300
    found = []
    for r in substrings.keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect():
        b = r["_text"].encode()
        gone = substrings.removed(np.array([0, len(b)]), pa.array([by.get((r["_id"], r["_hash"]))], pa.list_(pa.int64())))
        found.append((r["_row"]["doc_id"], hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int(gone.sum())))
    assert ordered(found) == ordered(brute_removal(rows, 50))


def test_cuts_leave_columns_of_any_name(spark):
    rows = [(1, PASSAGE, "a", 1, [2], "r"), (2, PASSAGE, "b", 3, [4], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _hash int, _spans array<int>, _row string")
    cut = substrings.dedup_substrings(docs)
    assert cut.columns == docs.columns and ordered(map(tuple, cut.collect())) == [rows[0], (2, "", *rows[1][2:])]


def test_registered_query_counts_spans(spark, tmp_path):
    rows = [(1, PASSAGE + "!" + PASSAGE[::-1]), (2, "x" + PASSAGE + "#" + PASSAGE[::-1] + "y"), (3, PASSAGE), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in substrings.op3_suffix_array_dedup(spark, str(tmp_path)).collect()}
    n = len(PASSAGE)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"]) for i, r in found.items()} == {1: (2 * n + 1, 0, 0), 2: (2 * n + 3, 2 * n, 2), 3: (n, n, 1), 4: (0, 0, 0), 5: (0, 0, 0)}
    assert found[2]["kept_sha256"] == hashlib.sha256(b"x#y").hexdigest()


def test_returned_columns_may_have_any_name(spark):
    names = ("_id", "_hash", "_n", "_text", "_words", "_lines", "_passed", "_all", "_left", "_worded", "_row")
    docs = spark.createDataFrame([(1, PASSAGE, *names), (2, PASSAGE, *names), (None, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and ordered(map(tuple, kept.collect())) == ordered([(1, PASSAGE, *names), (None, None, *names)])
    judged = quality.clean_lines(docs)
    assert judged.columns[: len(docs.columns)] == docs.columns and ordered(tuple(r)[: len(docs.columns)] for r in judged.collect()) == ordered(map(tuple, docs.collect()))


def test_window_minimums_on_random_strings():
    rng = np.random.default_rng(3)
    strings = [bytes(rng.integers(97, 99, rng.integers(30, 60)).astype(np.uint8)) for _ in range(40)] + [b"\0" * 40, b"\0" * 41]
    strings += [s[:35] for s in strings[:10]]
    lows, size = rng.permutation(len(strings)).astype(np.int64), 9
    least = {}
    for s, low in zip(strings, lows.tolist(), strict=True):
        for k in range(len(s) - size + 1):
            least[s[k : k + size]] = min(low, least.get(s[k : k + size], low))
    for s, found in zip(strings, substrings.window_minimums(strings, lows, size), strict=True):
        assert found.tolist() == [least[s[k : k + size]] for k in range(len(s) - size + 1)]


def test_perplexity(docs, empty):
    found = perplexity.score_documents(docs, burn_in=1, samples=2).collect()
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    tokens = [(i, [*space_words(t), ""]) for i, t in ROWS]
    c = Counter(w for i, v in tokens if learn(i) for w in v)
    total, distinct = sum(c.values()), len(c)
    base = lambda v: sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in v)
    expected = [(i, not learn(i), len(v), sum(c[w] > 0 for w in v), total, round(base(v), 6)) for i, v in tokens]
    assert ordered((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == ordered(expected)
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) and r["perplexity"] >= 1 for r in found)
    assert perplexity.score_documents(empty, burn_in=0, samples=1).count() == 0


def model_of(spark, texts, **options):
    rows = spark.createDataFrame([(t, True) for t in texts], "text string, learn boolean")
    counts = Counter(w for t in texts for w in [*space_words(t), ""])
    top = [b"", *(w.encode() for w, _ in counts.most_common() if w)]
    return perplexity.fit(rows, top, Scratch(spark, "t"), **options), top, counts


def test_anchors_are_counted_a_group_at_a_time():
    """op3 went beyond its processor time where every anchor of every text was a row of its own."""
    rng = np.random.default_rng(8)
    low, high = -(1 << 63), (1 << 63) - 1
    pool = rng.integers(low, high, 3000)
    key = np.concatenate([rng.choice(pool, 6000), rng.integers(low, high, 20000)])
    ids = rng.choice(np.array([low, -1, 0, 1, 1 << 40, substrings.LAST]), len(key))
    found = {}
    for k, i in zip(key.tolist(), ids.tolist(), strict=True):
        found.setdefault(k, set()).add(i)
    parts = [substrings.grouped_anchors(key[a::3], ids[a::3]) for a in range(3)]
    assert all(p.num_rows <= 1 << substrings.GROUP_BITS for p in parts)
    table = pa.Table.from_batches(parts)
    shared = [substrings.shared_anchors(table.filter(pc.equal(table.column("part"), x))).column("anchor").to_pylist() for x in set(table.column("part").to_pylist())]
    assert sorted(k for x in shared for k in x) == sorted(k for k, x in found.items() if len(x) > 1)


def test_model_probabilities_sum_to_one_in_every_context(spark):
    model, top, counts = model_of(spark, [PASSAGE + " the the fox " * 5, "the lazy dog " * 9, "unseen"], burn_in=1, samples=2)
    found = {bytes(r["word"]): r for r in model.words.collect()}
    assert {w.decode(): r["c"] for w, r in found.items()} == dict(counts)
    numbers, c, log_p = perplexity.frequent_scores(model, top)
    known = (10.0 ** log_p.astype(float)).sum(axis=0)
    unigram = np.array([np.frombuffer(r["unigram"], "<f4") for r in found.values()]).sum(axis=0)
    # what a context leaves to words that training has not met: its back-off times what the unigram leaves
    assert np.allclose(known + (model.back_off * (1 - unigram)[:, None]).mean(axis=0), 1, atol=1e-4) and (known < 1).all()
    speller = perplexity.Speller.seat(np.array([5, 300000], np.int64), np.array([9, 4], np.int64), 1)
    assert np.allclose(speller.predictive().reshape(-1, perplexity.SYMBOLS).sum(1), 1, atol=1e-4)


def test_scores_know_the_word_before_and_not_the_partition(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join("red apple" if x else "green leaf" for x in rng.integers(0, 2, 30)) for _ in range(40)] + ["w " * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "red apple green leaf"), (1001, "apple red leaf green"), (1002, "red zebra"), (1003, "red qqqqq")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = ({r["doc_id"]: r["score"] for r in perplexity.score_documents(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], abs=1e-9) for i in one)
    assert one[1000] > one[1001] + 1 and one[1002] != one[1003]


def test_every_word_is_a_context_of_its_own(spark):
    """Words beyond the 255 most frequent shared one restaurant as contexts."""
    rng = np.random.default_rng(6)
    learned, held = ([i for i in range(20000) if (zlib.crc32(str(i).encode()) % 10 == 0) == x] for x in (False, True))
    texts = [" ".join(f"a{i} b{i}" for i in rng.permutation(300)) for _ in range(12)]
    right, wrong = ({held[2 * i + k]: f"a{i} b{(i + k) % 300}" for i in range(300)} for k in (0, 1))
    docs = spark.createDataFrame([*zip(learned, texts), *right.items(), *wrong.items()], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in perplexity.score_documents(docs).collect()}
    assert all(score[a] > score[b] + 1 for a, b in zip(right, wrong, strict=True))
    model, top, _ = model_of(spark, texts)
    numbered = {w.decode() for w in top[: perplexity.CONTEXT_WORDS - 1]}
    counts = Counter(p for t in texts for p in zip([""] + t.split(), [*t.split(), ""]))
    found = {}
    for r in model.rare.collect():
        contexts, words = (r[x].split(b" ") for x in ("contexts", "words"))
        context, word, c, t = (np.frombuffer(r[x], k) for x, k in (("context", "<u4"), ("word", "<u4"), ("customers", "<i4"), ("samples", "<i4")))
        found |= {(contexts[a].decode(), words[b].decode()): n for a, b, n in zip(context, word, c, strict=True)}
        assert all(((x >= 1) & (x <= c)).all() for x in t.reshape(2, -1))
    assert found == {p: n for p, n in counts.items() if p[0] not in numbered} and len(found) > 300


def test_rare_words_go_through_postings(spark, monkeypatch):
    """Words beyond the frequent ones give the same scores by the join, with more than 255 of one in a text."""
    rows = [(i, f"{PASSAGE} w{i} " + "na " * (300 * (i == 3))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    score = lambda: {r["doc_id"]: (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in perplexity.score_documents(docs).collect()}
    whole = score()
    fitted, contexts = perplexity.frequent_scores, perplexity.FREQUENT_WORDS
    assert contexts > 100
    monkeypatch.setattr(perplexity, "frequent_scores", lambda model, top: fitted(model, top[:1]))
    split = score()
    assert all(split[i] == pytest.approx(whole[i], rel=1e-5) for i in whole) and whole.keys() == split.keys()


def test_seating_follows_the_process():
    """Tables against a sampler of one customer and one dish at a time."""
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for n, parent in ((50, 0.02), (400, 0.05)):
        mean = perplexity.tables(np.full(4000, n), 0.5, np.full(4000, 40.0), np.full(4000, parent), keys).mean()
        t = np.ones(20000)
        for k in range(1, n):
            w = (40 + 0.5 * t) * parent
            t += rng.random(20000) < w / (k - 0.5 * t + w)
        assert mean == pytest.approx(t.mean(), rel=0.03)
    assert perplexity.tables(np.array([0, 1, 1]), 0.5, np.ones(3), np.ones(3), keys[:3]).tolist() == [0, 1, 1]


def test_language(spark, docs, empty):
    words = {"en": "the and of with that house river always morning", "de": "der und die mit dass haus fluss immer morgen", "fr": "le et la avec que maison rivière toujours matin"}
    rng = np.random.default_rng(1)
    make = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    rows = [(i, make(lang, 40), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)] + [(None, "the", "en"), (900, None, "en"), (901, "the", None)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.samples) == ["de", "en", "fr"]
    tests = [(lang, make(lang, 25)) for lang in ("en", "de", "fr") for _ in range(20)]
    assert sum(model.predict(t)[0] == lang for lang, t in tests) >= 58
    for text in (None, "", "12 34 !?", " \n"):
        assert model.predict(text) == ("und", 0.0, True)
    found = language.identify_languages(docs.withColumn("lang_pred", F.lit("x")), model)
    assert found.count() == len(ROWS) and found.columns == [*docs.columns, "lang_pred", "lang_score", "lang_rejected"]
    assert all(0 <= r["lang_score"] <= 1 for r in found.collect())
    # whole rows in the order of their hashes, copies once, up to the stated bounds
    copies = spark.createDataFrame([*rows, *[(7, "the and of", "en")] * 500], "doc_id long, text string, lang string")
    assert sum(map(len, language.fit_languages(copies, rows_per_language=3).samples.values())) <= 3 * sum(max(len(t) for _, t, lang in rows if lang == x and t) + 2 for x in words)
    few = language.fit_languages(copies, bytes_per_language=1).samples
    assert sorted(few) == ["de", "en", "fr"] and all(x.decode().strip() in {t for _, t, _ in copies.collect()} for x in few.values())
    assert language.fit_languages(copies.repartition(5)).samples == language.fit_languages(copies).samples
    nothing = language.fit_languages(empty)
    assert nothing.predict("some text") == ("und", 0.0, True) and language.identify_languages(empty, nothing).count() == 0


def brute_prints(rows):
    found = []
    for _, t in rows:
        w = space_words(t)
        runs = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
        found.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return found


def brute_components(x):
    group = list(range(len(x)))
    for i in range(len(x)):
        for j in range(i):
            if (x[i] ^ x[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_duplicates(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    prints = brute_prints(ROWS)
    group = brute_components(prints)
    ids = {}
    for (i, _), g in zip(ROWS, group, strict=True):
        ids.setdefault(g, []).append(i)
    least = {g: min((i for i in members if i is not None), default=None) for g, members in ids.items()}
    expected = [(i, simhash.signed(p), least[g]) for (i, _), p, g in zip(ROWS, prints, group, strict=True)]
    assert ordered((r["doc_id"], r["fp"], r["component_id"]) for r in found) == ordered(expected)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair(radius):
    masks = simhash.covering_masks((1 << 64) - 1, radius)
    assert len(masks) == 2 ** (radius + 1) - 1 and all(20 <= m.bit_count() <= 44 for m in masks)
    rng = np.random.default_rng(radius)
    for _ in range(2000):
        differ = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(not differ & m for m in masks)


@pytest.mark.parametrize("most", [1024, 5])
def test_links_of_crowded_buckets_are_whole(spark, most):
    rng = np.random.default_rng(2)
    x = set()
    for centre in rng.integers(0, 1 << 63, 3).tolist():
        x |= {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(60)}
    x = sorted(x)
    nodes = spark.createDataFrame([(simhash.signed(v),) for v in x], "fp long")
    scratch = Scratch(spark, "links")
    links = simhash.fingerprint_links(nodes, scratch, 3, most)
    named = simhash.components(nodes.withColumn("low", F.col("fp")), links, scratch)
    found = {}
    for r in named.collect():
        found.setdefault(r["root"], set()).add(r["fp"])
    expected = {}
    for v, g in zip(x, brute_components(x), strict=True):
        expected.setdefault(g, set()).add(simhash.signed(v))
    assert ordered(map(sorted, found.values())) == ordered(map(sorted, expected.values()))


def test_urls(spark):
    cases = [
        ("http://net/", "net", "/", "net/", "block"),
        ("http://a.NET/x?y", "a.net", "/x", "net/", "block"),
        ("https://www.example.net/en/1#t", "www.example.net", "/en/1", "example.net/en/", "allow"),
        ("https://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("http://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://a.net", "a.net", "", None, "allow"),
        ("no scheme.net/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("http:///net/", "", "/net/", None, "allow"),
        ("http://.net/", ".net", "/", "net/", "block"),
        ("http://ÄNET.net/", "Änet.net", "/", "net/", "block"),
    ] * 2
    pages = spark.createDataFrame([(i if i else None, c[0], 1, "h") for i, c in enumerate(cases)], "page_id long, url string, key int, host string")
    rules = spark.createDataFrame(urls.RULES + [("block", None, "/"), (None, "org", "/")], "verdict string, host string, path string")
    for parts in (1, 10_000):
        found = urls.judge_urls(pages, rules, parts=parts).collect()
        assert ordered(tuple(r) for r in found) == ordered((i if i else None, *c[1:]) for i, c in enumerate(cases))
    assert urls.judge_urls(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.where("false")).collect()} == {"allow"}
    nested = [("block", "com", "/"), ("allow", "a.com", "/"), ("block", "b.a.com", "/x/"), ("allow", "b.a.com", "/")]
    rules = spark.createDataFrame(nested, "verdict string, host string, path string")
    asked = ["http://c.b.a.com/x/1", "http://b.a.com/y", "http://z.a.com/", "http://a.com.b.com/", "http://com/"]
    found = {r["page_id"]: r["rule"] for r in urls.judge_urls(spark.createDataFrame(list(enumerate(asked)), "page_id long, url string"), rules).collect()}
    assert found == {0: "b.a.com/x/", 1: "b.a.com/", 2: "a.com/", 3: "com/", 4: "com/"}


def test_sharding(spark, docs, empty, tmp_path):
    rows, used = sharding.shard_documents(docs, shards=3, slots=16)
    found = rows.collect()
    expected = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS]
    assert ordered((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == ordered(expected)
    for s in range(3):
        places = sorted(r["slot"] for r in found if r["shard"] == s)
        assert places == list(range(len(places)))
    path = str(tmp_path / "map")
    used.save(spark, path)
    grown = used.grown()
    assert all(grown.parts[k][0] in (v[0], 3) for k, v in used.parts.items()) and grown.version == 2
    grown.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown and sharding.SlotMap.load(spark, path, 1) == used
    assert sharding.shard_documents(empty, 3)[0].count() == 0
    # copies that no hash can part, a third of all rows
    same = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'same', repeat('x', 1 + id % 40)) as text")
    rows, used = sharding.shard_documents(same, shards=4, slots=512)
    loads = used.loads()
    assert max(loads) - min(loads) <= 0.05 * sum(loads) / 4
    assert rows.count() == 3000 and rows.select("shard", "slot").distinct().count() == 3000
    # the map alone says where a record is, also once it was stored
    used.save(spark, str(tmp_path / "heavy"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "heavy")) == used and len(used.copies()) == 1
    key = "doc_id", "text_crc32"
    marks = sharding.record_slots(same, "doc_id", "text", 512, {}).select(*key, "virtual_slot", "mark").distinct()
    joined = rows.join(marks, [*key, "virtual_slot"]).collect()
    assert len(joined) == 3000 and all(r["shard"] in used.shards_of(r["virtual_slot"], r["mark"]) for r in joined)
    assert {len(used.shards_of(r["virtual_slot"], r["mark"])) for r in joined if r["doc_id"] != 7} == {1}
    # a known map keeps its parts, and other partitions change no record's place
    again, kept = sharding.shard_documents(same.repartition(5), shards=4, slots=512, known=used)
    assert kept.marks == used.marks and kept.version == used.version + 1
    where = lambda t: {(r["doc_id"], r["shard"]) for r in t.where("doc_id <> 7").collect()}
    assert len(where(again) & where(rows)) >= 0.95 * len(where(rows))


def test_slot_map_rebalances_with_whole_slots():
    m = sharding.SlotMap.balanced({(s, 0): (100 + s, 1) for s in range(200)}, 4)
    moved = m.measured({(s, 0): (100 + s + 300 * (m.parts[s, 0][0] == 0), 1) for s in range(200)}).rebalanced()
    loads = moved.loads()
    assert max(loads) <= 1.02 * sum(loads) / 4 and moved.version == 2
    loads = m.grown().loads()
    assert len(loads) == 5 and max(loads) <= 1.05 * sum(loads) / 5


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated), failed


def test_quality(docs, empty, spark):
    found = quality.clean_lines(docs.withColumn("kept", F.lit(1)).withColumn("n_words", F.lit("x"))).collect()
    assert ordered((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in found) == ordered((i, *brute_quality(t)) for i, t in ROWS)
    assert quality.clean_lines(empty).count() == 0
    prose = [" ".join(f"w{i}x{j}" for j in range(9)) + "." for i in range(20)]  # no three words recur
    bad = ["home | about | contact | search", "Please read our privacy policy.", "word " * 12, "$$$ ### %%%"]
    rows = spark.createDataFrame([(1, "\n".join(prose)), (2, "\n".join(prose[:10] + bad)), (3, "\n".join(prose[:8] + bad * 20))], "doc_id long, text string")
    judged = {r["doc_id"]: r for r in quality.clean_lines(rows).collect()}
    assert judged[1]["kept"] and judged[1]["lines_removed"] == 0
    assert judged[2]["kept"] and judged[2]["clean_text"] == "\n".join(prose[:10])
    assert not judged[3]["kept"]


def test_suffix_array_against_all_places():
    rng = np.random.default_rng(8)
    texts = [[b"abc"[k : k + 1] for k in rng.integers(0, 3, n)] for n in (0, 1, 40, 60, 60)] + [[b"a"] * 50] * 2
    array = decontamination.SuffixArray(texts)
    ends = [t + [k] for k, t in enumerate(texts)]
    suffixes = sorted((tuple(array.numbers.get(w, w) for w in t[i:]), k, i) for k, t in enumerate(ends) for i in range(len(t)))
    assert [(int(array.doc[p]), int(p - array.firsts[array.doc[p]])) for p in array.order] == [(k, i) for _, k, i in suffixes]
    items = [("x", texts[3][10:30]), ("y", [b"a"] * 20), ("z", [b"a"] * 20), ("short", [b"b", b"c"]), ("far", [b"d"] * 12)]
    found = decontamination.search(array, decontamination.Block.of(items, 5))
    best, pairs = {}, set()
    for name, words in items:
        need = min(5, len(words))
        for s in range(len(words) - need + 1):
            for k, t in enumerate(texts):
                for i in range(len(t)):
                    n = 0
                    while s + n < len(words) and i + n < len(t) and words[s + n] == t[i + n]:
                        n += 1
                    if n >= need:
                        best[k, i] = max(n, best.get((k, i), 0))
                        pairs.add((k, name))
    assert {(int(array.doc[p]), int(p - array.firsts[array.doc[p]])): int(found.best[p]) for p in np.flatnonzero(found.best)} == best
    assert {(int(x) // 5, items[int(x) % 5][0]) for x in found.pairs} == pairs
    assert decontamination.search(decontamination.SuffixArray([]), decontamination.Block.of(items, 5)) is None
    assert decontamination.search(array, decontamination.Block.of([], 5)) is None


@pytest.mark.parametrize("block_bytes", [1 << 24, 120])
def test_decontamination(spark, docs, empty, block_bytes):
    items = [(1, PASSAGE), (2, "Jumps, OVER the lazy"), (3, None), (4, "..."), (5, "one two"), (None, "of its own"), (6, PASSAGE[10:80]), (7, "never seen " * 10)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    expected = []
    for i, t in ROWS:
        w, hit, names = alnum_words(t), set(), set()
        for window, own in windows.items():
            for k in range(len(w) - len(window) + 1):
                if tuple(w[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    names |= own
        expected.append((i, len(w), len(hit), sorted(names)))
    found = decontamination.find_benchmark_matches(docs, benchmark, block_bytes=block_bytes, held_bytes=240, shard_bytes=900).collect()
    assert ordered((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found) == ordered(expected)
    kept = decontamination.decontaminate(docs, benchmark, block_bytes=block_bytes, held_bytes=240)
    assert kept.columns == docs.columns
    assert ordered(r["doc_id"] for r in kept.collect()) == ordered(i for i, _, n, _ in expected if not n)
    assert decontamination.find_benchmark_matches(empty, benchmark).count() == 0
    assert decontamination.decontaminate(docs, benchmark.where("false")).count() == len(ROWS)

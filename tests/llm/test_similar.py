"""The near-duplicate stage against a brute-force comparison of all pairs."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from quiverlake.llm import similar, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def brute(rows, threshold=0.8):
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return {i: least[g] for (i, _), g in zip(rows, group, strict=True)}


def edited_texts():
    """Texts with copies of one to nine changed words, some of them below the similarity."""
    rnd, rows = random.Random(3), []
    for k in range(30):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 300))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(k % 5):
            copy = list(words)
            for at in rnd.sample(range(len(copy)), rnd.randrange(1, 10)):
                copy[at] = f"x{rnd.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (len(rows), "two words"), (len(rows) + 1, "Two  WORDS"), (len(rows) + 2, ""), (len(rows) + 3, "")]


def test_stage_drops_what_is_alike_in_most_shingles(spark):
    rows = edited_texts()
    least = brute(rows)
    prints = [simhash.simhash(simhash.shingle_hashes(t.lower().encode().split())) for _, t in rows]
    far = [i for i, _ in rows if least[i] != i and (prints[i] ^ prints[least[i]]).bit_count() > 3]
    assert far  # links that fingerprints within the radius of op6 do not find
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("chunk", [1 << 20, 400])
def test_groups_in_chunks_lose_no_link(spark, monkeypatch, chunk):
    rows = edited_texts()
    monkeypatch.setattr(similar.similar_links, "__defaults__", (chunk,))
    found = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (None, "A b c d e f"), (4, None), (2, "  "), (7, "g"), (7, "g")]
    found = similar.drop_similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1) for r in found) == [-1, 2, 7]
    assert similar.drop_similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprints_name_candidates(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rows = [(4, " ".join(words)), (1, " ".join([*words[:299], "x"])), (9, " ".join(words[::-1]))]
    rows += [(20, " ".join(["a", "b", "c"] * 400 + words[:30])), (21, " ".join(["a", "b", "c"] * 400 + words[60:90]))]
    prints = [simhash.simhash(simhash.shingle_hashes(t.encode().split())) for _, t in rows]
    assert all((prints[i] ^ prints[i + 1]).bit_count() <= 3 for i in (0, 3)) and brute(rows) == {4: 1, 1: 1, 9: 9, 20: 20, 21: 21}
    monkeypatch.setattr(similar, "bands", lambda sets: np.arange(len(sets) * similar.BANDS).reshape(len(sets), -1) + hash(sets[0].tobytes()))  # no two alike
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 9, 20, 21]


def test_no_table_stays_that_no_plan_reads(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(similar, "Scratch", lambda s, name: found.append(simhash.Scratch(s, name)) or found[-1])
    found = []
    rows = similar.similar_documents(spark.createDataFrame(edited_texts()[:20], "doc_id long, text string"))
    assert os.listdir(found[0].path.removeprefix("file://")) == ["found"] and rows.count() == 20

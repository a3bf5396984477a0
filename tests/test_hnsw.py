import numpy as np
import pyarrow as pa
import pytest

from quiverlake.operators import hnsw, metrics
from quiverlake.operators.search import topk_batch
from quiverlake.sources.datagen import grid_vectors

SCHEMA = "ord long, id string, values array<float>"


def table(spark, rows):
    return spark.createDataFrame([(i, name, [float(x) for x in v]) for i, (name, v) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("bad", [{"dimension": 0}, {"dimension": 2, "M": 0}, {"dimension": 2, "M": 1}, {"dimension": 2, "M": 2**64 - 1}, {"dimension": 2, "M": 4, "ef_construction": 3}, {"dimension": 2, "ef_search": 0}])
def test_invalid_settings(bad):
    with pytest.raises(ValueError):
        hnsw.HnswConfig(**bad)


def test_level_counts():
    levels = np.array(hnsw.layer_levels(100_000, 16, 42))
    assert [(levels >= k).sum() for k in (1, 2, 3)] == [6366, 419, 16]


def test_twister():
    source = hnsw.Mersenne64(5489)
    assert [source.draw() for _ in range(10000)][-1] == 9981545732273789042


def graph(data, ids=None, **options):
    config = hnsw.HnswConfig(data.shape[1], **options)
    return hnsw.ShardGraph.build(ids or [str(i) for i in range(len(data))], data, config, config.seed)


def ask(g, q, k, ef):
    return next((found for _, found in g.search(np.asarray(q)[None, :], k, ef)), [])


def slow_search(g, q, k, ef):
    """A traversal of its own, one node at a time, over plain lists."""
    links, score = g.links(), lambda i: exact(g.v[i : i + 1].astype(np.float32), [g.ids[i]], np.asarray(q, np.float32), 1)[0][1]
    better = lambda i: (-score(i), g.ids[i].encode())
    at = max(range(len(links)), key=lambda i: (len(links[i]), -i))
    for layer in range(len(links[at]) - 1, -1, -1):
        width = ef if layer == 0 else 1
        known, done = {at}, set()
        while True:
            top = sorted(known, key=better)[:width]
            todo = [i for i in top if i not in done]
            if not todo:
                break
            done.add(todo[0])
            known.update(links[todo[0]][layer])
        at = top[0]
    return [(g.ids[i], score(i)) for i in top[:k]]


def test_search_takes_the_steps_of_a_plain_traversal():
    data = grid_vectors(220, 6)
    g = graph(data[:200], M=4, ef_construction=20)
    for q in data[200:]:
        for k, ef in ((1, 1), (5, 10), (10, 40)):
            assert ask(g, q, k, ef) == slow_search(g, q, k, max(k, ef))
    many = [found for _, found in g.search(data[200:], 5, 10, cells=600)]  # three queries at a time
    assert many == [ask(g, q, 5, 10) for q in data[200:]]


def test_saved_graphs_and_added_rows(spark, tmp_path):
    data = grid_vectors(130, 8)
    rows = [(str(i), v) for i, v in enumerate(data[:120])]
    config = hnsw.HnswConfig(8, M=4, ef_construction=20)
    index = hnsw.HnswIndex.from_dataframe(table(spark, rows[:80]), config).add(table(spark, rows[80:]), shard_rows=20)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data[120:])], "query_id long, qvalues array<float>")
    assert index.shards == 3 and sorted(index.search_batch(queries, 5, 120).collect()) == sorted(topk_batch(table(spark, rows), queries, 5).collect())
    index.save(str(tmp_path / "graph"))
    again = hnsw.HnswIndex.load(spark, str(tmp_path / "graph"), config)
    assert again.shards == 3 and sorted(again.search_batch(queries, 5).collect()) == sorted(index.search_batch(queries, 5).collect())
    assert {r["n"] for r in hnsw.audit_violations(again.nodes, 4).collect()} == {0}
    with pytest.raises(ValueError):
        index.add(table(spark, rows[:1]))
    for k in (0, 3):
        with pytest.raises(ValueError):
            index.search([float("nan")] * 8, k)


def exact(data, ids, q, k):
    from quiverlake.operators.search import best_rows, exact_scores

    s = exact_scores(data, q[None, :])[:, 0]
    return [(ids[i], float(s[i])) for i in best_rows(s, ids, k)]


@pytest.mark.parametrize("dimension", [1, 3, 64])
def test_full_breadth_is_exact(dimension):
    data = grid_vectors(104, dimension)
    ids = [str(i) for i in range(100)]
    g = graph(data[:100], ids, M=2, ef_construction=8)
    for q in data[100:]:
        for k in (1, 10, 100, 101):
            assert ask(g, q, k, 100) == exact(data[:100], ids, q, k)
    assert len(ask(g, data[100], 20, 1)) == 20


def test_full_breadth_follows_links_once_for_all_queries(monkeypatch):
    data = grid_vectors(430, 5)
    g = graph(data[:400], M=4, ef_construction=20)
    layers, beam = [], g.beam
    monkeypatch.setattr(g, "beam", lambda *a: layers.append(a[-1]) or beam(*a))
    for q in data[400:]:
        assert ask(g, q, 400, 1) == exact(data[:400], g.ids, q, 400)
        assert ask(g, q, 7, 1000) == exact(data[:400], g.ids, q, 7)
    assert 0 not in layers  # the walk of single steps sorts all kept nodes at each


def test_full_breadth_finds_only_what_links_reach():
    data = grid_vectors(51, 5)
    g = graph(data[:50], M=4, ef_construction=20)
    g.top, g.entry = 0, 0
    g.layers[0][20:], g.layers[0][g.layers[0] >= 20] = -1, -1  # links of a graph that came from elsewhere
    assert ask(g, data[50], 50, 50) == exact(data[:20], g.ids, data[50], 50)


@pytest.mark.parametrize("value", [0.0, 1.0])
def test_equal_vectors_stay_in_reach(value):
    ids = [str(i) for i in range(99, -1, -1)]
    g = graph(np.full((100, 2), value, np.float32), ids, M=2, ef_construction=4)
    assert [n for n, _ in ask(g, np.ones(2), 1000, 1)] == sorted(ids)


def test_selection():
    g = graph(np.array([[1, 0], [1, 0.02], [0, 1]], np.float32), ["a", "b", "c"], M=2, ef_construction=8)
    own = np.array([0.7071, 0.7212, 0.7071], np.float32)  # of (1, 1)
    assert g.spread(own, np.arange(3), 2, []) == [1, 2]
    g = graph(np.array([[1, 0], [2, 0], [3, 0]], np.float32), ["a", "b", "c"], M=2, ef_construction=8)
    assert g.spread(np.ones(3, np.float32), np.arange(3), 3, []) == [0, 1, 2]
    assert g.spread(np.ones(3, np.float32), np.arange(3), 2, [2]) == [2, 0]


def test_scaling_by_powers_of_two_changes_nothing():
    data = grid_vectors(60, 8)
    scaled = data * (2.0 ** (np.arange(60) % 9 - 4))[:, None].astype(np.float32)
    a, b = graph(data[:50], M=4, ef_construction=16), graph(scaled[:50].astype(np.float32), M=4, ef_construction=16)
    assert all(ask(a, q, 5, 10) == ask(b, q * 8, 5, 10) for q in data[50:])


def test_recall_and_audit(spark):
    data = grid_vectors(320, 16)
    rows = table(spark, [(str(i), v) for i, v in enumerate(data[:300])])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data[300:])], "query_id long, qvalues array<float>")
    index = hnsw.HnswIndex.from_dataframe(rows, hnsw.HnswConfig(16, M=8, ef_construction=80, ef_search=64), shards=2)
    truth = topk_batch(rows, queries, 10)
    found = metrics.recall(index.search_batch(queries, 10), truth, 10)
    assert found.agg({"recall": "avg"}).first()[0] >= 0.95
    assert sorted(index.search_batch(queries, 10, 300).collect()) == sorted(truth.collect())
    assert {r["n"] for r in hnsw.audit_violations(index.nodes, 8).collect()} == {0}
    assert {r["reachable"] for r in hnsw.reachable(index.nodes).collect()} == {150}
    assert 0 < hnsw.reciprocal_fraction(index.nodes).first()[0] <= 1
    assert index.search_batch(queries, 0).count() == 0
    with pytest.raises(ValueError):
        index.set_ef_search(0)
    with pytest.raises(ValueError):
        hnsw.HnswIndex.from_dataframe(table(spark, [("a", (1, 2)), ("a", (2, 3))]), hnsw.HnswConfig(2))


def test_searches_of_all_rows_score_few_pairs_one_by_one(monkeypatch):
    """recall_full_breadth ran out of time on large tables, where all pairs were summed dimension by dimension."""
    from quiverlake.operators import hnsw, search

    rng = np.random.default_rng(5)
    data = rng.normal(size=(3000, 16)).astype(np.float32)
    data[100:160], data[7] = data[100], 0  # a group of copies, and a zero vector
    queries = np.concatenate([data[::50], data[[7, 100]]])
    ids = [str(i * 37 % 3000) for i in range(3000)]
    graph = hnsw.ShardGraph.build(ids, data, hnsw.HnswConfig(16), 42)
    pairs = 0

    def counted(f, at):
        def run(*args):
            nonlocal pairs
            pairs += len(args[at])
            return f(*args)

        return run

    monkeypatch.setattr(search, "pair_scores", counted(search.pair_scores, 0))
    monkeypatch.setattr(hnsw.ShardGraph, "numbers", counted(hnsw.ShardGraph.numbers, 3))
    exact = search.exact_scores(data, queries)
    truth = {j: [(ids[i], float(exact[i, j])) for i in search.best_rows(exact[:, j], ids, 10)] for j in range(len(queries))}
    assert dict(graph.search(queries, 10, 1 << 30)) == truth
    rows = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(data), pa.list_(pa.float32()))], ["id", "values"])
    for kind in ("arrow_exact", "arrow"):
        (found,) = search.local_topk(np.arange(len(queries)), queries, 10, kind)(iter([rows.slice(0, 1700), rows.slice(1700)]))
        got = {j: [] for j in range(len(queries))}
        for r in found.to_pylist():
            got[r["query_id"]].append((r["id"], r["score"]))
        assert kind == "arrow" or got == truth
        assert all(np.allclose([x for _, x in got[j]], [x for _, x in truth[j]], atol=1e-6) for j in truth)
    assert pairs < len(queries) * len(data) / 10

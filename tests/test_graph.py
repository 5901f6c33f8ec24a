"""Graphs and layers on small graphs, against numpy."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from linkloom.functions import vectors as V
from linkloom.operators import components, dense as dense_adjacency, fusion, layers as L, metrics
from linkloom.operators import graph as G
from linkloom.operators import refresh, softmax, training
from linkloom.operators.joins import HotKeys
from linkloom.plans import fixtures as fx

N = 6
# a reversed duplicate, a self-loop, a repeated pair; node 5 is isolated
EDGES = [(0, 1), (1, 0), (1, 2), (1, 2), (3, 3), (3, 4), (0, 2)]


@pytest.fixture(scope="module")
def tables(spark):
    nodes = spark.range(N).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame(EDGES, "src bigint, dst bigint")
    rng = np.random.default_rng(1)
    x = rng.normal(size=(N, 5))
    vectors = spark.createDataFrame(
        [(i, x[i].tolist()) for i in range(N)], "node_id bigint, vec array<double>"
    )
    return nodes, edges, vectors, x


@pytest.fixture(scope="module", params=["plain", "hub spread"])
def graph(request, tables):
    built = G.Graph.build(tables[0], tables[1])
    if request.param == "plain":
        return built
    return G.Graph(built.nodes, built.hops, HotKeys({1: 3, 3: 2}))


def dense():
    a = np.zeros((N, N))
    for s, d in EDGES:
        a[s, d] = a[d, s] = 1
    return a


def looped():
    a = dense()
    np.fill_diagonal(a, 1)
    return a


def matrix(df, vec="vec"):
    rows = {r.node_id: r[vec] for r in df.collect()}
    assert sorted(rows) == list(range(N))
    return np.array([rows[i] for i in range(N)])


def lin(w, x):
    return x @ w.weight.T + (0 if w.bias is None else w.bias)


def softlog(x):
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def gcn(x):
    a = looped()
    s = 1 / np.sqrt(a.sum(1))
    return (a * s[:, None] * s[None, :]) @ x


def test_adjacency(tables):
    nodes, edges, _, _ = tables
    cells = {(r.row, r.col) for r in G.adjacency(edges).collect()}
    assert cells == set(zip(*np.nonzero(dense())))


@pytest.mark.parametrize("scale,tile", [(1, 4), (10, 512), (10, 1)])
def test_dense_adjacency(spark, tables, scale, tile):
    """Also where ids have gaps: rows and columns go by their order."""
    nodes = tables[0].select((F.col("node_id") * scale - 7).alias("node_id"))
    edges = tables[1].select(*[(F.col(c) * scale - 7).alias(c) for c in ("src", "dst")])
    rows = {r.node_id: r.vec for r in dense_adjacency.adjacency_rows(nodes, edges).collect()}
    assert (np.array([rows[i * scale - 7] for i in range(N)]) == dense()).all()
    whole = np.full((N, N), -1.0)
    for t in dense_adjacency.adjacency_tiles(nodes, edges, tile=tile).collect():
        at = whole[t.row_block * tile :, t.col_block * tile :][: t.rows, : t.cols]
        assert (at == -1).all()
        at[:] = np.reshape(t.entries, (t.rows, t.cols))
    assert (whole == dense()).all()
    some = dense_adjacency.adjacency_tiles(nodes, edges, tile=1, empty=False)
    assert sorted((t.row_block, t.col_block) for t in some.collect()) == sorted(zip(*np.nonzero(dense()), strict=True))


def test_dense_adjacency_has_a_bound(tables):
    with pytest.raises(ValueError, match="at most 5 nodes"):
        dense_adjacency.adjacency_rows(*tables[:2], max_nodes=5)
    assert dense_adjacency.adjacency_rows(tables[0].limit(0), tables[1].limit(0)).count() == 0
    assert dense_adjacency.adjacency_tiles(tables[0].limit(0), tables[1].limit(0)).count() == 0


def test_tiles_without_link_are_not_filled(spark):
    """Of 25 tiles four hold a link; only these are sorted and filled, the others are made in place."""
    nodes = spark.range(9).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame([(0, 1), (0, 2), (8, 8)], "src bigint, dst bigint")
    _, cells, n = dense_adjacency._positions(nodes, edges, 9)
    placed = cells.selectExpr("row div 2 as row_block", "col div 2 as col_block", "row", "col", "value")
    empty = {(t.row_block, t.col_block): t for t in dense_adjacency._empty_tiles(placed, n, 2).collect()}
    assert set(empty) == {(i, j) for i in range(5) for j in range(5)} - {(0, 0), (0, 1), (1, 0), (4, 4)}
    for (i, j), t in empty.items():
        assert (t.rows, t.cols) == (2 - (i == 4), 2 - (j == 4)) and t.entries == [0.0] * (t.rows * t.cols)
    assert dense_adjacency.adjacency_tiles(nodes, edges, tile=2).count() == 25


@pytest.mark.parametrize("n", [3, 64, 150])
def test_listed_cells(spark, n):
    """All cells of whole rows, the same column of up to 64 rows side by side."""
    rows = spark.range(n, numPartitions=1).selectExpr("id as node_id", "transform(sequence(0, 4), d -> double(id * 10 + d)) as vec")
    got = dense_adjacency.listed_cells(rows).collect()
    assert sorted((r.node_id, r.dim, r.value) for r in got) == [(i, d, float(i * 10 + d)) for i in range(n) for d in range(5)]
    turns = 1 + sum(a.dim != b.dim for a, b in zip(got, got[1:]))
    assert turns == 5 * -(-n // 64)


def test_dense_rows_of_many_nodes(spark):
    """More nodes than 131,072, which were refused; a row is whole."""
    n = 140_000
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    edges = spark.createDataFrame([(0, n - 1), (0, 7)], "src bigint, dst bigint")
    rows = dense_adjacency.adjacency_rows(nodes, edges)
    links = rows.limit(50).selectExpr("node_id", "size(vec) as n", "aggregate(vec, 0d, (a, x) -> a + x) as links").collect()
    assert len(links) == 50 and all(r.n == n for r in links)
    assert all(r.links == {0: 2, 7: 1, n - 1: 1}.get(r.node_id, 0) for r in links)


def test_listed_cells_hold_links_only():
    """64 rows of 200,000 entries are 102 MB; what is held of them are their links."""
    width = 200_000

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            return function

    def batches():
        for i in range(64):
            row = np.zeros(width)
            row[[i, width - 1]] = 1.0
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([row])], names=["node_id", "vec"])

    tracemalloc.start()
    count, found = 0, set()
    for batch in dense_adjacency.listed_cells(Rows())(batches()):
        ids, dims, values = (batch.column(c).to_numpy() for c in ("node_id", "dim", "value"))
        count += len(ids)
        found |= {(i, d, v) for i, d, v in zip(ids[values != 0], dims[values != 0], values[values != 0])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 64 * width and found == {(i, d, 1.0) for i in range(64) for d in (i, width - 1)}
    assert peak < 50e6


def test_degrees_and_weights(graph):
    got = {r.node_id: (r.degree, r.loop_degree) for r in G.degrees(graph).collect()}
    assert got == {i: (dense()[i].sum(), looped()[i].sum()) for i in range(N)}
    d = looped().sum(1)
    weights = {(r.src, r.dst): r.weight for r in G.gcn_edge_weights(graph).collect()}
    assert set(weights) == set(zip(*np.nonzero(looped())))
    for (i, j), w in weights.items():
        assert w == pytest.approx(1 / np.sqrt(d[i] * d[j]))


@pytest.mark.parametrize("n_out", [3, 9])
def test_gcn(graph, tables, n_out):
    _, _, vectors, x = tables
    assert matrix(L.gcn_propagate(graph, vectors)) == pytest.approx(gcn(x))
    layer = fx.formula_linear(n_out, 5)
    assert matrix(L.gcn_layer(graph, vectors, layer)) == pytest.approx(lin(layer, gcn(x)))


def test_sparse_features_propagate_alike(graph, tables):
    _, _, vectors, x = tables
    ml = vectors.select("node_id", V.as_ml_vector(vectors).alias("vec"))
    assert matrix(L.gcn_propagate(graph, ml)) == pytest.approx(gcn(x))


def test_smooth_in_slices(spark, graph):
    """Wide vectors take all hops slice by slice; the slices are put together without a shuffle."""
    width = 2 * training.SLICE + 2
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, width)) * (rng.random((N, width)) < 0.2)
    vectors = spark.createDataFrame([(i, Vectors.sparse(width, np.flatnonzero(row), row[row != 0])) for i, row in enumerate(x)], ["node_id", "vec"])
    before = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sliced = training.smooth(graph, vectors, 2, width=width, whole_bytes=0)
        plan = sliced._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert matrix(sliced) == pytest.approx(gcn(gcn(x)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before["spark.sql.autoBroadcastJoinThreshold"])
    assert spark.conf.get("spark.sql.adaptive.enabled") == before["spark.sql.adaptive.enabled"]
    assert matrix(training.smooth(graph, vectors, 2, width=width)) == pytest.approx(gcn(gcn(x)))


def test_sage_and_gin(graph, tables):
    _, _, vectors, x = tables
    w1, w2 = fx.formula_linear(4, 5), fx.formula_linear(4, 5, bias=False)
    raw = lin(w1, dense() @ x) + lin(w2, x)
    want = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    assert matrix(L.sage_layer(graph, vectors, w1, w2)) == pytest.approx(want)
    for first in (fx.formula_linear(4, 5), fx.formula_linear(8, 5)):
        second = fx.formula_linear(3, first.n_out)
        hidden = np.maximum(lin(first, x + dense() @ x), 0)
        got = matrix(L.gin_layer(graph, vectors, L.Mlp((first, second), last_relu=True)))
        assert got == pytest.approx(np.maximum(lin(second, hidden), 0))


def np_gat(x, layer):
    h = lin(layer.project, x).reshape(N, layer.heads, layer.width)
    s = (h * layer.source).sum(2)
    d = (h * layer.target).sum(2)
    e = s[None, :, :] + d[:, None, :]  # target, source, head
    e = np.where(e > 0, e, 0.2 * e)
    e = np.where(looped()[:, :, None] > 0, e, -np.inf)
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    out = np.einsum("tsh,shw->thw", a, h)
    out = out.reshape(N, -1) if layer.concat else out.mean(1)
    return a, out + layer.bias


@pytest.mark.parametrize("concat", [True, False])
def test_gat(graph, tables, concat):
    _, _, vectors, x = tables
    layer = fx.formula_attention(5, 3, 2, concat)
    alpha, want = np_gat(x, layer)
    assert matrix(L.gat_layer(graph, vectors, layer)) == pytest.approx(want)
    for r in L.gat_attention(graph, vectors, layer).collect():
        assert r.alpha == pytest.approx(alpha[r.dst, r.src])


def test_online_softmax_merges_like_one_pass():
    rng = np.random.default_rng(2)
    keys, scores = rng.integers(0, 5, 200), rng.normal(size=(200, 3)) * 300
    mass, sums = rng.random((200, 3)), rng.normal(size=(200, 6))
    states = np.concatenate([scores, mass, sums], axis=1)
    whole = softmax.combine(keys, states, 3)
    halves = [softmax.combine(keys[part], states[part], 3) for part in (slice(0, 70), slice(70, 71), slice(71, 200))]
    merged = softmax.combine(*(np.concatenate(x) for x in zip(*halves, strict=True)), 3)
    assert (whole[0] == merged[0]).all() and np.allclose(whole[1], merged[1])
    for key, state in zip(*whole, strict=True):
        here = keys == key
        factor = np.exp(scores[here] - scores[here].max(0))
        want = np.concatenate([scores[here].max(0), (mass[here] * factor).sum(0), (sums[here] * np.repeat(factor, 2, axis=1)).sum(0)])
        assert np.allclose(state, want)


@pytest.mark.parametrize("held", [1, 1 << 15])
def test_attention_at_a_hub(spark, monkeypatch, held):
    """One target with scores far apart, over many batches and tasks."""
    monkeypatch.setattr(softmax, "HELD", held)
    n = 3000
    x = np.random.default_rng(8).normal(size=(n, 2)) * 200
    layer = L.Attention(V.Linear(np.eye(2), None), np.array([[1.0], [2.0]]), np.array([[0.5], [0.1]]))
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node_id bigint, vec array<double>").repartition(5)
    edges = spark.range(1, n).select(F.col("id").alias("src"), F.lit(0).cast("bigint").alias("dst"))
    built = G.Graph.build(spark.range(n).withColumnRenamed("id", "node_id"), edges)
    got = {r.node_id: r.vec for r in L.gat_layer(built, vectors, layer).collect()}
    e = x * [1.0, 2.0] + x[0] * [0.5, 0.1]
    e = np.where(e > 0, e, 0.2 * e)
    a = np.exp(e - e.max(0))
    assert got[0] == pytest.approx((a * x).sum(0) / a.sum(0)) and len(got) == n


def test_attention_is_one_aggregation(graph, tables):
    layer = fx.formula_attention(5, 3, 2, True)
    plan = L.gat_layer(graph, tables[2], layer)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0 and plan.count("RepartitionByExpression") == 1
    if not graph.hot:
        assert plan.count("Join") == 2


LINKS = [(0, 1, 2.0), (1, 0, 3.0), (1, 2, 1.0), (1, 2, 0.5), (3, 3, 4.0), (3, 4, 1.5), (0, 2, 1.0), (2, 4, 0.0), (2, 5, None), (4, 5, -1.0)]


@pytest.mark.parametrize("merge", ["max", "sum"])
def test_layers_on_weighted_graphs(spark, tables, merge):
    nodes, _, vectors, x = tables
    edges = spark.createDataFrame(LINKS, "src bigint, dst bigint, weight double")
    a = np.zeros((N, N))
    for s, d, w in LINKS:
        if w and w > 0:
            a[s, d] = a[s, d] + w if merge == "sum" else max(a[s, d], w)
    a = np.where(np.eye(N) > 0, a, a + a.T if merge == "sum" else np.maximum(a, a.T))
    looped = a + np.diag(np.where(np.diag(a) > 0, 0.0, 1.0))
    graph = G.Graph.build(nodes, edges, merge=merge)
    assert {(r.row, r.col): r.value for r in G.adjacency(edges, merge=merge).collect()} == {(i, j): a[i, j] for i, j in zip(*np.nonzero(a), strict=True)}
    scale = 1 / np.sqrt(looped.sum(1))
    want = looped * scale[:, None] * scale[None, :]
    got = {(r.src, r.dst): r.weight for r in G.gcn_edge_weights(graph).collect()}
    assert got == pytest.approx({(i, j): want[i, j] for i, j in zip(*np.nonzero(want), strict=True)})
    assert matrix(L.gcn_propagate(graph, vectors)) == pytest.approx(want @ x)
    w1, w2 = fx.formula_linear(4, 5), fx.formula_linear(4, 5, bias=False)
    raw = lin(w1, a @ x) + lin(w2, x)
    assert matrix(L.sage_layer(graph, vectors, w1, w2)) == pytest.approx(raw / np.linalg.norm(raw, axis=1, keepdims=True))
    assert matrix(L.gin_layer(graph, vectors, L.Mlp((w1,)))) == pytest.approx(lin(w1, x + a @ x))
    layer = fx.formula_attention(5, 3, 2, True)
    h = lin(layer.project, x).reshape(N, 3, 2)
    e = (h * layer.source).sum(2)[None] + (h * layer.target).sum(2)[:, None]
    mass = np.exp(np.where(e > 0, e, 0.2 * e)) * looped[:, :, None]
    alpha = mass / mass.sum(1, keepdims=True)
    assert matrix(L.gat_layer(graph, vectors, layer)) == pytest.approx(np.einsum("tsh,shw->thw", alpha, h).reshape(N, -1) + layer.bias)
    for r in L.gat_attention(graph, vectors, layer).collect():
        assert r.alpha == pytest.approx(alpha[r.dst, r.src])
    with pytest.raises(ValueError, match="unknown merge"):
        G.adjacency(edges, merge="mean")


def test_weights_of_one_change_nothing(spark, tables):
    nodes, edges, vectors, _ = tables
    plain, ones = G.Graph.build(nodes, edges), G.Graph.build(nodes, edges.withColumn("weight", F.lit(1.0)))
    layer, attention = fx.formula_linear(3, 5), fx.formula_attention(5, 3, 2, False)
    for apply in (
        lambda g: L.gcn_layer(g, vectors, layer), lambda g: L.sage_layer(g, vectors, layer, layer.without_bias()),
        lambda g: L.gin_layer(g, vectors, L.Mlp((layer,))), lambda g: L.gat_layer(g, vectors, attention),
    ):
        assert matrix(apply(ones)) == pytest.approx(matrix(apply(plain)))


def test_models(graph, tables):
    _, _, vectors, x = tables
    a, b, c = fx.formula_linear(4, 5), fx.formula_linear(4, 4), fx.formula_linear(3, 4)
    hidden = np.maximum(lin(a, gcn(x)), 0)
    assert matrix(L.gcn_forward(graph, vectors, (a, c))) == pytest.approx(softlog(lin(c, gcn(hidden))))
    state = lin(b, gcn(hidden))
    assert matrix(L.gcn2_state(graph, vectors, (a, b))) == pytest.approx(state)
    want = softlog(lin(c, np.maximum(state, 0)))
    assert matrix(L.gcn2_forward(graph, vectors, (a, b, c))) == pytest.approx(want)


@pytest.mark.parametrize("weighted", [False, True])
def test_refresh_equals_full_recomputation(spark, weighted):
    rng = np.random.default_rng(4)
    n = 60
    # a long path with a few chords: a frontier stays small
    links = [(i, i + 1, 2.0) for i in range(n - 10)] + [(3, 9, 1.0), (20, 22, 3.0), (7, 7, 1.5)]
    edges = spark.createDataFrame(links, "src bigint, dst bigint, weight double")
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    built = G.Graph.build(nodes, edges if weighted else edges.drop("weight"))
    x = rng.normal(size=(n, 5))

    def frame(rows):
        return spark.createDataFrame([(i, v.tolist()) for i, v in rows], "node_id bigint, vec array<double>")

    layers = (fx.formula_linear(4, 5), fx.formula_linear(6, 4), fx.formula_linear(3, 6))
    state = refresh.node_state(built, frame(enumerate(x)), layers)
    for ids in ([0], [8, 30, 59], []):
        batch = [(i, rng.normal(size=5)) for i in ids]
        for i, v in batch:
            x[i] = v
        extra = [(999, np.zeros(5))] if ids else []
        state = refresh.refresh_node_vectors(built, state, frame([*batch, *extra]), layers)
        want = {r.node_id: r.vec for r in L.gcn2_forward(built, frame(enumerate(x)), layers).collect()}
        got = {r.node_id: r.vec for r in state.nodes.collect()}
        assert sorted(got) == list(range(n))
        assert all(got[i] == pytest.approx(want[i]) for i in range(n))
    first = refresh.frontier(built, spark.createDataFrame([(30,)], "node_id bigint"))
    assert sorted(r.node_id for r in first.collect()) == [29, 30, 31]
    assert refresh.part_of(built, first).hops.count() == 9  # three rows to each of the three


def test_wide_linear_equals_native(tables):
    _, _, vectors, x = tables
    layer = fx.formula_linear(7, 5)
    for native in (True, False):
        got = matrix(L.map_vectors(vectors, lambda v: V.linear(v, layer, native=native)))
        assert got == pytest.approx(lin(layer, x))


def test_read_linears(spark):
    rows = [("a", o, i, float(o * 3 + i)) for o in range(2) for i in range(3)] + [("a", 1, None, 5.0)]
    table = spark.createDataFrame(rows, "layer string, out int, in int, value double")
    layer = V.read_linears(table)["a"]
    assert layer.weight.tolist() == [[0, 1, 2], [3, 4, 5]] and layer.bias.tolist() == [0, 5]


def test_components(spark):
    rng = np.random.default_rng(5)
    n = 300
    edges = [tuple(int(v) for v in p) for p in rng.integers(0, n, size=(170, 2))]
    edges += [(i, i + 1) for i in range(100, 160)] + [(299, k) for k in range(200, 260)]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for s, d in edges:
        a, b = sorted((find(s), find(d)))
        parent[b] = a
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    table = spark.createDataFrame(edges, "src bigint, dst bigint")
    got = {r.node_id: r.component for r in components.connected_components(nodes, table).collect()}
    assert got == {i: find(i) for i in range(n)}
    inside, kept = components.largest_component(nodes, table)
    roots = [find(i) for i in range(n)]
    best = min(set(roots), key=lambda r: (-roots.count(r), r))
    assert {r.node_id for r in inside.collect()} == {i for i in range(n) if roots[i] == best}
    assert kept.count() == sum(find(s) == best for s, _ in edges)


def test_coauthors_without_pairs(spark, tables):
    _, _, vectors, x = tables
    wrote = {0: "ab", 1: "abc", 2: "c", 3: "a", 4: "d", 5: "dd"}
    rows = sorted({(i, a) for i, names in wrote.items() for a in names})
    table = spark.createDataFrame(rows, "node_id bigint, author string")
    b = np.array([[float(a in wrote[i]) for a in "abcd"] for i in range(N)])
    pairs = b @ b.T
    np.fill_diagonal(pairs, 0)
    assert matrix(G.coauthor_sum(table, vectors)) == pytest.approx(pairs @ x)
    assert {r.node_id: r.degree for r in G.coauthor_degree(table).collect()} == dict(
        enumerate(pairs.sum(1))
    )
    got = {(r.src, r.dst): r.weight for r in G.coauthor_edges(tables[1].distinct(), table).collect()}
    assert got == {(s, d): ((b @ b.T)[s, d]) for s, d in set(EDGES) if (b @ b.T)[s, d]}


def test_fusion(graph, tables):
    _, _, t, x = tables
    n = L.map_vectors(t, lambda v: V.scale(v, F.lit(3.0)))
    assert matrix(fusion.fuse_sum(n, t)) == pytest.approx(4 * x)
    assert matrix(fusion.fuse_concat(n, t)) == pytest.approx(np.hstack([3 * x, x]))
    assert matrix(fusion.fuse_compose(n)) == pytest.approx(3 * x)
    batch = n.filter("node_id < 2")
    want = np.vstack([3 * x[:2], x[2:]])
    assert matrix(fusion.upsert_vectors(t, batch)) == pytest.approx(want)


def test_metrics(spark):
    rows = [(0, 0, 0), (1, 0, 1), (2, 2, 2), (3, 2, 2)]
    preds = spark.createDataFrame(rows, "node_id int, label int, pred int")
    assert metrics.accuracy(preds).first()[0] == 0.75
    assert metrics.f1_micro(preds).first()[0] == pytest.approx(0.75)
    cells = {(r.label, r.pred): r.n for r in metrics.confusion_matrix(preds, 4).collect()}
    assert len(cells) == 16 and sum(cells.values()) == 4 and cells[0, 1] == 1
    table = {r.label: [r[str(k)] for k in range(4)] for r in metrics.confusion_table(preds, 4).collect()}
    assert table[2] == [0, 0, 2, 0]
    ties = spark.createDataFrame([([1.0, 3.0, 3.0],)], "scores array<double>")
    assert metrics.classify(ties).first().pred == 1

"""Queries over graphs: construction, layers, fusion, training and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import components as K
from ..operators import dense as D
from ..operators import fusion as U
from ..operators import graph as G
from ..operators import layers as L
from ..operators import metrics as M
from ..operators import ordering as O
from ..operators import refresh, seeds
from ..operators import training
from ..session import scratch_path
from ..sources import sinks
from . import checksql as S
from . import fixtures as fx
from .catalog_tables import AUTHORS
from .dataset import LinkedTexts
from .experiment import run_experiment
from .registry import long, num, query

HIDDEN = 8
CLASSES = 4

# -------------------------------------------------------------- construction


def document_graph(spark, sf):
    nodes, edges = fx.document_graph(spark, sf)
    return G.Graph.build(nodes, edges)


def vector_graph(spark, sf):
    nodes, edges = fx.vector_graph(spark, sf)
    return G.Graph.build(nodes, edges)


@query("undirected_graph", f"with {S.DOC_GRAPH} select distinct least(src, dst) as u, greatest(src, dst) as v from edges")
def undirected_graph(spark, sf):
    return G.undirected_edges(fx.document_graph(spark, sf)[1])


@query("adjacency_coo", f"with {S.DOC_GRAPH} select src as row, dst as col, 1.0::double as value from adj")
def adjacency_coo(spark, sf):
    return G.adjacency(fx.document_graph(spark, sf)[1])


@query("edge_index", f"with {S.DOC_GRAPH} select src, dst from adj")
def edge_index(spark, sf):
    return G.edge_index(fx.document_graph(spark, sf)[1])


PLACED = "pl as (select node_id, row_number() over (order by node_id) - 1 as place from nodes)"


@query(
    "adjacency_dense",
    f"with {S.VEC_GRAPH}, {PLACED} select r.node_id, c.place::integer as dim, (adj.src is not null)::integer::double as value "
    "from nodes r cross join pl c left join adj on adj.src = r.node_id and adj.dst = c.node_id",
)
def adjacency_dense(spark, sf):
    rows = D.adjacency_rows(*fx.vector_graph(spark, sf))
    return D.listed_cells(rows)


@query(
    "adjacency_tiles",
    f"with {S.VEC_GRAPH}, {PLACED}, t as (select unnest(range(((select count(*) from nodes) + 63) // 64)) as b) "
    "select x.b as row_block, y.b as col_block, count(adj.src) as links, "
    "coalesce(sum((r.place % 64) * 64 + c.place % 64) filter (where adj.src is not null), 0)::bigint as places "
    "from t x cross join t y join pl r on r.place // 64 = x.b join pl c on c.place // 64 = y.b "
    "left join adj on adj.src = r.node_id and adj.dst = c.node_id group by 1, 2",
)
def adjacency_tiles(spark, sf):
    tiles = D.adjacency_tiles(*fx.vector_graph(spark, sf), tile=64)
    # most tiles hold no link, which a scan of the array tells; the others are listed entry by entry
    some = F.when(F.array_contains("entries", 1.0), F.col("entries"))
    cells = tiles.select("row_block", "col_block", "cols", F.posexplode_outer(some).alias("at", "value"))
    place = F.floor(F.col("at") / F.col("cols")) * 64 + F.col("at") % F.col("cols")
    linked = F.col("value") == 1.0
    return cells.groupBy("row_block", "col_block").agg(
        F.count_if(linked).alias("links"), F.sum(F.when(linked, place).otherwise(0)).alias("places")
    )


@query(
    "degree",
    f"with {S.DOC_GRAPH} select node_id, (select count(*) from adj where dst = node_id) as degree, d as loop_degree from deg",
)
def degree(spark, sf):
    return G.degrees(document_graph(spark, sf))


@query("gcn_edge_weights", f"with {S.DOC_GRAPH} select src, dst, {S.num('w')} as weight from gcnw")
def gcn_edge_weights(spark, sf):
    return G.gcn_edge_weights(document_graph(spark, sf)).withColumn("weight", num("weight"))


REACH = """
reach(node_id, other) as (
  select node_id, node_id from nodes
  union select r.node_id, a.dst from reach r join adj a on a.src = r.other),
comp as (select node_id, min(other) as component from reach group by 1),
biggest as (select component from comp group by 1 order by count(*) desc, component limit 1)"""


@query("connected_components", f"with recursive {S.DOC_GRAPH}, {REACH} select node_id, component from comp")
def connected_components(spark, sf):
    return K.connected_components(*fx.document_graph(spark, sf))


@query("largest_component", f"with recursive {S.DOC_GRAPH}, {REACH} select node_id from comp where component = (select component from biggest)")
def largest_component(spark, sf):
    return K.largest_component(*fx.document_graph(spark, sf))[0]


@query(
    "largest_component_edges",
    f"with recursive {S.DOC_GRAPH}, {REACH} select src, dst from edges join comp on node_id = src where component = (select component from biggest)",
)
def largest_component_edges(spark, sf):
    return K.largest_component(*fx.document_graph(spark, sf))[1]


@query("reference_weights", "select l_orderkey as source, l_partkey as target, count(*) as weight from lineitem group by 1, 2")
def reference_weights(spark, sf):
    return G.reference_weights(
        fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))
    )


@query(
    "coauthor_edges",
    f"with {S.DOC_GRAPH}, {AUTHORS} select src, dst, count(*) as weight from edges e join doc_authors a on a.node_id = e.src "
    "join doc_authors b on b.node_id = e.dst and b.author = a.author group by 1, 2",
)
def coauthor_edges(spark, sf):
    return G.coauthor_edges(fx.document_graph(spark, sf)[1], fx.doc_authors(spark, sf))


@query(
    "coauthor_degree",
    f"with {AUTHORS}, s as (select author, count(*) as n from doc_authors group by 1) "
    "select node_id, sum(n - 1)::bigint as degree from doc_authors join s using (author) group by 1",
)
def coauthor_degree(spark, sf):
    return G.coauthor_degree(fx.doc_authors(spark, sf))


@query(
    "coauthor_sum",
    f"with {AUTHORS}, {S.VECTORS}, da as (select * from doc_authors where node_id in (select node_id from x0)), "
    "p as (select a.node_id as node_id, b.node_id as other, count(*) as w from da a join da b using (author) where a.node_id <> b.node_id group by 1, 2), "
    "s as (select p.node_id, i, sum(w * x) as x from p join x0 on x0.node_id = p.other group by 1, 2), "
    "ids as (select distinct node_id from da), g as (select node_id, unnest(range(64)) as i from ids) "
    "select node_id, i::integer as dim, round(coalesce(x, 0.0::double), 6) + 0.0::double as value from g left join s using (node_id, i)",
)
def coauthor_sum(spark, sf):
    rows = G.coauthor_sum(fx.doc_authors(spark, sf), fx.stored_vectors(spark, sf))
    return long(rows)


# --------------------------------------------------------------------- layers


def x0(spark, sf):
    return fx.stored_vectors(spark, sf)


def two(n_out=CLASSES):
    return fx.formula_linear(HIDDEN, 64), fx.formula_linear(n_out, HIDDEN)


BASE = S.with_(S.VEC_GRAPH, S.VECTORS)
BASE0 = "with" + S.VECTORS


@query("linear", f"{BASE0}, {S.linear('y', 'x0', HIDDEN, 64)}{S.rows_of('y')}")
def linear(spark, sf):
    layer = fx.formula_linear(HIDDEN, 64)
    return long(L.map_vectors(x0(spark, sf), lambda v: V.linear(v, layer)))


@query("linear_wide", f"{BASE0}, {S.linear('y', 'x0', 96, 64)}{S.rows_of('y')}")
def linear_wide(spark, sf):
    layer = fx.formula_linear(96, 64)
    return long(L.map_vectors(x0(spark, sf), lambda v: V.linear(v, layer)))


@query("relu", f"{BASE0}, {S.relu('y', 'x0')}{S.rows_of('y')}")
def relu(spark, sf):
    return long(L.map_vectors(x0(spark, sf), V.relu))


@query("log_softmax", f"{BASE0}, {S.log_softmax('y', 'x0')}{S.rows_of('y')}")
def log_softmax(spark, sf):
    return long(L.map_vectors(x0(spark, sf), V.log_softmax))


@query("l2_normalize", f"{BASE0}, {S.l2('y', 'x0')}{S.rows_of('y')}")
def l2_normalize(spark, sf):
    return long(L.map_vectors(x0(spark, sf), V.l2_normalize))


@query("one_hot", "select vec_id as node_id, d::integer as dim, (case when label = d then 1 else 0 end)::double as value from embeddings, range(10) r(d)")
def one_hot(spark, sf):
    rows = fx.predictions(spark, sf).select("node_id", V.one_hot(F.col("label"), 10).alias("vec"))
    return long(rows)


SCORES = """sc as (select vec_id as node_id, label, list_transform(range(0, 10), lambda o: list_sum(list_transform(range(0, 64),
  lambda i: embedding[i + 1]::double * (((o * 31 + i * 17) % 13 - 6)::double / 13.0::double))) + ((o * 7) % 5 - 2)::double / 10.0::double) as s from embeddings)"""


@query("argmax", f"with {SCORES} select node_id, (list_position(s, list_max(s)) - 1)::integer as pred from sc")
def argmax(spark, sf):
    return M.classify(fx.scores(spark, sf)).select("node_id", "pred")


@query("gcn_propagate", f"{BASE}, {S.propagate('y', 'x0')}{S.rows_of('y')}")
def gcn_propagate(spark, sf):
    return long(L.gcn_propagate(vector_graph(spark, sf), x0(spark, sf)))


@query("gcn_layer", f"{BASE}, {S.gcn('y', 'x0', HIDDEN, 64)}{S.rows_of('y')}")
def gcn_layer(spark, sf):
    return long(L.gcn_layer(vector_graph(spark, sf), x0(spark, sf), two()[0]))


@query("sage_layer", f"{BASE}, {S.sage('y', 'x0', HIDDEN, 64)}{S.rows_of('y')}")
def sage_layer(spark, sf):
    layer = two()[0]
    return long(L.sage_layer(vector_graph(spark, sf), x0(spark, sf), layer, layer.without_bias()))


@query("gin_layer", f"{BASE}, {S.gin('y', 'x0', (64, HIDDEN, HIDDEN), True)}{S.rows_of('y')}")
def gin_layer(spark, sf):
    mlp = L.Mlp((fx.formula_linear(HIDDEN, 64), fx.formula_linear(HIDDEN, HIDDEN)), last_relu=True)
    return long(L.gin_layer(vector_graph(spark, sf), x0(spark, sf), mlp))


HEADS, WIDTH = 8, 2


def attention_layers():
    return (
        fx.formula_attention(64, HEADS, WIDTH, concat=True),
        fx.formula_attention(HEADS * WIDTH, HEADS, CLASSES, concat=False),
    )


@query(
    "gat_attention",
    f"{BASE}, {S.attention('y', 'x0', 64, HEADS, WIDTH)} select src, dst, head::integer as head, {S.num('alpha')} as alpha from alpha_y",
)
def gat_attention(spark, sf):
    rows = L.gat_attention(vector_graph(spark, sf), x0(spark, sf), attention_layers()[0])
    return rows.select("src", "dst", F.posexplode("alpha").alias("head", "alpha")).withColumn("alpha", num("alpha"))


@query("gat_layer", f"{BASE}, {S.gat('y', 'x0', 64, HEADS, WIDTH, True)}{S.rows_of('y')}")
def gat_layer(spark, sf):
    return long(L.gat_layer(vector_graph(spark, sf), x0(spark, sf), attention_layers()[0]))


WEIGHTED = S.with_(S.WEIGHTED_GRAPH, S.VECTORS)


def weighted_graph(spark, sf):
    return G.Graph.build(*fx.weighted_graph(spark, sf), merge="sum")


@query("weighted_edge_weights", f"with {S.WEIGHTED_GRAPH} select src, dst, {S.num('w')} as weight from gcnw")
def weighted_edge_weights(spark, sf):
    return G.gcn_edge_weights(weighted_graph(spark, sf)).withColumn("weight", num("weight"))


@query("weighted_gcn_propagate", f"{WEIGHTED}, {S.propagate('y', 'x0')}{S.rows_of('y')}")
def weighted_gcn_propagate(spark, sf):
    return long(L.gcn_propagate(weighted_graph(spark, sf), x0(spark, sf)))


@query("weighted_gat_layer", f"{WEIGHTED}, {S.gat('y', 'x0', 64, HEADS, WIDTH, True, 'l.w')}{S.rows_of('y')}")
def weighted_gat_layer(spark, sf):
    return long(L.gat_layer(weighted_graph(spark, sf), x0(spark, sf), attention_layers()[0]))


GCN1 = f"{S.gcn('g1', 'x0', HIDDEN, 64)}, {S.relu('r1', 'g1')}"


@query("gcn_forward", f"{BASE}, {GCN1}, {S.gcn('g2', 'r1', CLASSES, HIDDEN)}, {S.log_softmax('y', 'g2')}{S.rows_of('y')}")
def gcn_forward(spark, sf):
    return long(L.gcn_forward(vector_graph(spark, sf), x0(spark, sf), two()))


GCN2 = f"{GCN1}, {S.gcn('g2', 'r1', HIDDEN, HIDDEN)}"


def gcn2_layers(n_out=CLASSES):
    return (
        fx.formula_linear(HIDDEN, 64), fx.formula_linear(HIDDEN, HIDDEN), fx.formula_linear(n_out, HIDDEN)
    )


def gcn2_sql(n_out=CLASSES):
    return f"{GCN2}, {S.relu('r2', 'g2')}, {S.linear('l3', 'r2', n_out, HIDDEN)}, {S.log_softmax('y', 'l3')}"


@query("gcn2_forward", f"{BASE}, {gcn2_sql()}{S.rows_of('y')}")
def gcn2_forward(spark, sf):
    return long(L.gcn2_forward(vector_graph(spark, sf), x0(spark, sf), gcn2_layers()))


@query("gcn2_state", f"{BASE}, {GCN2}{S.rows_of('g2')}")
def gcn2_state(spark, sf):
    return long(L.gcn2_state(vector_graph(spark, sf), x0(spark, sf), gcn2_layers()[:2]))


@query(
    "gin_forward",
    f"{BASE}, {S.gin('g1', 'x0', (64, HIDDEN, HIDDEN), True)}, {S.gin('g2', 'g1', (HIDDEN, HIDDEN, CLASSES), False)}, {S.log_softmax('y', 'g2')}{S.rows_of('y')}",
)
def gin_forward(spark, sf):
    square = fx.formula_linear(HIDDEN, HIDDEN)
    mlps = (
        L.Mlp((fx.formula_linear(HIDDEN, 64), square), last_relu=True),
        L.Mlp((square, fx.formula_linear(CLASSES, HIDDEN))),
    )
    return long(L.gin_forward(vector_graph(spark, sf), x0(spark, sf), mlps))


@query(
    "gat_forward",
    f"{BASE}, {S.gat('g1', 'x0', 64, HEADS, WIDTH, True)}, {S.relu('r1', 'g1')}, "
    f"{S.gat('g2', 'r1', HEADS * WIDTH, HEADS, CLASSES, False)}, {S.log_softmax('y', 'g2')}{S.rows_of('y')}",
)
def gat_forward(spark, sf):
    return long(L.gat_forward(vector_graph(spark, sf), x0(spark, sf), attention_layers()))


@query(
    "sage_forward",
    f"{BASE}, {S.sage('g1', 'x0', HIDDEN, 64)}, {S.relu('r1', 'g1')}, {S.sage('g2', 'r1', CLASSES, HIDDEN)}, {S.log_softmax('y', 'g2')}{S.rows_of('y')}",
)
def sage_forward(spark, sf):
    layers = tuple((w, w.without_bias()) for w in two())
    return long(L.sage_forward(vector_graph(spark, sf), x0(spark, sf), layers))


# --------------------------------------------------------------------- fusion


@query("gather_rows", "select vec_id as node_id, d::integer as dim, round(embedding[d + 1]::double, 6) + 0.0::double as value from embeddings, range(64) r(d) where vec_id in (select doc_id from labels)")
def gather_rows(spark, sf):
    ids = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("node_id")).distinct()
    return long(U.gather_rows(x0(spark, sf), ids))


@query(
    "upsert_vectors",
    "select vec_id as node_id, d::integer as dim, round(embedding[d + 1]::double * case when vec_id in (select doc_id from labels) then -2.0 else 1.0 end, 6) + 0.0::double as value from embeddings, range(64) r(d)",
)
def upsert_vectors(spark, sf):
    ids = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("node_id")).distinct()
    batch = L.map_vectors(U.gather_rows(x0(spark, sf), ids), lambda v: V.scale(v, F.lit(-2.0)))
    return long(U.upsert_vectors(x0(spark, sf), batch))


@query("fill_text_vectors", "select doc_id as node_id, d::integer as dim, round(embedding[d + 1]::double, 6) + 0.0::double as value from documents join embeddings on vec_id = doc_id, range(64) r(d)")
def fill_text_vectors(spark, sf):
    return long(U.fill_text_vectors(fx.texts(spark, sf).select("node_id"), x0(spark, sf)))


def _n(spark, sf):
    return U.node_vectors(vector_graph(spark, sf), x0(spark, sf), gcn2_layers(64))


@query("node_vectors", f"{BASE}, {gcn2_sql(64)}{S.rows_of('y')}")
def node_vectors(spark, sf):
    return long(_n(spark, sf))


CONCAT = "f as (select node_id, i, x from y union all select node_id, i + 64, x from x0)"
SUM = "f as (select node_id, i, y.x + x0.x as x from y join x0 using (node_id, i))"


CHANGED = "x0 as (select vec_id as node_id, unnest(range(0, 64)) as i, unnest(embedding)::double * case when vec_id % 50 = 0 then -1.0::double else 1.0::double end as x from embeddings)"


@query("refresh_node_vectors", f"{S.with_(S.VEC_GRAPH, CHANGED)}, {gcn2_sql()}{S.rows_of('y')}")
def refresh_node_vectors(spark, sf):
    graph, layers = vector_graph(spark, sf), gcn2_layers()
    state = refresh.node_state(graph, x0(spark, sf), layers)
    batch = x0(spark, sf).filter(F.col("node_id") % 50 == 0).withColumn("vec", V.scale(F.col("vec"), F.lit(-1.0)))
    return long(refresh.refresh_node_vectors(graph, state, batch, layers).nodes)


@query("fuse_concat", f"{BASE}, {gcn2_sql(64)}, {CONCAT}{S.rows_of('f')}")
def fuse_concat(spark, sf):
    return long(U.fuse_concat(_n(spark, sf), x0(spark, sf)))


@query("fuse_sum", f"{BASE}, {gcn2_sql(64)}, {SUM}{S.rows_of('f')}")
def fuse_sum(spark, sf):
    return long(U.fuse_sum(_n(spark, sf), x0(spark, sf)))


@query("fuse_compose", f"{BASE}, {gcn2_sql(64)}{S.rows_of('y')}")
def fuse_compose(spark, sf):
    return long(U.fuse_compose(_n(spark, sf)))


@query(
    "classifier_head",
    f"{BASE}, {gcn2_sql(64)}, {SUM}, {S.linear('c', 'f', CLASSES, 64)} "
    "select node_id, (list_position(list(x order by i), max(x)) - 1)::integer as pred, round(max(x), 6) + 0.0::double as score from c group by 1",
)
def classifier_head(spark, sf):
    rows = U.classifier_head(U.fuse_sum(_n(spark, sf), x0(spark, sf)), fx.formula_linear(CLASSES, 64))
    return rows.select("node_id", "pred", num(F.array_max("scores")).alias("score"))


def _labelled(spark, sf):
    rows = fx.predictions(spark, sf).select("node_id", "label")
    return O.split(rows, seed=1)


PRED = """preds as (select vec_id as node_id, label::integer as label,
  ((label + case when vec_id % 4 = 0 then 1 + vec_id % 3 else 0 end) % 10)::integer as pred from embeddings)"""
PRED_SPLIT = f"{PRED}, sp as (select node_id, label, pred, {S.MODE} as mode from {S.split_sql('preds', chr(39) + '1' + chr(39))})"
#: Fits to the optimum, so that the gradient can be checked.
EXACT = {"max_iter": 2000, "tol": 1e-12, "standardize": False}
TRAINED = "select mode, count(*) as n, true as agrees, true as optimal"


@query("train_node_classifier", f"with {PRED_SPLIT} {TRAINED} from sp group by 1")
def train_node_classifier(spark, sf):
    return training.training_report(
        training.train_node_classifier(vector_graph(spark, sf), _labelled(spark, sf), x0(spark, sf), **EXACT)
    )


SEEDED = f"{PRED}, many as (select *, unnest(range(1, 11))::integer as seed from preds), sp as (select seed, {S.MODE} as mode from {S.split_sql('many', 'seed', 'seed')})"


@query("train_ten_seeds", f"with {SEEDED} select seed, mode, count(*) as n, true as optimal from sp group by 1, 2")
def train_ten_seeds(spark, sf):
    nodes = fx.predictions(spark, sf).select("node_id", "label")
    around = training.smooth(vector_graph(spark, sf), x0(spark, sf), 2)
    models = seeds.train_seeds(nodes, around, classes=10, tol=2e-7, max_iter=1000)
    best = F.create_map(*[x for s, g in models.gradients.items() for x in (F.lit(s), F.lit(g < 1e-6))])
    return (
        seeds.predict_seeds(models).join(O.split_many(nodes), ["seed", "node_id"])
        .groupBy("seed", "mode").agg(F.count("*").alias("n")).withColumn("optimal", best[F.col("seed")])
    )


@query("train_fused_classifier", f"with {PRED_SPLIT} {TRAINED} from sp group by 1")
def train_fused_classifier(spark, sf):
    done = training.train_fused_classifier(
        vector_graph(spark, sf), _labelled(spark, sf), x0(spark, sf), fusion="concat", **EXACT
    )
    return training.training_report(done)


# -------------------------------------------------------------------- metrics

LOGP = "lp as (select node_id, label, list_transform(s, lambda x: x - list_max(s) - ln(list_sum(list_transform(s, lambda y: exp(y - list_max(s)))))) as p from sc)"
BCE = "bce as (select node_id, label, list_avg(list_transform(s, lambda x, i: greatest(x, 0.0::double) - x * (case when label + 1 = i then 1 else 0 end) + ln(1 + exp(-abs(x))))) as loss from sc)"


@query("num_labels", "select count(distinct label) as num_labels from embeddings")
def num_labels(spark, sf):
    return M.num_labels(fx.predictions(spark, sf))


@query("split_sizes", f"with {PRED_SPLIT} select mode, count(*) as n from sp group by 1 union all select 'all', count(*) from sp")
def split_sizes(spark, sf):
    return M.split_sizes(O.split(fx.predictions(spark, sf)))


@query("accuracy", f"with {PRED} select round(avg((pred = label)::integer::double), 6) as accuracy from preds")
def accuracy(spark, sf):
    return M.accuracy(fx.predictions(spark, sf)).select(num("accuracy").alias("accuracy"))


@query("accuracy_of_scores", f"with {SCORES} select round(avg((list_position(s, list_max(s)) - 1 = label)::integer::double), 6) as accuracy from sc")
def accuracy_of_scores(spark, sf):
    return M.accuracy(fx.scores(spark, sf), scores="scores").select(num("accuracy").alias("accuracy"))


@query(
    "f1_micro",
    f"with {PRED}, c as (select k, count(*) filter (label = k and pred = k) as tp, count(*) filter (label <> k and pred = k) as fp, "
    "count(*) filter (label = k and pred <> k) as fn from preds, range(10) r(k) group by 1) "
    "select round(2.0::double * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) as f1_micro from c",
)
def f1_micro(spark, sf):
    return M.f1_micro(fx.predictions(spark, sf)).select(num("f1_micro").alias("f1_micro"))


@query(
    "confusion_matrix",
    f"with {PRED} select l.k::integer as label, p.k::integer as pred, count(node_id) as n from range(10) l(k) cross join range(10) p(k) "
    "left join preds on label = l.k and pred = p.k group by 1, 2",
)
def confusion_matrix(spark, sf):
    return M.confusion_matrix(fx.predictions(spark, sf), 10)


@query("nll_loss", f"with {SCORES}, {LOGP} select round(avg(-p[label + 1]), 6) as loss from lp")
def nll_loss(spark, sf):
    rows = fx.scores(spark, sf).withColumn("logp", V.log_softmax(F.col("scores")))
    return M.nll_loss(rows).select(num("loss").alias("loss"))


@query("bce_logits_loss", f"with {SCORES}, {BCE} select round(avg(loss), 6) as loss from bce")
def bce_logits_loss(spark, sf):
    return M.bce_logits_loss(fx.scores(spark, sf), 10).select(num("loss").alias("loss"))


@query(
    "batch_mean_loss",
    f"with {SCORES}, {BCE}, b as (select (row_number() over (order by node_id) - 1) // 32 as batch_id, loss from bce), "
    "m as (select batch_id, avg(loss) as loss from b group by 1) select round(avg(loss), 6) as loss from m",
)
def batch_mean_loss(spark, sf):
    rows = fx.scores(spark, sf).select(
        "node_id", M.bce_with_logits(F.col("scores"), F.col("label"), 10).alias("loss")
    )
    ranked = O.id_rank(rows, "node_id").withColumn("batch_id", F.floor(F.col("rank") / 32))
    return M.batch_mean_loss(ranked).select(num("loss").alias("loss"))


REPORT = """select mode, count(*) as n, round(avg((pred = label)::integer::double), 4) as acc,
  round(avg((pred = label)::integer::double), 4) as f1_micro, round(avg(loss), 5) as loss"""


@query("metrics_report", f"with {PRED_SPLIT}, {SCORES}, {BCE} {REPORT} from sp join (select node_id, loss from bce) using (node_id) group by 1")
def metrics_report(spark, sf):
    losses = fx.scores(spark, sf).select(
        "node_id", M.bce_with_logits(F.col("scores"), F.col("label"), 10).alias("loss")
    )
    return M.metrics_report(O.split(fx.predictions(spark, sf)).join(losses, "node_id"))


@query(
    "evaluate_splits",
    f"""with {PRED_SPLIT}, {SCORES}, {LOGP},
ev as (select node_id, sp.label, mode, (list_position(p, list_max(p)) - 1)::integer as pred, -p[sp.label + 1] as loss from sp join lp using (node_id))
{REPORT} from ev group by 1""",
)
def evaluate_splits(spark, sf):
    logp = fx.scores(spark, sf).select("node_id", V.log_softmax(F.col("scores")).alias("logp"))
    rows = O.split(fx.predictions(spark, sf).drop("pred")).join(logp, "node_id")
    scored = M.classify(rows, scores="logp").withColumn("loss", M.nll(F.col("logp"), F.col("label")))
    return training.evaluate_splits(scored)


EPOCHS = f"""{PRED}, seeded as (select node_id, label, unnest(range(1, 4))::integer as run from preds),
sp as (select run, node_id, label, {S.MODE} as mode from {S.split_sql('seeded', 'run', 'run')}),
ep as (select run, node_id, label, mode, unnest(range(10))::integer as epoch from sp),
met as (select run, mode, epoch,
  round(avg(((node_id * 31 + epoch * 17 + run * 5) % 20 < 6 + (epoch * 7 + run * 3) % 11)::integer::double), 4) as acc
  from ep group by 1, 2, 3),
best as (select run, epoch, acc from (select *, coalesce(max(acc) over (partition by run order by epoch
  rows between unbounded preceding and 1 preceding), 0) as record from met where mode = 'valid') where acc > record)"""


@query("best_so_far", f"with {EPOCHS} select run, epoch, acc from best")
def best_so_far(spark, sf):
    return O.best_so_far(fx.epoch_metrics(spark, sf)).select("run", "epoch", "acc")


@query(
    "test_at_best",
    f"with {EPOCHS} select m.run, m.epoch, m.acc, 'best' as moment from met m join best b on b.run = m.run and b.epoch = m.epoch where m.mode = 'test' "
    "union all select run, epoch, acc, 'end' from met where mode = 'test' and epoch = 9",
)
def test_at_best(spark, sf):
    return O.test_at_best(fx.epoch_metrics(spark, sf)).select("run", "epoch", "acc", "moment")


@query("sink_metrics", f"with {EPOCHS} select run, mode, epoch, acc from met")
def sink_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    metrics = fx.epoch_metrics(spark, sf)
    for mode in ("train", "valid", "test", "valid"):  # one of them again, which changes nothing
        sinks.write_metrics(O.split_view(metrics, mode), path)
    return sinks.read_metrics(spark, path, metrics.select("run", "mode", "epoch", "acc").schema)


# ----------------------------------------------------------------- whole chain

FLAGSHIP = f"""with recursive {S.LINKED}, {S.tfidf('nodes')}, {S.HOPS},
hop as (select g.dst as node_id, term, sum(g.w * u.x) as x from gcnw g join unit u on u.node_id = g.src group by 1, 2)
select node_id, term, {S.num('x')} as value from hop"""


@query("linked_tfidf_hop", FLAGSHIP)
def linked_tfidf_hop(spark, sf):
    """Noisy articles and links to smoothed text features, end to end."""
    data = LinkedTexts.load(fx.articles(spark, sf), fx.citations(spark, sf))
    model, features = data.features()
    smoothed = L.gcn_propagate(data.create_graph(), features)
    return model.long(smoothed).withColumn("value", num("value"))


@query(
    "linked_classifier",
    f"with {S.LINKED}, sp as (select node_id, {S.MODE} as mode from {S.split_sql('nodes', chr(39) + '1' + chr(39))}) {TRAINED} from sp group by 1",
)
def linked_classifier(spark, sf):
    """Noisy articles and links to predicted classes, end to end."""
    data = LinkedTexts.load(fx.articles(spark, sf), fx.citations(spark, sf))
    return training.training_report(run_experiment(data, **EXACT).trained)

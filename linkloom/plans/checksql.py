"""Building blocks of the check SQL, as common table expressions for DuckDB."""

from __future__ import annotations

ARTICLES = """
articles as (
  select 2 * d.doc_id ord, cast(d.doc_id as varchar) pmid,
    case when d.doc_id % 37 = 5 then null
         else case d.lang when 'de' then '0' when 'en' then '1' when 'es' then '2' else '3' end end label,
    case when d.doc_id % 41 = 7 then null else d.text end abstract
  from documents d
  union all
  select 2 * d.doc_id + 1, cast(d.doc_id as varchar), '0', 'late duplicate'
  from documents d where d.doc_id % 7 = 3)"""

CLEAN = ARTICLES + """,
clean as (
  select ord, abstract as text, cast(label as integer) as label, cast(pmid as bigint) as text_id
  from (select *, row_number() over (partition by pmid order by ord) rn from articles)
  where rn = 1 and label is not null and abstract is not null)"""

CITATIONS = """
citations as (
  select case when l_linenumber = 7 and l_orderkey % 50 = 0 then null else l_orderkey end source,
         l_partkey target
  from lineitem)"""

KNOWN = CLEAN + "," + CITATIONS + """,
known as (
  select distinct source, target from citations
  where source in (select text_id from clean) and target in (select text_id from clean))"""

LINKED = KNOWN + """,
nodes as (
  select row_number() over (order by ord) - 1 as node_id, c.*
  from clean c
  where text_id in (select source from known union select target from known)),
edges as (
  select a.node_id src, b.node_id dst
  from known k join nodes a on a.text_id = k.source join nodes b on b.text_id = k.target)"""


def graph_of(name: str, id: str) -> str:
    """``nodes`` and ``edges`` among the rows of a table, plus the hop table."""
    return f"""
nodes as (select {id} as node_id from {name}),
edges as (
  select distinct l_orderkey src, l_partkey dst from lineitem
  where l_orderkey in (select node_id from nodes) and l_partkey in (select node_id from nodes)),
{HOPS}"""


HOPS = """
adj as (select src, dst from edges union select dst, src from edges),
looped as (select src, dst from adj where src <> dst union all select node_id, node_id from nodes),
deg as (select dst as node_id, count(*) as d from looped group by 1),
gcnw as (
  select l.src, l.dst, 1.0::double / sqrt(a.d::double) * (1.0::double / sqrt(b.d::double)) as w
  from looped l join deg a on a.node_id = l.src join deg b on b.node_id = l.dst)"""

WEIGHTED_GRAPH = """
nodes as (select vec_id as node_id from embeddings),
wpairs as (
  select least(l_orderkey, l_partkey) u, greatest(l_orderkey, l_partkey) v, sum(l_quantity)::double w from lineitem
  where l_orderkey in (select node_id from nodes) and l_partkey in (select node_id from nodes) group by 1, 2),
wadj as (select u src, v dst, w from wpairs union all select v, u, w from wpairs where u <> v),
looped as (
  select src, dst, w from wadj where src <> dst
  union all select node_id, node_id, coalesce(w, 1.0::double) from nodes left join (select * from wadj where src = dst) on src = node_id),
deg as (select dst as node_id, sum(w) as d from looped group by 1),
gcnw as (
  select l.src, l.dst, l.w * (1.0::double / sqrt(a.d)) * (1.0::double / sqrt(b.d)) as w
  from looped l join deg a on a.node_id = l.src join deg b on b.node_id = l.dst)"""

DOC_GRAPH = graph_of("documents", "doc_id")
VEC_GRAPH = graph_of("embeddings", "vec_id")

VECTORS = """
x0 as (select vec_id as node_id, unnest(range(0, 64)) as i, unnest(embedding)::double as x from embeddings)"""


def num(x: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    return f"round({x}, {digits}) + 0.0::double"


def weights(name: str, n_out: int, n_in: int) -> str:
    return f"""
{name} as (select o, i, ((o * 31 + i * 17) % 13 - 6)::double / 13.0::double as w
  from range({n_out}) t(o), range({n_in}) s(i))"""


BIAS = "((o * 7) % 5 - 2)::double / 10.0::double"


def linear(out: str, source: str, n_out: int, n_in: int, bias: bool = True) -> str:
    """``out(node_id, i, x)`` = W source + b."""
    plus = f" + {BIAS}" if bias else ""
    return weights(f"w_{out}", n_out, n_in) + f""",
{out} as (select node_id, o as i, sum(w * x){plus} as x
  from {source} join w_{out} using (i) group by node_id, o)"""


def propagate(out: str, source: str) -> str:
    return f"""
{out} as (select g.dst as node_id, i, sum(w * x) as x
  from gcnw g join {source} s on s.node_id = g.src group by 1, 2)"""


def relu(out: str, source: str) -> str:
    return f"\n{out} as (select node_id, i, greatest(x, 0.0::double) as x from {source})"


def log_softmax(out: str, source: str) -> str:
    return f"""
m_{out} as (select node_id, max(x) as m from {source} group by 1),
s_{out} as (select node_id, m, ln(sum(exp(x - m))) as s from {source} join m_{out} using (node_id) group by 1, 2),
{out} as (select node_id, i, x - m - s as x from {source} join s_{out} using (node_id))"""


def plain_sum(out: str, source: str, own: bool) -> str:
    """Sum over adjacency rows, with the node itself added if ``own``."""
    own_rows = f"union all select node_id, i, x from {source}" if own else (
        f"union all select node_id, i, 0.0::double from {source}"
    )
    return f"""
{out} as (select node_id, i, sum(x) as x from (
    select a.dst as node_id, i, x from adj a join {source} s on s.node_id = a.src {own_rows})
  group by 1, 2)"""


def l2(out: str, source: str) -> str:
    return f"""
n_{out} as (select node_id, sqrt(sum(x * x)) as n from {source} group by 1),
{out} as (select node_id, i, case when n > 0 then x / n else x end as x from {source} join n_{out} using (node_id))"""


def gcn(out: str, source: str, n_out: int, n_in: int) -> str:
    return propagate(f"p_{out}", source) + "," + linear(out, f"p_{out}", n_out, n_in)


def sage(out: str, source: str, n_out: int, n_in: int) -> str:
    """Both maps use the formula weights; the bias belongs to the neighbour map."""
    return ",".join([
        plain_sum(f"q_{out}", source, own=False),
        linear(f"a_{out}", f"q_{out}", n_out, n_in),
        linear(f"b_{out}", source, n_out, n_in, bias=False),
        f"""
c_{out} as (select node_id, i, a.x + b.x as x from a_{out} a join b_{out} b using (node_id, i))""",
        l2(out, f"c_{out}"),
    ])


def gin(out: str, source: str, sizes: tuple[int, ...], last_relu: bool) -> str:
    parts = [plain_sum(f"q_{out}", source, own=True)]
    name = f"q_{out}"
    for k, (n_in, n_out) in enumerate(zip(sizes, sizes[1:])):
        last = k == len(sizes) - 2
        target = out if last and not last_relu else f"l{k}_{out}"
        parts.append(linear(target, name, n_out, n_in))
        name = target
        if not last or last_relu:
            target = out if last else f"r{k}_{out}"
            parts.append(relu(target, name))
            name = target
    return ",".join(parts)


def attention(out: str, source: str, n_in: int, heads: int, width: int, weight: str = "1.0::double") -> str:
    """``h_out(node_id, i, x)`` and ``alpha_out(src, dst, head, alpha)``."""
    return ",".join([
        linear(f"h_{out}", source, heads * width, n_in, bias=False),
        f"""
sc_{out} as (select node_id, i // {width} as head,
    sum(x * (((i // {width}) * 5 + (i % {width}) * 3) % 7 - 3)::double / 7.0::double) as s,
    sum(x * (((i // {width}) * 3 + (i % {width}) * 5) % 7 - 3)::double / 7.0::double) as d
  from h_{out} group by 1, 2),
e_{out} as (select l.src, l.dst, a.head, {weight} as w, case when a.s + b.d > 0 then a.s + b.d else (a.s + b.d) * 0.2::double end as e
  from looped l join sc_{out} a on a.node_id = l.src join sc_{out} b on b.node_id = l.dst and b.head = a.head),
em_{out} as (select dst, head, max(e) as m from e_{out} group by 1, 2),
es_{out} as (select dst, head, m, sum(w * exp(e - m)) as s from e_{out} join em_{out} using (dst, head) group by 1, 2, 3),
alpha_{out} as (select src, dst, head, w * exp(e - m) / s as alpha from e_{out} join es_{out} using (dst, head))""",
    ])


def gat(out: str, source: str, n_in: int, heads: int, width: int, concat: bool, weight: str = "1.0::double") -> str:
    column, share = (f"h.i", "1.0::double") if concat else (f"h.i % {width}", f"1.0::double / {heads}")
    return attention(out, source, n_in, heads, width, weight) + f""",
{out} as (select node_id, o as i, x + {BIAS} as x from (
    select a.dst as node_id, {column} as o, sum(a.alpha * h.x) * {share} as x
    from alpha_{out} a join h_{out} h on h.node_id = a.src and h.i // {width} = a.head
    group by 1, 2))"""


def with_(*parts: str) -> str:
    return "with recursive " + ",".join(p for p in parts)


def rows_of(name: str) -> str:
    return f" select node_id, i::integer as dim, {num('x')} as value from {name}"


def split_sql(source: str, seed: str, partition: str = "", id: str = "node_id") -> str:
    """Exact split columns: rank ``r`` and total ``n`` over ``source``."""
    part = f"partition by {partition} " if partition else ""
    over_all = f"over (partition by {partition})" if partition else "over ()"
    return f"""(select *, row_number() over ({part}order by md5({seed} || ':' || {id}), {id}) - 1 as r,
       count(*) {over_all} as n from {source})"""


MODE = """case when r < floor(0.7::double * n) then 'train'
 when r < floor(0.7::double * n) + floor((1.0::double / 3) * (n - floor(0.7::double * n))) then 'valid'
 else 'test' end"""

FOLD = r"regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')"
TOKENS = rf"regexp_extract_all({FOLD}, '\b\w\w+\b')"


def tfidf(nodes: str, dim: int = 512, min_df: float = 0.001, max_df: float = 0.5) -> str:
    return rf"""
toks as (select node_id, unnest({TOKENS}) as term from {nodes}),
tf as (select node_id, term, count(*) as tf from toks group by 1, 2),
df as (select term, count(*) as df, sum(tf)::bigint as total from tf group by 1),
pruned as (select *, (select count(*) from {nodes}) as n from df
  where df >= {min_df}::double * (select count(*) from {nodes}) and df <= {max_df}::double * (select count(*) from {nodes})),
top as (select * from pruned order by total desc, term limit {dim}),
vocab as (select *, row_number() over (order by term) - 1 as col from top),
w as (select node_id, term, tf * (ln((1 + n)::double / (1 + df)) + 1) as v, tf.tf as count, col from tf join vocab using (term)),
unit as (select node_id, term, col, v / sqrt(sum(v * v) over (partition by node_id)) as x from w)"""

"""Queries over articles, links, splits and file round trips."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import articles as A
from ..operators import citations as C
from ..operators import ordering as O
from ..operators import tfidf
from ..session import scratch_path, settle, store
from ..sources import readers, sinks
from ..sources.landing import Landing
from ..streaming.ingest import ingest_new_articles
from . import checksql as S
from . import fixtures as fx
from .registry import long, num, query

FIRST_TIMES = """
firsts as (select user_id, event_type, date_trunc('second', min(ts)) as ts from events group by 1, 2),
hist as (select d.doc_id, f.event_type, f.ts from documents d
  join firsts f on f.user_id = d.doc_id % (select max(user_id) + 1 from events))"""
AUTHORS = """
doc_authors as (select distinct o_orderkey % (select count(*) from documents) as node_id, o_custkey as author from orders)"""
PAGES = """
pages_ as (select p_partkey as text_id, p_name as title from part),
links as (select a.p_name as source,
    case when b.p_partkey % 10 = 0 then 'missing ' || b.p_partkey else b.p_name end as target
  from part a join part b on b.p_partkey = a.p_partkey + 1)"""

# ------------------------------------------------------------------ articles


def n_chars():
    return F.length("abstract").cast("bigint").alias("n_chars")


def kept_articles(spark, sf):
    """``(ord, text_id, label)`` of the clean articles, found without their texts."""
    return A.clean_keys(fx.articles(spark, sf)).drop("pmid")


@query("filter_notnull", f"with {S.ARTICLES} select ord, pmid, label from articles where label is not null and abstract is not null")
def filter_notnull(spark, sf):
    return A.with_label_and_text(fx.articles(spark, sf)).select("ord", "pmid", "label")


@query("dedup_first", f"with {S.CLEAN} select ord, cast(text_id as varchar) as pmid, length(text) as n_chars from clean")
def dedup_first(spark, sf):
    return A.clean_keys(fx.articles(spark, sf), n_chars()).select("ord", "pmid", "n_chars")


@query("cast_ids", f"with {S.CLEAN} select text_id, label from clean")
def cast_ids(spark, sf):
    kept = A.with_label_and_text(A.first_per_key(A.without_texts(fx.articles(spark, sf))))
    return A.cast_ids(kept).select("text_id", "label")


@query("first_event_time", f"with {FIRST_TIMES} select doc_id, min(ts)::timestamp as time from hist group by 1")
def first_event_time(spark, sf):
    texts = fx.histories(spark, sf).withColumn(
        "history", F.transform_values("history", lambda _, v: v.cast("string"))
    )
    return texts.select("doc_id", A.first_event_time("history").alias("time"))


@query(
    "project_rename",
    f"with {S.CLEAN}, {FIRST_TIMES}, {AUTHORS}, "
    "a as (select node_id, string_agg(author, ',' order by author::varchar) as authors from doc_authors group by 1) "
    "select text, label, text_id, authors, 'Title, of ' || text_id as title, "
    "(select min(ts)::timestamp from hist h where h.doc_id = text_id) as time "
    "from clean left join a on a.node_id = text_id",
)
def project_rename(spark, sf):
    nodes = A.clean_articles(fx.articles_full(spark, sf)).drop("ord")
    return nodes.withColumn("authors", F.array_join("authors", ","))


@query(
    "history_to_string",
    f"with {FIRST_TIMES} select doc_id, event_type as event, strftime(ts, '%Y-%m-%d %H:%M:%S') as time from hist",
)
def history_to_string(spark, sf):
    return A.history_to_string(fx.histories(spark, sf)).select(
        "doc_id", F.explode("history").alias("event", "time")
    )


@query(
    "author_affiliations",
    f"with {AUTHORS} select node_id, string_agg('place ' || (author % 7), ',' order by author) as places from doc_authors group by 1",
)
def author_affiliations(spark, sf):
    listed = fx.doc_authors(spark, sf).groupBy("node_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "author",
                    F.array(F.concat(F.lit("place "), (F.col("author") % 7).cast("string"))).alias("affiliations"),
                )
            )
        ).alias("author_list")
    )
    return A.author_affiliations(listed).select(
        "node_id", F.array_join(F.flatten("author_list"), ",").alias("places")
    )


@query("drop_raw_fields", "select page_id, url from pages")
def drop_raw_fields(spark, sf):
    raw = fx.table(spark, sf, "pages").withColumnRenamed("html", "content")
    return A.drop_raw_fields(raw.withColumn("xml", F.col("content")))


@query("prefix_token", f"with {S.CLEAN} select text_id, '<GC> ' || text as text from clean")
def prefix_token(spark, sf):
    nodes = A.clean_articles(fx.articles(spark, sf))
    return A.with_context_prefix(nodes).select("text_id", "text")


@query("all_authors", f"with {AUTHORS} select distinct author from doc_authors")
def all_authors(spark, sf):
    nodes = fx.doc_authors(spark, sf).groupBy("node_id").agg(F.collect_list("author").alias("authors"))
    return A.all_authors(nodes)


@query("apply_transform", f"with {S.CLEAN} select text_id, replace(text, ' ', '_') as text from clean")
def apply_transform(spark, sf):
    nodes = A.clean_articles(fx.articles(spark, sf)).select("text_id", "text")
    return A.apply_to(nodes, "text", lambda text: F.replace(text, F.lit(" "), F.lit("_")))


@query("apply_target_transform", f"with {S.CLEAN} select text_id, label * 10 + 1 as label from clean")
def apply_target_transform(spark, sf):
    nodes = A.clean_keys(fx.articles(spark, sf)).select("text_id", "label")
    return A.apply_to(nodes, "label", lambda label: label * 10 + 1)


# --------------------------------------------------------------------- links


@query("edges_drop_null", f"with {S.CITATIONS} select source, target from citations where source is not null and target is not null")
def edges_drop_null(spark, sf):
    return C.drop_null_edges(fx.citations(spark, sf))


@query("edges_dedup", f"with {S.CITATIONS} select distinct source::varchar as source, target from citations")
def edges_dedup(spark, sf):
    # ids that may be null are compared as text
    return C.dedup_edges(fx.citations(spark, sf)).withColumn("source", F.col("source").cast("string"))


@query("edges_known_endpoints", f"with {S.KNOWN} select source, target from known")
def edges_known_endpoints(spark, sf):
    return C.clean_edges(fx.citations(spark, sf), kept_articles(spark, sf))


@query(
    "edges_encode",
    f"with {S.KNOWN}, ids as (select text_id, row_number() over (order by ord) - 1 as node_id from clean) "
    "select a.node_id as src, b.node_id as dst from known k join ids a on a.text_id = k.source join ids b on b.text_id = k.target",
)
def edges_encode(spark, sf):
    nodes = settle(kept_articles(spark, sf))
    edges = settle(C.clean_edges(fx.citations(spark, sf), nodes))
    return C.encode_edges(edges, O.dense_id_map(nodes, "ord", "text_id"))


@query("drop_isolated", f"with {S.LINKED} select text_id, label, length(text) as n_chars from nodes")
def drop_isolated(spark, sf):
    nodes = settle(A.clean_keys(fx.articles(spark, sf), n_chars()))
    edges = settle(C.clean_edges(fx.citations(spark, sf), nodes))
    return C.drop_isolated(nodes, edges).select("text_id", "label", "n_chars")


def linked_articles(spark, sf):
    """Numbered nodes and encoded edges of the noisy articles."""
    nodes = settle(A.clean_keys(fx.articles(spark, sf), n_chars()).drop("pmid"))
    edges = settle(C.clean_edges(fx.citations(spark, sf), nodes))
    return C.reindex(C.drop_isolated(nodes, edges), edges)


@query("reindex_nodes", f"with {S.LINKED} select node_id, text_id, label, length(text) as n_chars from nodes")
def reindex_nodes(spark, sf):
    nodes, _ = linked_articles(spark, sf)
    return nodes.select("node_id", "text_id", "label", "n_chars")


@query("reindex_edges", f"with {S.LINKED} select src, dst from edges")
def reindex_edges(spark, sf):
    return linked_articles(spark, sf)[1]


@query(
    "links_by_title",
    f"with {PAGES}, t as (select title, max(text_id) as text_id from pages_ group by 1) "
    "select a.text_id as source, b.text_id as target from links l left join t a on a.title = l.source left join t b on b.title = l.target "
    "where a.text_id is not null and b.text_id is not null",
)
def links_by_title(spark, sf):
    pages, links = fx.pages_and_links(spark, sf)
    return C.drop_null_edges(C.links_by_title(links, pages))


@query(
    "union_tagged",
    "select event_id as id, event_type as kind, 'events' as origin from events "
    "union all select o_orderkey, o_orderstatus, 'orders' from orders",
)
def union_tagged(spark, sf):
    events = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    orders = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return C.union_tagged({"events": events, "orders": orders}, "origin")


# ------------------------------------------------------------------ positions

DOC_IDS = "docs as (select doc_id as node_id, doc_id % 3 as label from documents)"
DOC_SPLIT = f"{DOC_IDS}, sp as (select node_id, label, {S.MODE} as mode from {S.split_sql('docs', chr(39) + '1' + chr(39))})"


def split_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("node_id"), (F.col("doc_id") % 3).alias("label")
    )
    return O.split(docs, seed=1)


@query("dense_ids", f"with {S.CLEAN} select row_number() over (order by ord) - 1 as node_id, ord, text_id from clean")
def dense_ids(spark, sf):
    nodes = settle(kept_articles(spark, sf).select("ord", "text_id"))
    return O.dense_ids(nodes, "ord").select("node_id", "ord", "text_id")


@query("split_70_10_20", f"with {DOC_SPLIT} select node_id, mode from sp")
def split_70_10_20(spark, sf):
    return split_documents(spark, sf).select("node_id", "mode")


@query(
    "split_ten_seeds",
    f"with {DOC_IDS}, seeded as (select node_id, unnest(range(1, 11))::integer as seed from docs), "
    f"sp as (select seed, node_id, {S.MODE} as mode from {S.split_sql('seeded', 'seed', 'seed')}) select seed, node_id, mode from sp",
)
def split_ten_seeds(spark, sf):
    return O.split_many(split_documents(spark, sf))


@query("split_view", f"with {DOC_SPLIT} select node_id, label, mode from sp where mode = 'valid'")
def split_view(spark, sf):
    return O.split_view(split_documents(spark, sf), "valid")


@query("labels_of_split", f"with {DOC_SPLIT} select node_id, label from sp where mode = 'test'")
def labels_of_split(spark, sf):
    return O.labels_of(split_documents(spark, sf), "test")


@query(
    "row_at",
    f"with {DOC_SPLIT}, v as (select node_id, label, row_number() over (order by node_id) - 1 as position from sp where mode = 'train') "
    "select position, node_id, label from v where position between 20 and 29",
)
def row_at(spark, sf):
    rows = O.rows_at(split_documents(spark, sf), (20, 30), mode="train")
    return rows.select("position", "node_id", "label")


BATCHES = f"""{DOC_SPLIT}, b as (
  select node_id, mode, (row_number() over (partition by mode order by
    case when mode = 'train' then md5('1:0:' || node_id) else '' end, node_id) - 1) // 32 as batch_id from sp)"""


@query("minibatches", f"with {BATCHES} select node_id, mode, batch_id from b")
def minibatches(spark, sf):
    return O.minibatches(split_documents(spark, sf)).select("node_id", "mode", "batch_id")


@query("batch_cap", f"with {BATCHES} select node_id, batch_id from b where mode = 'train' and batch_id < 150")
def batch_cap(spark, sf):
    return O.batch_cap(O.minibatches(split_documents(spark, sf))).select("node_id", "batch_id")


# ---------------------------------------------------------------- file trips


SCANNED = (
    f"with {S.ARTICLES} select row_number() over (order by ord) - 1 as position, pmid, label, abstract, 'Title of ' || pmid as title, "
    "pmid || ',' || coalesce(label, '') as authors, label as history from articles"
)


def _article_texts(spark, sf):
    """``(ord, json)``: each article as one JSON object; files have no order column."""
    raw = fx.articles(spark, sf).withColumns({
        "title": F.concat(F.lit("Title of "), "pmid"),
        "authors": F.array("pmid", F.coalesce("label", F.lit(""))),
        "history": F.create_map(F.lit("first"), "label"),
        "author_list": F.array(F.array("pmid")),
    })
    return raw.select("ord", F.to_json(F.struct(*[c for c in raw.columns if c != "ord"])).alias("json"))


def _scanned(back):
    found = O.dense_id_map(back.select("ord"), "ord", name="position").join(back, "ord")
    return found.filter(F.col("author_list")[0][0] == F.col("pmid")).select(
        "position", "pmid", "label", "abstract", "title", F.array_join("authors", ",").alias("authors"),
        F.col("history")["first"].alias("history"),
    )


@query("scan_articles_json", SCANNED)
def scan_articles_json(spark, sf):
    path = scratch_path(spark, "articles")
    # arrays of articles, a bounded number per line
    chunks = _article_texts(spark, sf).groupBy(F.floor(F.col("ord") / 500).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "json"))).alias("rows")
    )
    joined = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]"))
    chunks.repartitionByRange("chunk").sortWithinPartitions("chunk").select(joined).write.text(path)
    return _scanned(readers.read_articles(spark, path))


def _write_documents(rows, path, brackets):
    """Each task's ``json`` rows as one document over many lines."""

    def enclose(batches):
        mark = brackets[0]
        for batch in batches:
            lines = [f"{brackets[0] if i == 0 and mark == brackets[0] else ','}\n {x}" for i, x in enumerate(batch.column("json").to_pylist())]
            mark = "," if lines else mark
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
        end = brackets if mark == brackets[0] else brackets[1]
        yield pa.RecordBatch.from_pydict({"value": [end]})

    rows.select("json").mapInArrow(enclose, "value string").write.text(path)


@query("scan_articles_document", SCANNED)
def scan_articles_document(spark, sf):
    path = scratch_path(spark, "documents")
    _write_documents(_article_texts(spark, sf).sort("ord"), path, "[]")
    return _scanned(readers.read_articles(spark, path, one_document=True))


@query("scan_edges_csv", f"with {S.CITATIONS} select source::varchar as source, target from citations")
def scan_edges_csv(spark, sf):
    path = scratch_path(spark, "edges")
    fx.citations(spark, sf).write.csv(path, header=True)
    return readers.read_edges(spark, path).withColumn("source", F.col("source").cast("string"))


@query(
    "scan_headerless_csv",
    "select p_size as label, p_name as title, p_brand || ', \"' || p_type || '\"' as text, 'train' as mode from part "
    "union all select 0, n_name, 'Nation of ' || n_name, 'test' from nation",
)
def scan_headerless_csv(spark, sf):
    part = fx.table(spark, sf, "part").select(
        "p_size", "p_name", F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"'))
    )
    nation = fx.table(spark, sf, "nation").select(
        F.lit(0), "n_name", F.concat(F.lit("Nation of "), "n_name")
    )
    paths = {"train": scratch_path(spark, "train"), "test": scratch_path(spark, "test")}
    part.write.csv(paths["train"], escape='"')
    nation.write.csv(paths["test"], escape='"')
    return readers.read_headerless(spark, paths, schema="label int, title string, text string")


@query("scan_link_json", f"with {PAGES} select source, target from links")
def scan_link_json(spark, sf):
    path = scratch_path(spark, "links")
    _, links = fx.pages_and_links(spark, sf)
    # one object per linking page, so a repeated title never gathers in one row
    links.select(
        F.to_json(F.create_map("source", F.array("target"))).alias("value")
    ).write.text(path)
    return readers.read_links(spark, path)


@query("scan_link_document", f"with {PAGES} select source, target from links")
def scan_link_document(spark, sf):
    path = scratch_path(spark, "link-documents")
    _, links = fx.pages_and_links(spark, sf)
    member = F.concat(F.to_json(F.struct("source")), F.lit(": "), F.to_json(F.array("target")))
    # {"source":"x"} without its braces and name is the key
    key = F.regexp_replace(member, r'^\{"source":(.*?)\}: \[', "$1: [")
    _write_documents(links.select(key.alias("json")), path, "{}")
    return readers.read_links(spark, path, one_document=True)


def _label_lines(spark, sf):
    """Label lines with two header lines, and a second line for some ids."""
    docs = fx.table(spark, sf, "documents").select("doc_id")
    first = docs.select("doc_id", F.lit(0).alias("again"), (F.col("doc_id") % 3).alias("label"))
    second = docs.filter(F.col("doc_id") % 5 == 0).select(
        "doc_id", F.lit(1).alias("again"), ((F.col("doc_id") + 1) % 3).alias("label")
    )
    lines = first.unionAll(second).select(
        "again", "doc_id",
        F.concat_ws("\t", "doc_id", F.concat(F.lit("label="), "label"), F.lit("summary=a,b")).alias("value"),
    )
    header = spark.createDataFrame(
        [(-2, 0, "NODE\tpaper"), (-1, 0, "cat=1,2,3:label\tnumeric:summary")], lines.schema
    )
    return lines.unionAll(header).sort("again", "doc_id").select("value")


LABELS = "labs as (select doc_id::varchar as pmid, (case when doc_id % 5 = 0 then doc_id + 1 else doc_id end % 3)::varchar as label from documents)"


@query("scan_label_tab", f"with {LABELS} select pmid, label from labs")
def scan_label_tab(spark, sf):
    path = scratch_path(spark, "labels")
    _label_lines(spark, sf).write.text(path)
    return readers.read_labels(spark, path)


@query(
    "assemble_articles",
    f"with {LABELS} select doc_id::varchar as pmid, text as abstract, l.label from documents left join labs l on l.pmid = doc_id::varchar",
)
def assemble_articles(spark, sf):
    files, path = scratch_path(spark, "landed"), scratch_path(spark, "labels")
    docs = fx.table(spark, sf, "documents")
    sinks.write_articles(
        docs.select(F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("abstract")), files
    )
    _label_lines(spark, sf).write.text(path)
    landed = readers.read_articles(spark, files)
    joined = readers.assemble_articles(landed, readers.read_labels(spark, path))
    return joined.select("pmid", "abstract", "label")


def _land_labelled(spark, sf):
    """Three deliveries of the documents of the ``labels`` table, the last one a repeat."""
    landing = Landing(spark, scratch_path(spark, "landed"))
    rated = fx.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("pmid"), F.col("quality").cast("string").alias("label")
    )
    good = F.coalesce(F.col("label") == "1", F.lit(False))
    for part in (rated.filter(good), rated.filter(~good), rated.filter(good)):
        landing.deliver(part)
    landing.compact()
    return landing


@query("list_fetched", "select distinct doc_id::varchar as pmid from labels")
def list_fetched(spark, sf):
    return _land_labelled(spark, sf).ids()


@query("pending_ids", "select doc_id::varchar as pmid from documents except select doc_id::varchar from labels")
def pending_ids(spark, sf):
    wanted = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("pmid"))
    return readers.pending_ids(wanted, _land_labelled(spark, sf).ids())


@query(
    "sink_articles_json",
    f"with {FIRST_TIMES} select doc_id::varchar as pmid, max(text) as abstract, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_time "
    "from hist join documents using (doc_id) group by 1",
)
def sink_articles_json(spark, sf):
    path = scratch_path(spark, "store")
    docs = fx.table(spark, sf, "documents").join(fx.histories(spark, sf), "doc_id")
    raw = docs.select(
        F.col("doc_id").cast("string").alias("pmid"), F.col("text").alias("abstract"), "history",
        F.col("text").alias("content"), F.col("source").alias("xml"),
    )
    sinks.write_articles(raw, path)
    back = spark.read.schema(
        "pmid string, abstract string, history map<string,string>, content string, xml string"
    ).json(path)
    return back.filter("content is null and xml is null").select(
        "pmid", "abstract", F.array_min(F.map_values("history")).alias("first_time")
    )


@query(
    "sink_nodes_csv",
    f"with {S.CLEAN}, {AUTHORS}, a as (select node_id, '[' || string_agg('\"' || author || '\"', ',' order by author::varchar) || ']' as authors from doc_authors group by 1), "
    f"{FIRST_TIMES}, h as (select doc_id, min(ts) as ts from hist group by 1), "
    f"m as (select text_id, {S.MODE} as mode from {S.split_sql('clean', "'1'", id='text_id')}) "
    "select row_number() over (order by ord) - 1 as node_id, text_id, label, 'Title, of ' || text_id as title, authors, "
    "text, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, mode "
    "from clean left join a on a.node_id = text_id left join h on h.doc_id = text_id join m using (text_id)",
)
def sink_nodes_csv(spark, sf):
    path = scratch_path(spark, "nodes")
    articles = fx.articles_full(spark, sf)
    # ids and splits are settled on narrow columns, so that texts are joined once, with all of them
    rows = settle(A.without_texts(fx.articles_full(spark, sf, texts=False)))
    keys = settle(A.clean_keys(rows))
    clean = settle(A.clean_articles(rows, keys=keys).select("ord", "text_id"))
    modes = settle(O.split(clean.select("text_id"), id="text_id").select("text_id", "mode"))
    numbered = O.dense_ids(clean.join(modes, "text_id"), "ord", onto=clean.distinct().join(modes, "text_id"))
    nodes = A.clean_articles(articles, keys=keys.join(numbered, ["ord", "text_id"]))
    sinks.write_nodes(nodes.select("node_id", "text_id", "label", "title", "authors", "text", "time", "mode"), path)
    back = readers.read_nodes(
        spark, path,
        schema="node_id bigint, text_id bigint, label int, title string, authors string, text string, time timestamp_ntz, mode string",
    )
    return back.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))


@query("load_vectors", "select vec_id as node_id, d::integer as dim, round(embedding[d + 1]::double, 6) + 0.0::double as value from embeddings, range(64) r(d)")
def load_vectors(spark, sf):
    return long(readers.load_vectors(spark, f"{sf}/embeddings.parquet", id="vec_id", vec="embedding"))


@query("resumable_ingest", "select doc_id::varchar as pmid, 1::bigint as stored from documents")
def resumable_ingest(spark, sf):
    landing, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    checkpoint = scratch_path(spark, "progress")
    docs = fx.articles(spark, sf)
    english = F.coalesce(F.col("label") == "1", F.lit(False))
    for drop in (docs.filter(english), docs.filter(~english)):
        sinks.write_articles(drop, landing)
        ingest_new_articles(spark, landing, store, checkpoint)
    return spark.read.parquet(store).groupBy("pmid").agg(F.count("*").alias("stored"))


# ----------------------------------------------------------------- text steps

TEXTS = "texts as (select doc_id as node_id, text from documents)"


@query("fold_text", f"select doc_id as node_id, {S.FOLD} as text from documents")
def fold_text(spark, sf):
    from ..functions.text import fold_text as fold

    return fold(fx.texts(spark, sf))


@query("tokenize", f"with {TEXTS} select node_id, len({S.TOKENS})::bigint as n_tokens, md5(array_to_string({S.TOKENS}, ' ')) as digest from texts")
def tokenize(spark, sf):
    return tfidf.tokenize(fx.texts(spark, sf)).select(
        "node_id", F.size("tokens").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("tokens", " ")).alias("digest"),
    )


@query("term_frequency", f"with {TEXTS}, {S.tfidf('texts')} select node_id, term, tf from tf")
def term_frequency(spark, sf):
    return tfidf.term_frequency(fx.texts(spark, sf))


@query("document_frequency", f"with {TEXTS}, {S.tfidf('texts')} select term, df, total from df")
def document_frequency(spark, sf):
    return tfidf.document_frequency(fx.texts(spark, sf))


@query("prune_vocabulary", f"with {TEXTS}, {S.tfidf('texts')} select term, df, total from pruned")
def prune_vocabulary(spark, sf):
    tokens = store(tfidf.tokenize(fx.texts(spark, sf)), "tokens")
    frequent = tfidf.frequent_terms(tokens, math.ceil(tfidf.MIN_DF * tokens.count()))
    return tfidf.prune_vocabulary(frequent, tokens).drop("n")


@query("top_terms", f"with {TEXTS}, {S.tfidf('texts')} select term, df, total from top")
def top_terms(spark, sf):
    nodes = fx.texts(spark, sf)
    pruned = tfidf.prune_vocabulary(tfidf.document_frequency(nodes), nodes)
    return tfidf.top_terms(pruned).drop("n")


@query("vocabulary_index", f"with {TEXTS}, {S.tfidf('texts')} select term, col::integer as col from vocab")
def vocabulary_index(spark, sf):
    return tfidf.vocabulary(fx.texts(spark, sf)).select("term", "col")


@query("tfidf", f"with {TEXTS}, {S.tfidf('texts')} select node_id, term, {S.num('v')} as value from w")
def tfidf_values(spark, sf):
    nodes = store(tfidf.tokenize(fx.texts(spark, sf)), "tokens")
    model = tfidf.fit_tfidf(nodes)
    return model.long(model.weighted(nodes)).withColumn("value", num("value"))


@query("tfidf_l2", f"with {TEXTS}, {S.tfidf('texts')} select node_id, term, {S.num('x')} as value from unit")
def tfidf_l2(spark, sf):
    nodes = store(tfidf.tokenize(fx.texts(spark, sf)), "tokens")
    model = tfidf.fit_tfidf(nodes)
    return model.long(model.vectors(nodes)).withColumn("value", num("value"))


@query(
    "tfidf_vectors",
    f"with {TEXTS}, {S.tfidf('texts')} select t.node_id, d::integer as dim, coalesce({S.num('u.x')}, 0.0::double) as value "
    "from texts t cross join range(512) r(d) left join unit u on u.node_id = t.node_id and u.col = d",
)
def tfidf_vectors(spark, sf):
    return long(tfidf.vectorize_texts(fx.texts(spark, sf), to_sparse=False))


@query(
    "fixed_length_encode",
    f"""with {TEXTS}, {S.tfidf('texts')},
k as (select node_id, {S.TOKENS}[1:512] as t from texts),
p as (select node_id, len(t) as n, unnest(t) as term, unnest(range(len(t))) as pos from k),
c as (select node_id, sum((pos + 1) * coalesce(col + 2, 1))::bigint as checksum from p left join vocab using (term) group by 1)
select k.node_id, 512::bigint as length, len(t)::bigint as n_used, coalesce(checksum, 0)::bigint as checksum from k left join c using (node_id)""",
)
def fixed_length_encode(spark, sf):
    nodes = fx.texts(spark, sf)
    rows = tfidf.fit_tfidf(nodes).encode(nodes)
    used = F.zip_with("input_ids", "attention_mask", lambda i, m: i * m)
    weighted = F.transform(used, lambda x, pos: x.cast("bigint") * (pos + 1))
    return rows.select(
        "node_id", F.size("input_ids").cast("bigint").alias("length"),
        F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("n_used"),
        F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"),
    )

"""A collection of linked texts: load, clean, number, split, and build the graph."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import citations as C
from ..operators import graph as G
from ..operators import metrics, ordering, tfidf
from ..session import settle, store


@dataclass(frozen=True)
class LinkedTexts:
    """Nodes ``(node_id, text_id, text, label, mode, ...)`` and edges ``(src, dst)``.

    The graph always holds all nodes. ``mode`` only limits which texts and labels
    are returned.
    """

    nodes: DataFrame
    edges: DataFrame
    mode: str | None = None

    @classmethod
    def load(cls, articles: DataFrame, citations: DataFrame, *, seed: int = 1) -> "LinkedTexts":
        """Clean raw articles and links, drop isolated articles, number and split.

        Everything is decided on narrow columns; the texts are shuffled once, when
        the surviving articles get their ids, and stored once.
        """
        kept = A.check_order(settle(A.clean_keys(articles).select("ord", "text_id", "label")))
        links = settle(C.clean_edges(citations, kept))
        ids = ordering.dense_id_map(C.drop_isolated(kept, links), "ord", "text_id", "label")
        edges = settle(C.encode_edges(links, ids))
        numbered = ordering.split(ids, seed=seed)
        carried = [c for c in ("authors", "title", "history") if c in articles.columns]
        # placed by ord even where the join would broadcast the ids: the stored
        # texts are then spread evenly, and no join shuffles them a second time
        texts = articles.select(
            "ord", F.col("pmid").cast("bigint").alias("text_id"), F.col("abstract").alias("text"), *carried
        )
        nodes = texts.repartition("ord").join(numbered, ["ord", "text_id"]).drop("ord")
        if "history" in carried:
            nodes = nodes.withColumn("time", A.first_event_time("history")).drop("history")
        return cls(store(nodes, "nodes"), edges)

    @classmethod
    def load_titled(
        cls, pages: DataFrame, links: DataFrame, *, order: str = "text_id"
    ) -> "LinkedTexts":
        """Pages ``(text_id, title, text, label, mode)`` linked by title.

        Links with an unknown title are dropped.
        """
        edges = settle(C.drop_null_edges(C.links_by_title(links, pages)))
        nodes, encoded = C.reindex(C.drop_isolated(pages, edges), edges, order=order)
        return cls(store(nodes, "nodes"), settle(encoded))

    def change_mode(self, mode: str | None) -> "LinkedTexts":
        if mode is not None and mode not in ordering.MODES:
            raise ValueError(f"unknown mode {mode!r}: expected one of {ordering.MODES}")
        return replace(self, mode=mode)

    @property
    def view(self) -> DataFrame:
        return self.nodes if self.mode is None else ordering.split_view(self.nodes, self.mode)

    @property
    def labels(self) -> DataFrame:
        return ordering.labels_of(self.nodes, self.mode)

    @property
    def num_labels(self) -> int:
        return metrics.num_labels(self.nodes).first()[0]

    @property
    def real_len(self) -> int:
        return self.nodes.count()

    def __len__(self) -> int:
        return self.view.count()

    def rows(
        self, first: int, last: int, *, prefix: bool = False, transform=None, target_transform=None
    ) -> DataFrame:
        """Rows ``first .. last - 1`` of the view as ``(node_id, text, label)``."""
        rows = ordering.rows_at(self.nodes, (first, last), mode=self.mode)
        rows = A.with_context_prefix(rows.select("node_id", "text", "label"), prefix)
        if transform:
            rows = A.apply_to(rows, "text", transform)
        if target_transform:
            rows = A.apply_to(rows, "label", target_transform)
        return rows

    def authors(self) -> DataFrame:
        return A.all_authors(self.nodes)

    def create_graph(self) -> G.Graph:
        return G.Graph.build(self.nodes, self.edges)

    def create_adjacency(self) -> DataFrame:
        return G.adjacency(self.edges)

    def edge_index(self) -> DataFrame:
        return G.edge_index(self.edges)

    def features(self, **options) -> tuple[tfidf.TfidfModel, DataFrame]:
        """The TF-IDF model fitted on all texts, and the node features. Texts are cut into words once."""
        tokens = store(tfidf.tokenize(self.nodes), "tokens")
        model = tfidf.fit_tfidf(tokens, **options)
        return model, model.vectors(tokens)

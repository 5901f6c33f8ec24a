"""Cleaning of articles and links on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from linkloom.operators import articles as A
from linkloom.operators import citations as C
from linkloom.operators import joins
from linkloom.plans.dataset import LinkedTexts

ARTICLES = "ord bigint, pmid string, label string, abstract string"


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(
        [
            (0, "10", "1", "alpha beta"),
            (1, "11", None, "first row without label"),
            (2, "11", "2", "complete but late"),
            (3, "12", "0", None),
            (4, "13", "2", "gamma beta"),
            (5, "10", "2", "late copy"),
            (6, "14", "1", "alone"),
            (7, "15", "0", "self cited"),
        ],
        ARTICLES,
    )


@pytest.fixture
def links(spark):
    return spark.createDataFrame(
        [(10, 13), (10, 13), (13, 10), (10, 99), (11, 10), (None, 10), (15, 15)],
        "source bigint, target bigint",
    )


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_first_row_decides_before_incomplete_rows_go(raw):
    nodes = A.clean_articles(raw)
    assert ids(nodes, "text_id", "text") == [
        (10, "alpha beta"), (13, "gamma beta"), (14, "alone"), (15, "self cited")
    ]


def test_first_row_rank_is_limited_before_the_shuffle(raw):
    plan = A.first_per_key(raw)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_bad_number_is_an_error(spark):
    bad = spark.createDataFrame([(0, "x1", "1", "t")], ARTICLES)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        A.clean_articles(bad).collect()


def test_first_event_time_is_a_string_minimum(spark):
    rows = spark.sql(
        "select map('a', '2021-02-01 00:00:00', 'b', '2020-12-31 10:00:00') history "
        "union all select map() history"
    )
    times = [r[0] for r in rows.select(A.first_event_time("history")).collect()]
    assert sorted(str(t) for t in times) == ["2020-12-31 10:00:00", "None"]


def test_links_keep_direction_and_known_ends(raw, links):
    edges = C.clean_edges(links, A.clean_articles(raw))
    assert ids(edges, "source", "target") == [(10, 13), (13, 10), (15, 15)]


def test_load_numbers_the_linked_articles(raw, links):
    data = LinkedTexts.load(raw, links)
    assert ids(data.nodes, "node_id", "text_id") == [(0, 10), (1, 13), (2, 15)]
    assert ids(data.edges, "src", "dst") == [(0, 1), (1, 0), (2, 2)]
    assert data.real_len == 3 and data.num_labels == 3
    assert sum(len(data.change_mode(m)) for m in ("train", "valid", "test")) == 3
    with pytest.raises(ValueError):
        data.change_mode("dev")
    rows = data.rows(1, 3, prefix=True, target_transform=lambda c: c * 10)
    assert ids(rows, "node_id", "text", "label") == [
        (1, "<GC> gamma beta", 20), (2, "<GC> self cited", 0)
    ]


def test_titles_take_their_last_page(spark):
    pages = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "text_id bigint, title string")
    links = spark.createDataFrame(
        [("a", "b"), ("b", "a"), ("a", "gone")], "source string, target string"
    )
    out = C.links_by_title(links, pages).collect()
    assert sorted(((r.source, r.target) for r in out), key=str) == [(1, 2), (2, 1), (2, None)]


def test_hot_keys_are_found_and_spread_exactly(spark):
    many = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    one = spark.range(9000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w"))
    hot = joins.hot_keys(many, "k", min_rows=100)["k"]
    assert list(hot.parts) == [7] and hot.parts[7] > 20
    for how in ("inner", "left"):
        joined = joins.lookup_join(many, one, "k", "key", hot=hot, how=how)
        plain = joins.lookup_join(many, one, "k", "key", how=how)
        assert joined.count() == 9000
        assert joined.exceptAll(plain.select(*joined.columns)).isEmpty()

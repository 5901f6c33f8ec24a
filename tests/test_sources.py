"""Files in the formats the engine reads and writes."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from linkloom.plans.dataset import LinkedTexts
from linkloom.sources import readers, sinks, split_records
from linkloom.sources.landing import Landing
from linkloom.streaming.ingest import ingest_new_articles


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_articles_as_lines_and_as_one_document(spark, tmp_path):
    articles = [
        {"ord": 0, "pmid": "1", "label": "2", "abstract": "a\nb", "history": {"x": "2020-01-01"}, "extra": 1},
        {"ord": 1, "pmid": "2", "label": None, "abstract": None, "authors": ["A", "B"]},
    ]
    (tmp_path / "one.json").write_text(json.dumps(articles, indent=2))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(a) for a in articles))
    one = readers.read_articles(spark, str(tmp_path / "one.json"), one_document=True)
    lines = readers.read_articles(spark, str(tmp_path / "lines.json"))
    assert rows(one, "pmid", "label", "abstract") == [("1", "2", "a\nb"), ("2", None, None)]
    assert rows(one, *one.columns) == rows(lines, *lines.columns)


NASTY = ['"', "\\", "{", "}", "[", "]", ",", "\n", "\r", "é", "語", " ", "a", '\\"', ":", "\r\n"]


def nasty(draw, most):
    return "".join(draw.choice(NASTY) for _ in range(draw.randrange(most)))


@pytest.fixture(params=[120, 1 << 27])
def splits(request, spark):
    """Splits of a few bytes, so that records, strings and escapes go over their ends; and whole files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    for name, value in zip(names, (request.param, 1), strict=True):
        spark.conf.set(name, str(value))
    yield request.param
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def test_one_document_is_cut_by_many_tasks(spark, tmp_path, splits):
    draw = random.Random(splits)
    articles = [
        {"pmid": f"{i}", "label": draw.choice([None, "1"]), "abstract": nasty(draw, 60), "authors": [nasty(draw, 9) for _ in range(3)],
         "history": {nasty(draw, 5): "x"}, "author_list": [["a", nasty(draw, 4)], []]}
        for i in range(40)
    ] + [{"pmid": "long", "abstract": "]},{" * 100}]
    files = {"a.json": json.dumps(articles), "b.json": json.dumps(articles, indent=3, ensure_ascii=False) + "\n \n", "c.json": " [\n] ", "d.json": '[{"pmid":"z"}]'}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    for name in files:
        path = str(tmp_path / name)
        got = readers.read_articles(spark, path, one_document=True)
        want = spark.read.schema(readers.ARTICLE_SCHEMA).json(path, multiLine=True)
        assert rows(got.drop("ord"), *want.columns) == rows(want, *want.columns)
        ordered = [r.pmid for r in got.sort("ord").collect()]
        assert ordered == [a["pmid"] for a in json.loads(files[name])]
    if splits < 1000:
        assert len({r[0] for r in split_records._pieces(spark, str(tmp_path / "a.json"), "}").select("block").distinct().collect()}) > 20


def test_bad_documents_are_an_error(spark, tmp_path):
    for i, text in enumerate(('[{"pmid": 1}, {"pmid" 2}]', '[{"pmid": "1"}] x', '[{"pmid": "1"}')):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match="MALFORMED|Malformed|incomplete|end of the file"):
            readers.read_articles(spark, str(tmp_path / f"{i}.json"), one_document=True)


def test_link_members_over_splits(spark, tmp_path, splits):
    draw = random.Random(splits + 1)
    links = {f"{i}{nasty(draw, 12)}": [nasty(draw, 12) for _ in range(draw.randrange(4))] for i in range(50)}
    for name, text in (("a.json", json.dumps(links)), ("b.json", json.dumps(links, indent=1, ensure_ascii=False) + "\n"), ("c.json", "{ }")):
        (tmp_path / name).write_bytes(text.encode())
        got = readers.read_links(spark, str(tmp_path / name), one_document=True)
        want = [(k, v) for k, targets in json.loads(text).items() for v in targets]
        assert rows(got, "source", "target") == sorted(want, key=str)


def test_csv_records_over_lines_come_back_equal(spark, tmp_path, splits):
    draw = random.Random(splits + 2)
    texts = [None, "", " ", "\n", "\r", '"', '""', ",", "NULL", "\\", "x\r", *(nasty(draw, 40) for _ in range(50))]
    table = [(i, text, ["a", text or "b"], None if i % 3 else "t") for i, text in enumerate(texts)]
    nodes = spark.createDataFrame(table, "node_id bigint, text string, authors array<string>, mode string")
    sinks.write_nodes(nodes.repartition(3), str(tmp_path / "n"))
    back = readers.read_nodes(spark, str(tmp_path / "n"), schema="node_id bigint, text string, authors string, mode string")
    assert rows(back, "node_id", "text", "mode") == rows(nodes, "node_id", "text", "mode")
    parsed = back.select("node_id", F.from_json("authors", "array<string>").alias("authors"))
    assert rows(parsed, "node_id", "authors") == rows(nodes, "node_id", "authors")


def test_headerless_records_over_lines(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_bytes('1,"T\none","say ""hi""\r\n,"\r\n2,plain,"x\n\ny"\n\n'.encode())
    got = readers.read_headerless(spark, {"train": str(tmp_path / "a.csv")}, schema="label int, title string, text string")
    assert rows(got, *got.columns) == [(1, "T\none", 'say "hi"\r\n,', "train"), (2, "plain", "x\n\ny", "train")]
    (tmp_path / "b.csv").write_text("1,a\nx,b\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        readers.read_headerless(spark, {"t": str(tmp_path / "b.csv")}, schema="label int, title string").collect()


def test_edges_with_bad_id_are_an_error(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target\n1,2\n,3\n")
    assert rows(readers.read_edges(spark, str(tmp_path / "e.csv")), "source", "target") == [(1, 2), (None, 3)]
    (tmp_path / "bad.csv").write_text("source,target\nx,2\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|BAD_RECORD"):
        readers.read_edges(spark, str(tmp_path / "bad.csv")).collect()


def test_label_lines(spark, tmp_path):
    text = "NODE\tpaper\ncat=1,2,3:label\tnumeric\n11\tlabel=1\tw=0.1\n12\tlabel=2\tw\n11\tlabel=3\tw\n"
    (tmp_path / "nodes.tab").write_text(text)
    got = readers.read_labels(spark, str(tmp_path / "nodes.tab"))
    assert rows(got, "pmid", "label") == [("11", "3"), ("12", "2")]


def test_links_as_one_document_and_as_lines(spark, tmp_path):
    links = {"a": ["b", "c"], "b": [], "c": ["a"]}
    (tmp_path / "l.json").write_text(json.dumps(links, indent=1))
    want = [("a", "b"), ("a", "c"), ("c", "a")]
    assert rows(readers.read_links(spark, str(tmp_path / "l.json"), one_document=True), "source", "target") == want
    (tmp_path / "m.json").write_text("\n".join(json.dumps({k: v}) for k, v in links.items()))
    assert rows(readers.read_links(spark, str(tmp_path / "m.json")), "source", "target") == want


def test_landed_and_pending_ids(spark, tmp_path):
    for pmid in (1, 3):
        (tmp_path / f"{pmid}.json").write_text("{}")
    landed = readers.landed_ids(spark, str(tmp_path))
    assert rows(landed, "pmid") == [("1",), ("3",)]
    wanted = spark.createDataFrame([("1",), ("2",), ("2",)], "pmid string")
    assert rows(readers.pending_ids(wanted, landed), "pmid") == [("2",)]


def test_headerless_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"T, one","say ""hi"""\n')
    (tmp_path / "b.csv").write_text("2,T two,x\n")
    got = readers.read_headerless(
        spark, {"train": str(tmp_path / "a.csv"), "test": str(tmp_path / "b.csv")},
        schema="label int, title string, text string",
    )
    assert rows(got, *got.columns) == [(1, "T, one", 'say "hi"', "train"), (2, "T two", "x", "test")]


def test_metrics_of_an_epoch_are_replaced(spark, tmp_path):
    schema, path = "run string, mode string, epoch int, acc double", str(tmp_path / "m")
    for row in (("1", "valid", 0, 0.5), ("1", "valid", 1, 0.6), ("1", "valid", 0, 0.5), ("2", "valid", 0, 0.1), ("1", "valid", 1, 0.7)):
        sinks.write_metrics(spark.createDataFrame([row], schema), path)
    want = [("1", "valid", 0, 0.5), ("1", "valid", 1, 0.7), ("2", "valid", 0, 0.1)]
    assert rows(sinks.read_metrics(spark, path, schema), "run", "mode", "epoch", "acc") == want


def test_landing_log(spark, tmp_path):
    landing = Landing(spark, str(tmp_path))
    landing.compact()
    assert landing.ids().count() == 0

    def deliver(*ids):
        return landing.deliver(spark.createDataFrame([(i, f"text {i}") for i in ids], "pmid string, abstract string"))

    deliver("1", "2")
    deliver("2", "3", None)
    # a delivery that was cut off before its entry
    lost = deliver("9")
    shutil.rmtree(tmp_path / "log" / f"entry={lost}")
    for again in range(3):
        assert rows(landing.ids(), "pmid") == [("1",), ("2",), ("3",)]
        assert [r[0] for r in rows(landing.entries(), "pmid")] == ["1", "2", "2", "3"]
        landing.compact()
        assert len(list((tmp_path / "log").glob("entry=*"))) == 1
    deliver("9")
    assert landing.ids().count() == 4
    assert rows(Landing(spark, str(tmp_path)).ids(), "pmid")[-1] == ("9",)
    wanted = spark.createDataFrame([("1",), ("7",)], "pmid string")
    assert rows(readers.pending_ids(wanted, landing.ids()), "pmid") == [("7",)]
    assert landing.articles("pmid string, abstract string").count() == 7


def test_stream_resumes_and_stores_an_id_once(spark, tmp_path):
    landing, store, progress = (str(tmp_path / n) for n in ("landing", "store", "progress"))
    counts = []
    for ids in (["1", "2"], ["2", "3"], []):
        for pmid in ids:
            (tmp_path / "landing").mkdir(exist_ok=True)
            (tmp_path / "landing" / f"{pmid}-{len(counts)}.json").write_text(json.dumps({"pmid": pmid}))
        ingest_new_articles(spark, landing, store, progress)
        counts.append(spark.read.parquet(store).count())
    assert counts == [2, 3, 3]


def test_stream_replays_a_cut_off_batch(spark, tmp_path):
    """The articles of a batch are written, its entry and its commit are not."""
    landing, store, progress = (tmp_path / n for n in ("landing", "store", "progress"))
    landing.mkdir()

    def land(name, *ids):
        (landing / name).write_text("".join(json.dumps({"pmid": i, "abstract": name}) + "\n" for i in ids))

    def run(checkpoint=progress):
        ingest_new_articles(spark, str(landing), str(store), str(checkpoint))
        return rows(spark.read.parquet(str(store)), "pmid", "abstract")

    land("a.json", "1", "2", "2", None)
    assert run() == [("1", "a.json"), ("2", "a.json")]
    land("b.json", "2", "3")
    after = run()
    assert after == [("1", "a.json"), ("2", "a.json"), ("3", "b.json")]
    for committed in ("1", ".1.crc"):
        (progress / "commits" / committed).unlink()
    for entry in (store / "_ids").glob("batch=*-1"):
        shutil.rmtree(entry)
    assert run() == after
    assert run(tmp_path / "other") == after  # a lost checkpoint reads all files again
    assert not list(progress.glob("state/*"))


def test_titled_pages_become_a_graph(spark):
    pages = spark.createDataFrame(
        [(i, t, f"text {t}", i % 2, "train") for i, t in enumerate(["a", "b", "c", "a"])],
        "text_id bigint, title string, text string, label int, mode string",
    )
    links = spark.createDataFrame([("a", "b"), ("b", "zz")], "source string, target string")
    data = LinkedTexts.load_titled(pages, links)
    assert rows(data.nodes, "node_id", "text_id") == [(0, 1), (1, 3)]
    assert rows(data.edges, "src", "dst") == [(1, 0)]


def _written(tmp_path, articles):
    for part in range(2):
        lines = [json.dumps(a) for a in articles[part::2]]
        (tmp_path / f"{part}.json").write_text("\n".join(lines))
    return str(tmp_path)


def test_articles_without_order_load_completely(spark, tmp_path):
    from linkloom.plans.dataset import LinkedTexts

    ids = [3, 1000003, 5, 7, 8, 9]
    path = _written(tmp_path, [{"pmid": str(i), "label": "1", "abstract": f"text {i}"} for i in ids])
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])], "source long, target long")
    nodes = LinkedTexts.load(readers.read_articles(spark, path), links).nodes.orderBy("node_id").collect()
    in_file_order = ids[0::2] + ids[1::2]
    assert [(r.node_id, r.text_id, r.text) for r in nodes] == [(n, i, f"text {i}") for n, i in enumerate(in_file_order)]


def test_repeated_order_and_cut_off_lines_are_errors(spark, tmp_path):
    from linkloom.plans.dataset import LinkedTexts

    links = spark.createDataFrame([(1, 2)], "source long, target long")
    for order in (0, None):
        rows = [(order, "1", "1", "a"), (order, "2", "1", "b")]
        twice = spark.createDataFrame(rows, "ord long, pmid string, label string, abstract string")
        with pytest.raises(ValueError, match="order"):
            LinkedTexts.load(twice, links)
    (tmp_path / "cut.json").write_text('[{"pmid": "1", "abstract": "a"}, {"pmid": "2", "abst')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        readers.read_articles(spark, str(tmp_path)).collect()
    (tmp_path / "links.txt").write_text('{"a": ["b"]}\n{"a": ["c"')
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        readers.read_links(spark, str(tmp_path / "links.txt")).collect()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from linkloom.session import shared_dir

    def spark_on(master, warehouse, checkpoint=None):
        settings = {"spark.sql.warehouse.dir": warehouse, "spark.checkpoint.dir": checkpoint}
        conf = SimpleNamespace(get=lambda key, default=None: settings.get(key) or default)
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(spark_on("local[8]", "file:/w")) == "/w/_linkloom"
    assert shared_dir(spark_on("spark://h:7077", "hdfs://h/w")) == "hdfs://h/w/_linkloom"
    assert shared_dir(spark_on("spark://h:7077", "file:/w", "file:///shared/")) == "file:///shared"
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="shar"):
            shared_dir(spark_on(master, "file:/w"))

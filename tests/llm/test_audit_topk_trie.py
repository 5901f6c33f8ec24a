"""The filter audit, exact top-k and the prefix trie against brute force, with their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, compare
from linkloom.llm import bit_sliced, filter_audit, prefix_trie

SF = "/root/testdata/sf0.001"
LONG = "Word x " * 40_000


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_exact_topk", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, db.execute(entry.oracle_sql()[name]).df()).startswith("ok")
    assert len(got)


# --------------------------------------------------------------- 11. filter audit

AUDIT_SCHEMA = "doc_id long, source string, text string, part string, failed string, id int"
AUDIT_ROWS = [
    (1, "a", "Same text & more", "x", "y", 1), (2, "a", "Same text & more", None, None, 2), (2, "b", "Same text & more", None, None, 3),
    (1, "b", "Same text & more", "x", "y", 1), (1, "b", "Same text & more", "x", "y", 1), (3, None, None, None, None, None),
    (4, "", "", None, None, 1), (None, "a", "Same text & more", None, None, 1), (None, None, None, None, None, None),
    (5, "a", LONG, None, None, 1), (6, "a", LONG + "z", None, None, 1), (7, "c", " \t\r\n\x0b\x0c ", None, None, 1),
    (8, "c", "é\x00  ß" + " lower case words" * 20, None, None, 1), (9, "c", " ".join(f"w{i}" for i in range(60)), None, None, 1),
    (10, "c", " ".join(f"W{i}" for i in range(60)), None, None, 1), (11, "c", " ".join(f"w{i}" for i in range(60)), None, None, 1),
    (12, "c", "x" * 300 + " " + "x" * 299 + "y " + "x" * 300, None, None, 1),
]
LABEL_ROWS = [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, None, 1), (9, 1, 1), (10, 0, 1), (99, 1, 1), (None, 1, 1), (11, 1, 0)]


def signals_of(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
    text = text or ""
    return (len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text)))


def audit_expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    docs = []
    for doc_id, source, text, *_ in rows:
        n, distinct, capitals, points, symbols = signals_of(text)
        copies = [r[0] for r in rows if r[0] is not None and (r[2] or "") == (text or "")]
        fails = {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * points, "D": symbols > 0,
                 "E": doc_id is not None and doc_id > min(copies)}
        docs.append((source or "", {x for x, f in fails.items() if f}, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        found = []
        for order in map("".join, permutations("ABCDE")):
            left, gone = list(mine), []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                found.append((
                    order, step, len(left), len(removed), sum(x in d[1] for d in gone), sum(d[1] == {x} for d in mine),
                    sum(d[2] for d in removed), sum(d[3] for d in removed),
                ))
                gone += removed
        total = defaultdict(int)
        for order, step, _, removed, *_ in found:
            total[order[step - 1]] += removed
        out += [(part, *row, total[row[0][row[1] - 1]]) for row in found]
    return sorted(out)


AUDIT_COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame(AUDIT_ROWS, AUDIT_SCHEMA)
    labels = spark.createDataFrame(LABEL_ROWS, "doc_id long, quality int, toxic int")
    sets = filter_audit.failed_sets(filter_audit.text_signals(docs), labels)
    got = sorted(tuple(r) for r in filter_audit.audit_orders(sets).select(AUDIT_COLUMNS).collect())
    assert got == audit_expected(AUDIT_ROWS, LABEL_ROWS)
    empty = filter_audit.failed_sets(filter_audit.text_signals(docs.limit(0)), labels.limit(0))
    assert filter_audit.audit_orders(empty).count() == 0


def test_signals_of_random_texts(monkeypatch):
    draw = random.Random(5)
    texts = ["".join(draw.choice("aAb é語#& \n\t ") for _ in range(draw.randrange(200))) for _ in range(200)]
    texts += [r[2] or "" for r in AUDIT_ROWS]
    for hashes in (None, lambda self: np.zeros(len(self.sizes), np.uint64)):  # the second: every span collides
        if hashes:
            monkeypatch.setattr(filter_audit.Spans, "hashes", hashes)
            texts = texts[:60]
        got = filter_audit.count_signals([x.encode() for x in texts])
        assert list(zip(*[got[c].tolist() for c in ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")], strict=True)) == list(map(signals_of, texts))


# ------------------------------------------------------------------ 12. exact top-k


def top_expected(rows, k):
    usable = [
        (i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for query_id, q in usable:
        if query_id % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c, strict=False)), i) for i, c in usable if i != query_id)
            out += [(query_id, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block,queries", [(16_384, 4096), (7, 2)])
def test_top_k_equals_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(bit_sliced, "QUERY_ROWS", queries)
    draw = random.Random(9)
    rows = [(i, [float(np.float32(draw.gauss(0, 0.3))) for _ in range(8)], "x", i) for i in range(0, 300, 3)]
    rows += [(i, [0.5] * 8, "tie", 0) for i in range(1, 60, 3)] + [(50, [0.5] * 8, "a", 1), (50, [0.5] * 8, "a", 1), (-100, [-1.0] * 8, "b", 2)]
    rows += [
        (200, None, "", 0), (250, [], "", 0), (350, [1e6, -1e6, 3.0], "", 0), (400, [None] * 8, "", 0), (450, [float("nan")] * 8, "", 0),
        (500, [float("inf")] * 8, "", 0), (None, [1.0] * 8, "", 0), (2, [0.001] * 12, "", 0), (550, [0.0] * 8, "", 0),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, score int").repartition(3)
    index = bit_sliced.build_index(vectors, block_rows=block)
    for k in (1, 5, 1000):
        got = bit_sliced.top_k(index, vectors.filter(F.col("vec_id") % 50 == 0), k=k)
        assert sorted(tuple(r) for r in got.collect()) == top_expected(rows, k)
    assert bit_sliced.top_k(bit_sliced.build_index(vectors.limit(0)), vectors).count() == 0
    assert bit_sliced.top_k(index, vectors.limit(0)).count() == 0


def test_scores_too_large_are_an_error():
    block = bit_sliced.Block(bit_sliced.slice_block(np.array([1]), np.array([[1 << 40]])))
    with pytest.raises(ValueError, match="62 bits"):
        block.add([1 << 30])


# ------------------------------------------------------------------ 13. prefix trie


def trie_expected(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]

    original = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            original[conv].append((turn is not None, turn or 0, digest(role, text), role, text))
    for turns in original.values():
        turns.sort()
    paths = {}
    for conv, turns in original.items():
        cut = zlib.crc32(str(conv).encode()) % 6
        base = original.get(conv - int(math.fmod(conv, 100)), [])
        paths[conv] = tuple(t[3:] for t in base[:cut] + turns[cut:])
    members = defaultdict(list)
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    children, out = defaultdict(int), []
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    for node, who in members.items():
        ends = sorted(c for c in who if paths[c] == node)
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


TRIE_COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(TRIE_COLUMNS).collect()), key=str)


def conversations_of(draw, count):
    """Conversations that share beginnings of all lengths, with repeats, ties, nulls and long ones."""
    starts = [[(draw.choice("ua"), draw.choice(["x", "yy", "é語", "", None])) for _ in range(20)] for _ in range(4)]
    rows = []
    for conv in draw.sample(range(-150, 1200), count):
        path = draw.choice(starts)[: draw.randrange(0, 20)] + [("u", str(draw.randrange(3))) for _ in range(draw.randrange(4))]
        rows += [(conv, i, role, text, "p", 1) for i, (role, text) in enumerate(path)]
    rows += [(300, None, None, None, "", 0), (300, 0, "u", "tie", "", 0), (300, 0, "u", "tie", "", 0), (300, 0, "a", "tie", "", 0), (None, 1, "u", "x", "", 0)]
    rows += [(5, i, "u", "a" * (i % 3), "", 0) for i in range(150)] + [(705, i, "u", "a" * (i % 3), "", 0) for i in range(150)]
    return rows


@pytest.mark.parametrize("block,run,piece", [(4, 1024, 65_536), (1, 2, 1), (3, 2, 2)])
def test_trie_equals_brute_force(spark, monkeypatch, block, run, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "RUN", run)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    rows = conversations_of(random.Random(block), 250)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string, at int")
    assert trie_rows(prefix_trie.prefix_trie(frame.repartition(5))) == trie_expected(rows)


def test_trie_of_few_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    for rows in ([], [(None, 1, "u", "x")], [(7, 1, "u", "x")], [(c, 0, "u", LONG) for c in range(100, 190)]):
        frame = spark.createDataFrame(rows, schema)
        assert trie_rows(prefix_trie.prefix_trie(frame)) == (trie_expected(rows) if rows and rows[0][0] is not None else [])

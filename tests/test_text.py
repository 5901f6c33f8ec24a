"""Folding, tokens and TF-IDF against plain Python."""

import math
import re
import unicodedata
from collections import Counter

import random
from collections import Counter

import pyarrow as pa
import pytest

from linkloom.functions.text import fold_text
from linkloom.operators import tfidf

TEXTS = [
    "Été À la plage, l'été 2020",
    "ﬁne ½ cup… of œuvre & ＡＢＣ straße №5 Ⅳ",
    "don't stop_now  a b cd",
    "İstanbul Ångström ™ 𝐁old x²",
    "",
    "plain plain text été",
]


def py_fold(text):
    return unicodedata.normalize("NFKD", text.lower()).encode("ascii", "ignore").decode()


def py_tokens(text):
    return re.findall(r"\b\w\w+\b", py_fold(text))


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "node_id bigint, text string")


def test_fold_equals_python(nodes):
    got = {r.node_id: r.text for r in fold_text(nodes).collect()}
    assert got == {i: py_fold(t) for i, t in enumerate(TEXTS)}


def test_fold_of_every_decomposing_character(spark):
    chars = [chr(c) for c in range(0xA0, 0x20000)
             if not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFKD", chr(c)) != chr(c)]
    # Java and Python may know different Unicode versions when lower-casing
    chars = [c for c in chars if c.lower() == c]
    rows = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "node_id int, text string")
    got = {r.node_id: r.text for r in fold_text(rows).collect()}
    wrong = [c for i, c in enumerate(chars) if got[i] != py_fold(f"x{c}y")]
    assert wrong == []


def test_tokens_equal_python(nodes):
    got = {r.node_id: r.tokens for r in tfidf.tokenize(nodes).collect()}
    assert got == {i: py_tokens(t) for i, t in enumerate(TEXTS)}


def test_vectors_equal_python(nodes):
    docs = [Counter(py_tokens(t)) for t in TEXTS]
    df = Counter(t for d in docs for t in d)
    total = sum(docs, Counter())
    kept = [t for t in df if 1 <= df[t] <= 0.5 * len(docs)]
    kept = sorted(sorted(kept, key=lambda t: (-total[t], t))[:5])
    model = tfidf.fit_tfidf(nodes, dim=5, min_df=0.001, max_df=0.5)
    assert list(model.terms) == kept
    got = {r.node_id: r.vec for r in model.vectors(nodes, to_sparse=False).collect()}
    for i, doc in enumerate(docs):
        raw = [doc[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in kept]
        norm = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in raw], abs=1e-12)


def test_encode_cuts_and_pads(nodes):
    model = tfidf.fit_tfidf(nodes, dim=5, min_df=0.001, max_df=0.5)
    rows = {r.node_id: r for r in model.encode(nodes, length=3).collect()}
    assert rows[4].input_ids == [0, 0, 0] and rows[4].attention_mask == [0, 0, 0]
    assert all(len(r.input_ids) == len(r.attention_mask) == 3 for r in rows.values())
    first = py_tokens(TEXTS[5])[0]
    want = model.terms.index(first) + tfidf.FIRST_TERM if first in model.terms else tfidf.UNKNOWN
    assert rows[5].input_ids[0] == want


def test_no_term_left_is_an_error(nodes):
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(nodes, min_df=0.9, max_df=0.95)


def test_applying_a_vocabulary_needs_no_shuffle(nodes):
    model = tfidf.fit_tfidf(nodes, dim=5, min_df=0.001, max_df=0.5)
    plan = model.vectors(nodes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_sketch_rules_out_rare_terms_only(spark, monkeypatch):
    draw = random.Random(7)
    texts = [" ".join([f"w{draw.randrange(30)}" for _ in range(draw.randrange(40))] + [f"junk{i}x{k}" for k in range(60)]) for i in range(300)]
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "w1 w1 w1"])], "node_id bigint, text string").repartition(5)
    tokens = tfidf.tokenize(nodes)
    want = Counter(t for text in [*texts, "w1"] for t in set(text.split()))
    total = Counter(t for text in [*texts, "w1 w1 w1"] for t in text.split())
    sketch = tfidf.term_sketch(tokens)
    names = sorted(want)
    estimates = dict(zip(names, sketch.estimate(pa.array(names)).tolist(), strict=True))
    assert all(estimates[t] >= want[t] for t in names)
    rare = [t for t in names if t.startswith("junk")]
    assert sum(estimates[t] >= 5 for t in rare) < 0.01 * len(rare)
    for held in (500_000, 50):
        monkeypatch.setattr(tfidf, "HELD_TERMS", held)
        every = {r.term: (r.df, r.total) for r in tfidf.document_frequency(nodes).collect()}
        assert every == {t: (want[t], total[t]) for t in names}
        for least in (1, 5, 200):
            got = {r.term: (r.df, r.total) for r in tfidf.frequent_terms(tokens, least).collect()}
            assert got == {t: x for t, x in every.items() if x[0] >= least}
    none = tfidf.tokenize(nodes.limit(0))
    assert tfidf.frequent_terms(none, 1).count() == 0 and tfidf.document_frequency(nodes.limit(0)).count() == 0


def test_tokens_are_counted_in_bounded_slices(monkeypatch):
    """Batches of any size are cut by tokens; nulls, empty texts and longer ones than a slice are counted too."""
    import pyarrow as pa

    monkeypatch.setattr(tfidf, "COUNTED_TOKENS", 10)
    lists = [["a", "b"] * 3, None, [], ["b"] * 7, ["c", "a"] * 20, *[["d", "a"]] * 30, []]
    batches = [pa.RecordBatch.from_arrays([pa.array(part, pa.list_(pa.string()))], names=["tokens"]).slice(skip) for part, skip in ((lists, 0), ([["x"] * 3, *lists], 1))]
    slices = list(tfidf._token_slices(batches))
    assert sum((part.to_pylist() for part in slices), []) == lists * 2
    assert max(len(part.flatten()) for part in slices if len(part) > 1) <= 10
    df, total = {}, {}
    for part in slices:
        for term, d, t in zip(*(list(x) for x in tfidf._batch_counts(part)), strict=True):
            df[term.as_py()], total[term.as_py()] = df.get(term.as_py(), 0) + d, total.get(term.as_py(), 0) + t
    assert df == {"a": 64, "b": 4, "c": 2, "d": 60} and total == {"a": 106, "b": 20, "c": 40, "d": 60}

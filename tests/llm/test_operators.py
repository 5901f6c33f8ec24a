"""Operators of the training-data pipeline against brute force, with their defined cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, compare
from linkloom.llm import (
    decontaminate, encode, hashing, jaccard, licences, lines, neardup_vectors, packing, quality, substrings, tokenids, warc,
)
from linkloom.session import scratch_path

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
#: Nulls, empty, repeated and long rows, and columns whose names clash with inner ones.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta\nAlpha\n\nalpha ", "x", 1), (1, "alpha beta gamma delta epsilon zeta\nAlpha\n\nalpha ", "x", 1),
    (2, None, None, None), (3, "", "y", 2), (None, "one two", "z", 3), (None, None, None, None), (4, LONG, "x", 4), (5, LONG + "end", "x", 5),
    (6, " \t\r\n\x0b\x0c ", "x", 6), (7, "é\x00 　 ß", "x", 7), (1, "another text of the same id", "x", 8),
]
SCHEMA = "doc_id long, text string, _row string, n long"
BYTES = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


# ------------------------------------------------------------------- 1. WARC

PAGES = [
    (1, "u", "a\r\n"), (2, None, "a\r\n"), (3, "u\r\nx", ""), (4, "u", None), (None, "u", ""), (5, "u", "\r\n\r\n\r\n\r"),
    (6, "u", "x\r\n\r\n\r\ny\r"), (7, "u", "\r\r\n\r\n"), (8, "u", "é\x00"), (9, "u", "x\r\n\r\r\n\r\n"), (9, "u", "x\r\n\r\r\n\r\n"), (10, "u", LONG),
]


def warc_expected(pages):
    groups = defaultdict(list)
    for page_id, _, html in pages:
        payload = (html or "").encode()
        groups[base64.b32encode(hashlib.sha1(payload).digest()).decode()].append((page_id, len(payload)))
    out = []
    for digest, members in groups.items():
        top = max((i for i, _ in members if i is not None), default=None)
        for page_id, size in members:
            response = top is None or page_id == top
            out.append((page_id, size, digest, "response" if response else "revisit", None if response else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [0, 1000])
def test_warc_round_trip(spark, groups):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archives, members = scratch_path(spark, "a"), scratch_path(spark, "m")
    warc.write_archives(pages, archives, broadcast_groups=groups)
    found = warc.read_records(warc.normalise(spark, archives, members), members).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found], key=str)
    assert got == warc_expected(PAGES)
    texts = {page_id: (html or "").encode() for page_id, _, html in PAGES}
    assert all(bytes(r.payload) == texts[r.page_id] for r in found if r.record_type == "response")


def test_warc_query_and_empty(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert rows_of(entry.queries()["op1_warc_normaliser"](spark, SF)) == warc_expected(pages)
    archives, members = scratch_path(spark, "a"), scratch_path(spark, "m")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), archives)
    assert warc.read_records(warc.normalise(spark, archives, members), members).count() == 0


def test_warc_cut_off_archive_is_an_error():
    assert list(warc.split_records([])) == []
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 9", b"abc"]))


# --------------------------------------------------------------- hashes of words


def thue_morse(size, letters="ab"):
    return "".join(letters[i.bit_count() % 2] for i in range(size))


def test_word_hashes_tell_words_apart():
    draw = random.Random(1)
    found = {thue_morse(n, x) for n in (8, 64, 256, 512, 1024, 4096) for x in ("ab", "ba")}
    found |= {"".join(draw.choice("ab") for _ in range(draw.randint(1, 40))) for _ in range(3000)}
    found |= {"a" * n for n in range(1, 600)} | {"é" * n for n in range(1, 20)}
    data = np.frombuffer(" ".join(sorted(found)).encode(), dtype=np.uint8)
    starts, ends, hashes = hashing.words(data, lanes=2)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == sorted(found)
    assert all(len(set(lane.tolist())) == len(found) for lane in hashes)
    assert (hashing.words(data)[2] == hashes[0]).all()
    upper = np.frombuffer(b"abc ABC aBc abd", dtype=np.uint8)
    assert len(set(hashing.words(upper, fold=True)[2].tolist())) == 2


def test_run_hashes_depend_on_their_words_alone():
    one = np.arange(200, dtype=np.uint64) % np.uint64(7)
    begins, sizes = np.array([0, 7, 70, 70, 71]), np.array([35, 35, 64, 63, 63])
    got = hashing.run_hashes(one, begins, sizes, 35).tolist()
    assert got[0] == got[1] and got[2] not in got[3:] and got[3] != got[4] and len(set(got)) == 4


@pytest.mark.parametrize("size", [256, 1024])
def test_words_of_equal_sums_are_different(spark, size):
    one, two = thue_morse(size), thue_morse(size, "ba")
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {one}"), (2, f"{same} {two}")]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == without_repeats(rows)
    links = jaccard.jaccard_components(spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in links.collect()) == [(1, 1), (2, 2)]


# ------------------------------------------------------- 2. repeated passages


def without_repeats(rows, width=35):
    words = [(text or "").encode().split() for _, text in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        drop = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                drop[i : i + width] = [True] * width
        kept = [x for x, d in zip(w, drop, strict=True) if not d]
        out.append((doc_id, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return rows_of(substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)))


@pytest.mark.parametrize("wide", [500, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(substrings, "WIDE", wide)
    draw = random.Random(3)
    passages = [" ".join(draw.choice("abcdefghij") for _ in range(draw.randint(30, 60))) for _ in range(6)]
    rows = [
        (i, " ".join(draw.choice([draw.choice(passages), f"x{draw.randrange(99)} y z", "q " * draw.randrange(60)]) for _ in range(draw.randint(0, 5))))
        for i in range(120)
    ] + [(None, None), (5, ""), (7, passages[0]), (7, passages[0]), (None, passages[1])]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string")) == without_repeats(rows)


def test_repeats_of_documents_and_odd_rows(spark, documents, odd, empty):
    query = entry.queries()["op2_substring_dedup"](spark, SF)
    assert rows_of(query) == without_repeats([tuple(r) for r in documents.collect()])
    short = [row for row in ODD if len(row[1] or "") < 1000] + [(8, "w " * 100, "", 0)]
    assert removed(spark.createDataFrame(short, SCHEMA)) == without_repeats([row[:2] for row in short])
    assert removed(empty) == []


def test_suffix_automaton_counts_windows():
    draw = random.Random(1)
    for _ in range(50):
        texts = [[draw.randrange(3) for _ in range(draw.randint(1, 30))] for _ in range(4)]
        automaton = substrings.SuffixAutomaton()
        for text in texts:
            automaton.add(text)
        automaton.finish()
        seen = Counter(tuple(t[i : i + 4]) for t in texts for i in range(len(t) - 3))
        for text in texts:
            assert automaton.repeated(text, 4) == [i for i in range(len(text) - 3) if seen[tuple(text[i : i + 4])] > 1]


# ---------------------------------------------------------------- 3. licences


def test_licences_found(spark, documents, odd, empty):
    model = licences.LicenceModel.fit(documents)
    got = licences.scan_licences(documents, model=model).filter("confirmed").groupBy("family").count()
    want = Counter()
    notices = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit",
    }
    for row in documents.collect():
        want.update(notices[line] for line in row.text.split("\n") if line in notices)
    assert {r["family"]: r["count"] for r in got.collect()} == dict(want)
    texts = ["Released under the MIT licence", "license to kill", None, "", "All rights reserved.", "plain words"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.family, r.confirmed) for r in licences.scan_licences(made, model=model).collect()}
    assert found[0] == ("mit", True)
    assert not any(confirmed for i, (_, confirmed) in found.items() if i) and not {2, 3, 5} & set(found)
    assert licences.scan_licences(odd.withColumn("line", F.lit(1)), model=model).count() == 0
    assert licences.scan_licences(empty).count() == 0


def test_licence_within_a_longer_line(spark, documents):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."
    )
    prose = "We wrote this note in spring and it grew over time. Released under the MIT License. Write to us with any question or wish."
    other = "The permission to visit was granted in spring, and the license of the driver was sent by the foundation to any person who asked."
    made = spark.createDataFrame(list(enumerate([mit, prose, other])), "doc_id long, text string")
    model = licences.LicenceModel.fit(documents)
    found = {r.doc_id: (r.family, r.confirmed, r.similarity) for r in licences.scan_licences(made, model=model).collect()}
    assert found[0][:2] == ("mit", True) and found[1][:2] == ("mit", True), found
    assert not found[2][1], found


def test_licence_lines_of_the_whole_corpus_count(spark):
    """Not first lines and not some thousand lines: every line without licence words, with its count."""
    texts = [f"first {i}\nThe public foundation of town {i % 40} met.\n\nThis license is none.\nlast {i}" for i in range(3000)]
    made = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    lines = licences.corpus_lines(made, licences.marked_lines(made)).collect()
    assert sum(r.n for r in lines) == 3 * 3000
    assert {r.line: r.n for r in lines if r.line} == {f"The public foundation of town {i} met.": 75 for i in range(40)}
    assert sum(not r.line for r in lines) == 2


@pytest.mark.parametrize("share", [0.0, 0.3, 0.99, 1.0])
def test_weighted_quantile(spark, share):
    rows = [(0.0, 5), (1e-9, 1), (0.25, 3), (0.25 + 1e-12, 2), (0.7, 88), (1.0, 1)]
    every = sorted(p for p, n in rows for _ in range(n))
    want = every[max(0, int(np.ceil(share * len(every))) - 1)]
    assert licences.weighted_quantile(spark.createDataFrame(rows, "probability double, n long"), share) == want
    assert licences.weighted_quantile(spark.createDataFrame([], "probability double, n long"), share) is None


# --------------------------------------------------------- 4. similar sets


def set_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = BYTES.findall(lowered)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components_of(rows):
    sets = [(doc_id, set_of(text)) for doc_id, text in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and i is not None and j is not None and 4 * len(s & t) >= 3 * len(s | t):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=str)


def test_similar_sets(spark, documents, odd, empty):
    query = entry.queries()["op4_ngram_jaccard"](spark, SF)
    assert rows_of(query) == components_of([tuple(r) for r in documents.collect()])
    draw = random.Random(7)
    base = [[f"w{draw.randrange(50)}" for _ in range(draw.randint(3, 60))] for _ in range(8)]
    rows = []
    for i in range(160):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(50)}"
        rows.append((i, " ".join(words).upper() if i % 3 else " \n".join(words)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (0, rows[0][1])]
    for limit in (10, 500_000):
        made = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1))
        assert rows_of(jaccard.jaccard_components(made, limit=limit)) == components_of(rows)
    assert rows_of(jaccard.jaccard_components(odd)) == components_of([row[:2] for row in ODD])
    assert jaccard.jaccard_components(empty).count() == 0


def test_bitmaps_never_rule_out_similar_sets(spark):
    draw = np.random.default_rng(5)
    kinds = "all any".split()
    rows, similar = [], []
    for i in range(300):
        one = hashing.mix(draw.integers(0, 1 << 40, draw.integers(1, 400)).astype(np.uint64))
        other = np.where(draw.random(len(one)) < draw.choice([0.0, 0.1, 0.15, 0.5]), hashing.mix(one + np.uint64(1)), one)
        one, other = np.unique(one), np.unique(other)
        units = [
            (len(x) << 32, *[w for _ in kinds for w in jaccard._bitmap(x)]) for x in (one, other)
        ]
        rows.append((i, *units))
        both = len(np.intersect1d(one, other))
        similar.append(100 * both >= 75 * (len(one) + len(other) - both))
    unit = "struct<place:long," + ",".join(f"{k}{i}:long" for k in kinds for i in range(jaccard.WORDS)) + ">"
    made = spark.createDataFrame(rows, f"i long, x {unit}, y {unit}")
    kept = {r.i for r in made.filter(jaccard._bits_fit("x", "y", 75)).select("i").collect()}
    assert {i for i, is_similar in enumerate(similar) if is_similar} <= kept
    assert len(kept) < 1.2 * sum(similar)


def test_only_texts_of_pairs_are_fetched(spark, monkeypatch):
    def text(name, n):
        return " ".join(f"{name}x{i}" for i in range(n))

    close = [(30, text("d", 60)), (31, text("d", 61)), (32, text("e", 40)), (32, text("f", 40)), (33, text("f", 41))]
    rows = [(i, text(f"a{i}", 20 + i)) for i in range(20)] + close
    fetched, among = [], jaccard._maybe_among
    monkeypatch.setattr(jaccard, "_maybe_among", lambda *x: fetched.append(among(*x)) or fetched[-1])
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(found) == components_of(rows)
    assert sorted(r.doc_id for r in fetched[0].collect()) == [i for i, _ in close]


def test_only_lists_with_untried_pairs_stay(spark):
    groups = {1: [(1, 0), (2, 0)], 2: [(1, 0), (2, 0), (3, 0)], 3: [(i, 0) for i in range(4)], 4: [(9, 0), (1, 0)], 5: [(1, 1), (2, 2)]}
    rows = [(key, g, 7, part) for key, found in groups.items() for g, part in found]
    shared = spark.createDataFrame(rows + rows[:3], "shingle long, g long, place long, part int")
    left = jaccard._untried(shared, spark.createDataFrame([(9,), (77,)], "g long"))
    assert rows_of(left) == sorted([(key, g, 7) for key in (3, 4, 5) for g, _ in groups[key]], key=str)
    alone = jaccard._untried(shared, spark.createDataFrame([], "g long")).select("key").distinct()
    assert rows_of(alone) == [(3,), (5,)]


def test_marks_keep_all_wanted_ids(spark):
    ids = [-5, 0, 3, 2**40, *range(100, 3000, 29)]
    docs = spark.range(-1000, 5000).selectExpr("id as doc_id", "'x' as text").union(spark.createDataFrame([(2**40, None), (None, "n")], "doc_id long, text string"))
    kept = {r.doc_id for r in jaccard._maybe_among(docs, spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()}
    assert set(ids) <= kept and len(kept) < len(ids) + 20


def test_long_lists_are_dealt_in_parts():
    order = jaccard.Order(np.array([3, 9], dtype=np.uint64), np.array([10, 5 * jaccard.LIST_PART]))
    found = [order.list_parts(np.array([3, 5, 9], dtype=np.uint64), g).tolist() for g in range(-6, 7)]
    assert {x[0] for x in found} == {x[1] for x in found} == {0}
    assert {x[2] for x in found} == {1, 2, 3, 4, 5, 6}


# ------------------------------------------------------- 5. and 9. token ids


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(encode.tokenizer_path())
    return lambda text: [*found.encode(text or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_whole_texts(tokenizer):
    draw, ours = random.Random(1), encode.encoder(encode.tokenizer_path())
    signs = [*"ab!1'  \n\n\t\x1c\x85\xa0 　é中.,sS\r\x0b​", "'s", "<|endoftext|>", "²", "١"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randint(0, 14)))
        assert np.frombuffer(ours.encode([text])[0], dtype="<u4").tolist() == tokenizer(text)[:-1], repr(text)
    plain = [*"abZ09 \n\t\r\x0b\x0c\x00\x1c\x1f\x7f_-'!éßÄ", "'s", "'ll", "'re", "'T", "  ", "\n\n", "the", " of"]
    texts = ["".join(draw.choice(plain) for _ in range(draw.randint(0, 20))) for _ in range(4000)]
    assert all(encode._PLAIN.fullmatch(text) for text in texts)
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer(text)[:-1], repr(text)


def test_added_tokens_as_in_the_plain_call(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(encode.tokenizer_path())
    draw, ours = random.Random(2), encode.encoder(encode.tokenizer_path())
    end = "<|endoftext|>"
    texts = [f"a {end} b", f"\n\n{end}", end, f"{end}{end}", f"x{end}\n\n\nb", f"<|endof{end}text|>", f" {end} ", "a < | b", "", None]
    signs = [end, end, "<|", "|>", "endoftext", *"ab!1'  \n\n\t\x1c\x85　é中", "'s"]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 14))) for _ in range(2000)]
    want = [plain.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert want[0] == [64, 220, 50256, 275]
    got = [np.frombuffer(ids, dtype="<u4").tolist() for ids in ours.encode(texts)]
    assert [(t, g) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []
    docs = spark.createDataFrame(list(enumerate(texts[:8])), "doc_id long, text string")
    path = scratch_path(spark, "ids")
    manifest = tokenids.write_ids(docs, path, tokenizer=encode.tokenizer_path())
    read = {r.doc_id: np.frombuffer(bytes(r.ids), dtype="<u4").tolist() for r in tokenids.read_ids(spark, path, manifest).collect()}
    assert read == {i: [*ids, 0] for i, ids in enumerate(want[:8])}
    tokens = {r.doc_id: r.doc_tokens for r in packing.pack_documents(docs).collect()}
    assert tokens == {i: len(ids) + 1 for i, ids in enumerate(want[:8])}


def test_directly_addressable_codes():
    ids = np.random.default_rng(1).integers(0, 70_000, 3000).astype("<u4")
    segment = tokenids.Segment(tokenids.pack_segment(ids))
    assert [segment.get(i) for i in range(3000)] == ids.tolist()
    for start, end in [(0, 3000), (5, 9), (511, 1025), (2990, 3000), (7, 7)]:
        assert segment.slice(start, end).tolist() == ids[start:end].tolist()


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_token_files(spark, documents, odd, empty, tokenizer, monkeypatch, size):
    def written(docs):
        path = scratch_path(spark, "ids")
        manifest = tokenids.write_ids(docs, path, tokenizer=encode.tokenizer_path())
        return [(r.doc_id, r.start, bytes(r.ids)) for r in tokenids.read_ids(spark, path, manifest).orderBy("start").collect()]

    monkeypatch.setattr(tokenids, "SEGMENT", size)
    for docs in (documents, odd):
        rows = sorted([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, start = [], 0
        for doc_id, text in rows:
            ids = tokenizer(text)
            want.append((doc_id, start, np.array(ids, dtype="<u4").tobytes()))
            start += len(ids)
        assert written(docs) == want
    assert written(empty) == []


def check_packing(rows, texts, tokenizer):
    ids = [(doc_id, np.array(tokenizer(text), dtype="<u4").tobytes()) for doc_id, text in texts]
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
    assert sum(r.length for r in rows) == sum(len(b) // 4 for _, b in ids)
    known = Counter((doc_id, len(b) // 4, start, r) for doc_id, b in ids for start, r in [(0, zlib.crc32(b[:4096]))])
    for (doc_id, total), found in pieces.items():
        wanted = [b for i, b in ids if i == doc_id and len(b) == 4 * total]
        covered = Counter(p for r in found for p in range(r.start, r.start + r.length))
        assert covered == Counter(dict.fromkeys(range(total), len(wanted)))
        sums = Counter(zlib.crc32(b[4 * r.start : 4 * (r.start + r.length)]) for r in found for b in wanted)
        assert all(r.ids_crc32 in sums for r in found)
    assert known
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0


def test_packing(spark, documents, odd, empty, tokenizer):
    query = entry.queries()["op9_packing"](spark, SF)
    check_packing(query.collect(), [tuple(r) for r in documents.collect()], tokenizer)
    check_packing(packing.pack_documents(odd).collect(), [row[:2] for row in ODD], tokenizer)
    assert packing.pack_documents(empty).count() == 0


def test_packing_plan():
    draw = random.Random(2)
    for _ in range(20):
        counts = {draw.randint(1, 64): draw.randint(1, 500) for _ in range(draw.randint(0, 40))}
        plan = packing.plan_packing(counts, 64)
        used = defaultdict(list)
        for length, low, high, _, _ in plan.places:
            used[length] += range(low, high)
        for length, low, _ in plan.rest:
            used[length] += range(low, counts[length])
        assert all(sorted(used[length]) == list(range(n)) for length, n in counts.items())


# ------------------------------------------------------------- 6. vectors


def test_vector_links(spark):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(40, 64))
    rows = [base[i % 40] + draw.normal(size=64) * draw.choice([0.02, 0.1, 0.2, 0.3]) for i in range(600)]
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    vectors += [(600 + i, vectors[0][1]) for i in range(30)]  # copies
    odd = [
        (700, None), (701, [0.0] * 64), (702, [None] + [1.0] * 63), (703, [float("nan")] * 64), (704, [float("inf")] * 64),
        (None, vectors[0][1]), (705, [1.0, 2.0]), (706, [2.0, 4.0]), (707, []),
    ]
    made = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    got = {r.vec_id: r for r in neardup_vectors.vector_links(made).collect()}
    unit = np.array([v for _, v in vectors])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = np.array([got[i].n_links for i, _ in vectors])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.99 * near.sum()
    one = near.nonzero()
    roots = neardup_vectors.local_roots(*one, len(vectors))
    assert np.mean([got[i].component_id == vectors[roots[k]][0] for k, (i, _) in enumerate(vectors)]) > 0.99
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (700, 701, 702, 703, 704, 707))
    assert got[None].n_links == 0 and got[None].kept and got[706].component_id == 705 and not got[706].kept
    assert neardup_vectors.vector_links(made.limit(0)).count() == 0


def test_vector_links_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup_vectors, "BLOCK", 16)
    draw = np.random.default_rng(5)
    base = draw.normal(size=64)
    rows = [(i, [float(x) for x in base + draw.normal(size=64) * 0.02]) for i in range(120)]
    got = neardup_vectors.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(119, 0)}


# ------------------------------------------------------------- 7. quality


def test_quality(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op7_quality_classifier"](spark, sf).toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    hidden = both[both.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert len(got) == 1000 and (hidden.predicted == hidden.quality).mean() > 0.95
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (4, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    for docs in (odd, empty):
        weights = quality.fit_quality(docs, labels)
        scored = quality.score_quality(docs, weights, score="score")
        assert scored.count() == docs.count() and scored.columns == [*docs.columns, "score"]
        assert scored.filter("score is null or score < 0 or score > 1").count() == 0
    none = quality.fit_quality(odd, labels.limit(0))
    assert {r.score for r in quality.score_quality(odd, none).collect()} == {0.5}


def test_training_equals_plain_ftrl():
    """Coordinate by coordinate on dense rows, as in the paper."""
    draw, bits = np.random.default_rng(3), 4
    rows = [(np.sort(draw.choice(16, size=draw.integers(0, 9), replace=False)), int(draw.integers(0, 2))) for _ in range(40)]
    rows = [(index, draw.integers(1, 5, len(index)), label) for index, label in rows]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for index, counts, label in rows:
            x = [0.0] * 16 + [1.0]
            for i, c in zip(index.tolist(), counts.tolist(), strict=True):
                x[i] = quality.SCALE * c / sum(counts.tolist())
            p = 1 / (1 + np.exp(-sum(weight(i) * x[i] for i in range(17))))
            for i in range(17):
                if x[i]:
                    g = (p - label) * x[i]
                    sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                    z[i], n[i] = z[i] + g - sigma * weight(i), n[i] + g * g
    got = quality.train_ftrl(rows, bits=bits, alpha=alpha, beta=beta, l1=l1, l2=l2)
    assert np.allclose(got, [weight(i) for i in range(17)], rtol=1e-9, atol=1e-12)


def test_scores_are_sparse_dot_products(spark):
    """Of each word, its shape, both pairs and the repeat, by counting one by one."""
    texts = ["One two  two", "", "x1 X1-y", "a " * 50, None, "é É é"]
    weights = np.random.default_rng(2).normal(size=2**6 + 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, weights).collect()}
    for i, text in enumerate(texts):
        alone = pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())})
        indices, _ = quality.features(alone, bits=6)
        assert len(indices) == 5 * len((text or "").split())
        counts = Counter(indices.tolist())
        logit = weights[-1] + sum(weights[k] * quality.SCALE * n / len(indices) for k, n in counts.items())
        assert scored[i] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-9)


# ------------------------------------------------- 8. benchmark passages


def least_edits(item, text):
    before = [0] * (len(text) + 1)
    for i, sign in enumerate(item, 1):
        row = [i]
        for j, other in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (sign != other)))
        before = row
    return min(before)


def test_matcher_equals_brute_force():
    draw = random.Random(5)
    for _ in range(150):
        item = " ".join("".join(draw.choice("ab cd") for _ in range(draw.randint(20, 60))).split())
        changed = list(item)
        for _ in range(draw.randint(0, 6)):
            at = draw.randrange(len(changed))
            changed[at : at + draw.randint(0, 1)] = draw.choice(["", "x", "ab"])
            changed = changed or ["a"]
        text = "".join(draw.choice("abcd ") for _ in range(60)) + "".join(changed) + "".join(draw.choice("abcd ") for _ in range(50))
        text = " ".join(text.split())
        best = least_edits(item, text)
        found = decontaminate.Matcher(((1, item),), 10).find(text)
        assert [f[3] for f in found] == ([best] if best <= len(item) // 10 else [])
        assert all(least_edits(item, text[f[4] : f[5]]) == f[3] for f in found)


def test_leaks(spark, documents, odd, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = entry.queries()["op8_decontamination"](spark, SF).collect()
    folded = [(r.item_id, decontaminate.fold(r.text)) for r in items.collect()]
    exact = {(r.doc_id, i) for r in documents.collect() for i, item in folded if item in decontaminate.fold(r.text)}
    assert exact <= {(r.doc_id, r.item_id) for r in found} and all(r.distance <= r.budget for r in found)
    in_blocks = decontaminate.find_leaks(documents, items, block_chars=2000)
    assert rows_of(in_blocks) == sorted((tuple(r) for r in found), key=str)
    clean = decontaminate.drop_leaks(documents, items, block_chars=2000)
    assert {r.doc_id for r in documents.collect()} - {r.doc_id for r in clean.collect()} == {r.doc_id for r in found}
    more = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "word " * 20), (4, "word " * 20)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd, more).collect()} == {(4, 4), (5, 4)}
    assert decontaminate.find_leaks(empty, more).count() == 0 and decontaminate.find_leaks(odd, more.limit(0)).count() == 0
    assert decontaminate.drop_leaks(odd, more.limit(0)).count() == len(ODD)


def test_short_items_match_exactly_between_words(spark):
    items = spark.createDataFrame(
        [(1, "What is 12 times 13?"), (2, "Paris"), (3, None), (4, " \n"), (5, "word " * 20)], "item_id long, text string"
    )
    texts = [
        "Q: what  is 12\ntimes 13? A: 156", "what is 12 times 14?", "comparison, parish", "in (Paris), not parish", "somewhat is 12 times 13?", "",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.budget, r.distance, r.start, r.end) for r in found) == [(0, 1, 0, 0, 3, 23), (3, 2, 0, 0, 4, 9)]
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()} == {1, 2, 4, 5, 9}


# ------------------------------------------------------------- 10. lines


def test_line_query_equals_sql(spark):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    for name in entry.oracle_sql().keys() & {"op10_line_dedup"}:
        got = entry.queries()[name](spark, SF).toPandas()
        assert compare(got, db.execute(entry.oracle_sql()[name]).df()).startswith("ok")


def test_lines_of_odd_rows(spark, odd, empty):
    def expected(rows, least):
        def key(line):
            line = line.strip(" \t\n\x0b\f\r")
            return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

        holders = Counter(k for row in rows for k in {key(x) for x in (row[1] or "").split("\n")} if k)
        drops = {k for k, n in holders.items() if n >= least}
        out = []
        for row in rows:
            split = (row[1] or "").split("\n")
            kept = [x for x in split if key(x) not in drops]
            text = row[1] if len(kept) == len(split) else "\n".join(kept)
            out.append((row[0], text, *row[2:]))
        return sorted(out, key=str)

    for least in (2, 3):
        got = lines.dedup_lines(odd, min_docs=least)
        assert got.columns == odd.columns and rows_of(got) == expected(ODD, least)
    assert lines.dedup_lines(empty).count() == 0
    mapped = odd.withColumn("_lines", F.create_map(F.lit("a"), F.lit(1)))
    assert lines.dedup_lines(mapped, min_docs=2).count() == len(ODD)


def test_line_runs_are_levelled(spark):
    runs = lines.LineRuns(spark, fanout=2)
    batches = [[1, 2, 2], [2, 3], [4], [1]]
    for batch in batches:
        runs.add(spark.createDataFrame([(x,) for x in batch], "line long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert dict(rows_of(runs.counts())) == Counter(x for batch in batches for x in batch)
    new = spark.createDataFrame([(1,), (9,)], "line long")
    assert rows_of(runs.unseen(new)) == [(9,)]


# ------------------------------------------------------------- pipeline


def folded(line):
    return line.strip(lines.BLANKS).translate(str.maketrans(lines.UPPER, lines.UPPER.lower()))


def test_pipeline(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("_score", F.lit(1))
    start = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "line_dedup":
            held = Counter(key for r in before.values() for key in {folded(x) for x in (r.text or "").split("\n")} if key)
            for i, r in before.items():
                lines_ = (r.text or "").split("\n")
                stay = [x for x in lines_ if not folded(x) or held[folded(x)] < 10]
                assert after[i].text == (r.text if stay == lines_ else "\n".join(stay))
        if name == "near_duplicates":
            groups = components_of([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, _, component in groups if i == component}
        if name == "decontamination":
            items = [decontaminate.fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(before) - set(after) == {i for i, r in before.items() if any(x in decontaminate.fold(r.text) for x in items)}
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = [labels[i] for i in after if i in labels]
            assert sum(kept) >= 0.9 * sum(labels[i] for i in before if i in labels)
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert {r.doc_id for r in rows} <= set(start)
    sizes = Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    # all sequences are full but the last ones, which are powers of two
    assert all(size == 1024 or size.bit_count() == 1 for size in sizes.values())
    assert sum(size < 1024 for size in sizes.values()) <= 10


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [
        (1, one, "x"), (1, two, "x"), (2, one, "y"), (2, three, "y"), (3, three, "z"), (3, three, "z"),
        (4, "", "x"), (4, two, "w"), (None, one, "n"), (None, one, "n"), (5, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    want = [(1, one, "x"), (1, two, "x"), (2, three, "y"), (4, "", "x"), (5, None, "x"), (None, one, "n"), (None, one, "n")]
    assert rows_of(kept) == sorted(want, key=str)


def test_pipeline_stages_take_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            rows = spark.createDataFrame(out.collect(), out.schema)

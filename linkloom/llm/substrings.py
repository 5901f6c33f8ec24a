"""Operator 2: removal of repeated passages with suffix automata of reference shards.

Every window of ``width`` words that occurs twice anywhere in the corpus is removed. The
reference is the corpus itself, which no broadcast may hold, so shards are formed by
content and texts are routed to them:

* The anchor of a window is its smallest hashed run of ``GRAM`` words. Windows in a row
  with one anchor make a segment. Equal windows have equal anchors, so whatever repeats
  meets at its anchor; anchors found once are dropped on narrow rows.
* Segments of equal words are one class. A class of two or more repeats as a whole, and
  needs no more work. Only where an anchor has several classes do words travel: one
  copy of each class, to the shard of its anchor.
* A shard is some anchors in a row, with a bounded number of words. A suffix automaton of
  its classes is built with the number of occurrences per state; classes with one copy
  are streamed through it, and the matching state of each window tells whether it
  occurs again.
* An anchor with more than ``WIDE`` classes (a passage in many contexts) would make one
  shard too large; its windows are counted by a hash of their words instead, which
  spreads them and gives the same answer.

Defined cases: null and empty texts have no words; texts with fewer than ``width`` words
lose none; windows are judged on the input; fully repeated rows repeat each other; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from . import hashing
from .registry import query, table

WIDTH = 35
GRAM = 6
#: Classes of one anchor that may share an automaton: some 100,000 words, about 100 MB.
WIDE = 2000
#: An anchor of more than 1/HEAVY_SHARE of all segments is matched by broadcast; there are
#: fewer than HEAVY_SHARE such anchors.
HEAVY_SHARE = 10_000
#: Words of one automaton, from which on a new shard begins.
SHARD = 20_000
#: A class of segments: the hash of its anchor and 128 bits of its words.
CLASS = ["anchor", "words", "more"]


class SuffixAutomaton:
    """The automaton of several sequences, with the occurrences of each state's words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def _state(self, size: int, steps: dict) -> int:
        self.next.append(steps)
        self.size.append(size)
        self.link.append(0)
        self.count.append(0)
        return len(self.size) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        """The part of ``target`` that ends what ``state`` holds with ``symbol``."""
        if self.size[target] == self.size[state] + 1:
            return target
        copy = self._state(self.size[state] + 1, dict(self.next[target]))
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list, copies: int = 1) -> None:
        last = 0
        for symbol in sequence:
            target = self.next[last].get(symbol)
            if target is not None:
                last = self._split(last, symbol, target)
            else:
                new = self._state(self.size[last] + 1, {})
                state = last
                while state >= 0 and symbol not in self.next[state]:
                    self.next[state][symbol] = new
                    state = self.link[state]
                if state >= 0:
                    self.link[new] = self._split(state, symbol, self.next[state][symbol])
                last = new
            self.count[last] += copies

    def finish(self) -> None:
        """Add the occurrences of longer words to their suffixes."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def repeated(self, sequence: list, width: int) -> list[int]:
        """Starts of the windows of a sequence, itself added before, that occur twice or more."""
        found, state = [], 0
        for i, symbol in enumerate(sequence):
            state = self.next[state][symbol]
            while self.size[self.link[state]] >= width:
                state = self.link[state]
            if i + 1 >= width and self.count[state] > 1:
                found.append(i + 1 - width)
        return found


def ranges(positions) -> list[tuple[int, int]]:
    """Runs ``[from, to)`` of ascending positions."""
    positions = np.asarray(positions, dtype=np.int64)
    if not len(positions):
        return []
    breaks = np.flatnonzero(np.diff(positions) != 1)
    starts = positions[np.concatenate(([0], breaks + 1))]
    ends = positions[np.concatenate((breaks, [len(positions) - 1]))] + 1
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def segments(hashes: np.ndarray, bounds: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """``(text, start, windows, anchor, words, more)`` of each segment, as arrays.

    ``hashes`` has two lanes; ``start`` counts words in its text; ``words`` and ``more``
    are 128 bits of the words of the segment.
    """
    none = np.zeros(0, dtype=np.int64)
    nothing = (none, none, none, *[none.view(np.uint64)] * 3)
    if hashes.shape[1] < width:
        return nothing
    grams = hashing.shingles(hashes[0], gram)
    # upper half of the hash, then the place: the smallest run, the leftmost of equal ones
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span, reach, least = width - gram + 1, 1, keys
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    over = span - reach
    if over:
        least = np.minimum(least[: len(least) - over], least[over:])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(len(place))
    text = np.searchsorted(bounds, at, "right") - 1
    valid = np.flatnonzero(at + width <= bounds[np.minimum(text + 1, len(bounds) - 1)])
    if not len(valid):
        return nothing
    place, text = place[valid], text[valid]
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (np.diff(valid) != 1) | (text[1:] != text[:-1])))
    first = np.flatnonzero(new)
    windows = np.diff(np.append(first, len(valid)))
    begin = valid[first]
    body = [hashing.run_hashes(lane, begin, windows + width - 1, width) for lane in hashes]
    return text[first], begin - bounds[text[first]], windows, grams[place[first]], *body


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(0)).alias("_k"), F.xxhash64("text").alias("_a")
    )


def _segment_rows(keyed: DataFrame, width: int) -> DataFrame:
    def cut(batches):
        for batch in hashing.text_steps(batches):
            hashes, bounds = hashing.word_runs(batch, lanes=2)
            text, start, windows, anchor, words, more = segments(hashes, bounds, width)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("_k").to_numpy()[text]), pa.array(batch.column("_a").to_numpy()[text]),
                    pa.array((start << 32) + windows), *(pa.array(x.view(np.int64)) for x in (anchor, words, more)),
                ],
                names=["_k", "_a", "place", *CLASS],
            )

    return keyed.select("text", "_k", "_a").mapInArrow(
        cut, "_k long, _a long, place long, anchor long, words long, more long"
    )


def _contents(keyed: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``(anchor, words, more, n, classes, body)``: the word hashes of one copy of each class."""
    wanted = classes.groupBy("_k", "_a").agg(
        F.collect_list(F.struct("place", *CLASS, "n", "classes")).alias("_list")
    )

    def read(batches):
        for batch in hashing.text_steps(batches):
            hashes, bounds = hashing.word_runs(batch, lanes=2)
            rows = []
            for text, items in enumerate(batch.column("_list").to_pylist()):
                for item in items:
                    start = int(bounds[text]) + (item["place"] >> 32)
                    end = start + (item["place"] & 0xFFFFFFFF) + width - 1
                    rows.append((*(item[c] for c in (*CLASS, "n", "classes")), hashes[:, start:end].tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(values, pa.int64()) for values in columns[:5]), pa.array(columns[5], pa.binary())],
                names=[*CLASS, "n", "classes", "body"],
            )

    one = keyed.select("text", "_k", "_a").join(wanted, ["_k", "_a"])
    return store(
        one.mapInArrow(read, "anchor long, words long, more long, n long, classes long, body binary")
        .dropDuplicates(CLASS),
        "segment-words",
    )


def _lanes(body: bytes) -> np.ndarray:
    return np.frombuffer(body, dtype=np.uint64).reshape(2, -1)


def _by_automata(contents: DataFrame, width: int) -> DataFrame:
    """``(anchor, words, more, from, to)``: windows of single classes that occur in another place."""

    def match(batches):
        shard, symbols, anchor = [], 0, None

        def matched():
            automaton, out = SuffixAutomaton(), []
            for *_, n, body in shard:
                automaton.add(body, n)
            automaton.finish()
            for *name, n, body in shard:
                if n == 1:
                    out.extend((*name, *r) for r in ranges(automaton.repeated(body, width)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(values, pa.int64()) for values in columns], names=[*CLASS, "from", "to"]
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*CLASS, "n", "body")), strict=True):
                if symbols > SHARD and row[0] != anchor:
                    yield matched()
                    shard, symbols = [], 0
                anchor = row[0]
                # a symbol of the automaton is a word by both lanes of its hash
                body = list(zip(*_lanes(row[-1]).tolist(), strict=True))
                shard.append((*row[:-1], body))
                symbols += len(body)
        if shard:
            yield matched()

    routed = contents.filter(F.col("classes") <= WIDE).repartition("anchor").sortWithinPartitions("anchor")
    return routed.mapInArrow(match, "anchor long, words long, more long, from long, to long")


def _by_windows(contents: DataFrame, width: int) -> DataFrame:
    """The same for anchors with very many classes, by counting windows."""

    def windows(batches):
        for batch in batches:
            for *name, body in zip(*(batch.column(c).to_pylist() for c in (*CLASS, "n", "body")), strict=True):
                lanes = _lanes(body)
                begins = np.arange(lanes.shape[1] - width + 1)
                sizes = np.full(len(begins), width)
                yield pa.RecordBatch.from_pydict({
                    **{c: pa.array([value] * len(begins), pa.int64()) for c, value in zip((*CLASS, "n"), name, strict=True)},
                    **{c: pa.array(hashing.run_hashes(lane, begins, sizes, width).view(np.int64)) for c, lane in zip(("w1", "w2"), lanes, strict=True)},
                    "from": pa.array(begins),
                })

    listed = contents.filter(F.col("classes") > WIDE).mapInArrow(
        windows, "anchor long, words long, more long, n long, w1 long, w2 long, from long"
    )
    window = ["anchor", "w1", "w2"]
    often = listed.groupBy(*window).agg(F.sum("n").alias("_n")).filter(F.col("_n") > 1)
    return listed.filter(F.col("n") == 1).join(often, window, "left_semi").select(
        *CLASS, "from", (F.col("from") + 1).alias("to")
    )


def repeated_windows(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``(_k, _a, spans)``: for each text with repeats, runs ``[from, to)`` of window starts."""
    keyed = _keyed(docs)
    rows = store(_segment_rows(keyed, width), "segments")
    twice = store(rows.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1), "shared-anchors")
    bound = rows.count() // HEAVY_SHARE + 1
    heavy = F.broadcast(twice.filter(F.col("_n") > bound).select("anchor"))
    light = twice.filter(F.col("_n") <= bound).select("anchor")
    shared = store(
        rows.join(heavy, "anchor", "left_semi").unionByName(
            rows.join(heavy, "anchor", "left_anti").join(light.hint("merge"), "anchor", "left_semi")
        ),
        "shared-segments",
    )
    classes = store(
        shared.groupBy(*CLASS).agg(
            F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("_k", "_a", "place")]
        ),
        "segment-classes",
    )
    several = classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter(F.col("classes") > 1)
    contents = _contents(keyed, classes.join(several, "anchor"), width)
    whole = classes.filter(F.col("n") > 1).select(
        *CLASS, F.lit(0).cast("long").alias("from"),
        F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("to"),
    )
    found = store(
        whole.unionByName(_by_automata(contents, width)).unionByName(_by_windows(contents, width)), "repeated-parts"
    )
    start = F.shiftright("place", 32)
    return shared.join(found, CLASS).select(
        "_k", "_a", F.struct((start + F.col("from")).alias("from"), (start + F.col("to")).alias("to")).alias("_span")
    ).groupBy("_k", "_a").agg(F.collect_set("_span").alias("spans"))


def remove_repeats(docs: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)``: kept words joined by one blank."""
    spans = repeated_windows(docs, width=width)
    joined = _keyed(docs).join(spans, ["_k", "_a"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in hashing.text_steps(batches):
            rows = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = (text or "").encode().split()
                if found:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    for span in found:
                        change[span["from"]] += 1
                        change[span["to"] + width - 1] -= 1
                    keep = np.cumsum(change[:-1]) == 0
                    kept = [word for word, stays in zip(words, keep.tolist(), strict=True) if stays]
                else:
                    kept = words
                rows.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(values, pa.int64()) for values in columns[:3]), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


@query("op2_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )

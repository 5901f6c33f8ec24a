"""Operator 8: benchmark decontamination by pigeonhole edit matching.

Texts are folded: lower case, each run of white space one blank. A test item of n
characters may differ by ``budget = n // chars_per_edit`` edits and is split into
``budget + 1`` pieces, one of which any occurrence must hold unchanged. The pieces of all
items form one Aho-Corasick automaton; where a piece is found, Myers' bit-parallel
algorithm (1999) finds the smallest edit distance of the whole item around it.

The test items are a stated query set: they are collected in blocks of at most
``BLOCK_CHARS`` characters, each broadcast and run against all documents. Documents are
never shuffled.

Items that fold to fewer than ``min_chars`` characters have a budget of 0 and match only
between word boundaries: next to a letter or digit of theirs, the text has none.

Defined cases: items that are null or fold to nothing match nothing; null or empty documents hold nothing; repeated items and
documents are reported each; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hashing
from .registry import query, table

BLOCK_CHARS = 1_000_000
CHARS_PER_EDIT = 20
MIN_CHARS = 24


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def piece_bounds(length: int, budget: int) -> list[tuple[int, int]]:
    """``budget + 1`` pieces of nearly equal length."""
    cuts = [i * length // (budget + 1) for i in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of the pattern to any part of the text, and where it ends first."""
    size = len(pattern)
    mask, high = (1 << size) - 1, 1 << (size - 1)
    where: dict[str, int] = defaultdict(int)
    for i, sign in enumerate(pattern):
        where[sign] |= 1 << i
    plus, minus, score = mask, 0, size
    best, end = size, 0
    for i, sign in enumerate(text):
        equal = where.get(sign, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(horizontal | plus) & mask)
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & mask, (down << 1) & mask
        plus = down | (~(vertical | up) & mask)
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
    return best, end


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no word goes on over the start or the end of ``text[start:end]``."""
    return not (
        (start > 0 and text[start - 1].isalnum() and text[start].isalnum())
        or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum())
    )


class Matcher:
    """Finds test items in folded texts."""

    def __init__(self, items: tuple[tuple[int, str], ...], chars_per_edit: int, min_chars: int = 0):
        import ahocorasick

        self.min_chars = min_chars
        self.items = [
            (name, text, 0 if len(text) < min_chars else len(text) // chars_per_edit) for name, text in items
        ]
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for number, (_, text, budget) in enumerate(self.items):
            for start, end in piece_bounds(len(text), budget):
                pieces.setdefault(text[start:end], []).append((number, start, end))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> list[tuple]:
        """``(item, chars, budget, distance, start, end)`` of the best occurrence of each item in a folded text."""
        if self.empty or not text:
            return []
        shifts: dict[int, set[int]] = {}
        short: dict[int, int] = {}
        for last, places in self.automaton.iter(text):
            for number, _, end in places:
                start = last + 1 - end
                if len(self.items[number][1]) >= self.min_chars:
                    shifts.setdefault(number, set()).add(start)
                elif number not in short and bounded(text, start, last + 1):
                    short[number] = start
        found = [
            (self.items[number][0], len(self.items[number][1]), 0, 0, start, start + len(self.items[number][1]))
            for number, start in short.items()
        ]
        for number, starts in shifts.items():
            name, item, budget = self.items[number]
            best = None
            reached = -1
            for start in sorted(starts):
                low, high = max(0, start - budget), min(len(text), start + len(item) + budget)
                exact = text.find(item, low, high)
                if exact >= 0:
                    best = (0, exact, exact + len(item))
                    break
                if start <= reached:  # the window before it covers this occurrence
                    continue
                # one window serves all shifts within the budget of the first
                reached = start + budget
                high = min(len(text), reached + len(item) + budget)
                distance, end = myers(item, text[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    back = myers(item[::-1], text[low : low + end][::-1])[1]
                    best = (distance, low + end - back, low + end)
            if best:
                found.append((name, len(item), budget, *best))
        return found


@lru_cache(maxsize=1)
def _matcher(items: tuple, chars_per_edit: int, min_chars: int) -> Matcher:
    return Matcher(items, chars_per_edit, min_chars)


def item_blocks(items: DataFrame, *, block_chars: int = BLOCK_CHARS):
    """The folded test items in blocks that a broadcast may hold."""
    known = items.select("item_id", "text").filter(F.length("text") > 0)
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        part = known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], fold(r["text"])) for r in part.collect()), key=str)
        yield tuple(row for row in rows if row[1])


def find_leaks(
    docs: DataFrame, items: DataFrame, *, text: str = "text", chars_per_edit: int = CHARS_PER_EDIT,
    min_chars: int = MIN_CHARS, **options
) -> DataFrame:
    """``(doc_id, item_id, item_chars, budget, distance, start, end)``: items found in documents.

    Places count characters of the folded document.
    """
    spark = docs.sparkSession
    schema = (
        "doc_id long, item_id long, item_chars long, budget long, distance long, start long, end long"
    )
    result = spark.createDataFrame([], schema)
    for block in item_blocks(items, **options):
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            matcher = _matcher(shared.value, chars_per_edit, min_chars)
            for batch in hashing.text_steps(batches, text):
                out = []
                for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column(text).to_pylist(), strict=True):
                    out.extend((doc_id, *leak) for leak in matcher.find(fold(body)))
                columns = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.int64()) for values in columns],
                    names=[field.split()[0] for field in schema.split(", ")],
                )

        result = result.unionByName(docs.select("doc_id", text).mapInArrow(search, schema))
    return result


def drop_leaks(
    docs: DataFrame, items: DataFrame, *, text: str = "text", chars_per_edit: int = CHARS_PER_EDIT,
    min_chars: int = MIN_CHARS, **options
) -> DataFrame:
    """The documents that hold no test item; a filter without a shuffle."""
    for block in item_blocks(items, **options):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            matcher = _matcher(shared.value, chars_per_edit, min_chars)
            for batch in hashing.text_steps(batches, text):
                clean = [not matcher.find(fold(body)) for body in batch.column(text).to_pylist()]
                yield pc.filter(batch, pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


@query("op8_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

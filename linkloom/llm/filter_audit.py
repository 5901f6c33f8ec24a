"""Operator 11: how filters on whole texts interact, over every order of applying them.

Signals of a text come from one pass of a finite-state transducer over its UTF-8 bytes.
Bytes fall into classes, the state (between words or inside one) is fixed by the class of
the byte before, and a table gives what each state and class emits: a word begins, a word
ends, a code point, a capital, a symbol. Word spans go into an open-addressing hash table;
a span counts as seen only after its bytes equal those of the span in the slot.

A document's failures are one bit per filter. All orders of filters need only the counts
of documents per set of failures: what a set of filters keeps is a sum over them. So texts
are read once, ids and digests are shuffled, and no order is ever run over documents.
A text is identical to another by its SHA-256.

Defined cases: a null text is an empty one, a null part the empty string; a row with a
null id has no label, is no duplicate and makes none; rows of one id and text are no
duplicates of each other, each counts; an id counts as good or toxic if any of its label
rows says 1; an empty table gives no rows; columns other than those named are not read.
Memory of a task grows with its longest text (about 12 bytes per byte), not with the table.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import store
from . import hashing
from .registry import query, table

#: The filters and their limits.
LETTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"

#: Classes of bytes.
BLANK, CAPITAL, SYMBOL, ASCII, LEAD, CONTINUES = range(6)
CLASSES = np.full(256, ASCII, dtype=np.uint8)
CLASSES[hashing.SPACE] = BLANK
CLASSES[65:91] = CAPITAL
CLASSES[list(SYMBOLS)] = SYMBOL
CLASSES[0x80:0xC0] = CONTINUES
CLASSES[0xC0:] = LEAD
#: What is emitted.
BEGINS, ENDS, POINT, IS_CAPITAL, IS_SYMBOL = 1, 2, 4, 8, 16
BETWEEN, INSIDE = 0, 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """``(state after a class, emission by state and class)``."""
    after = np.full(6, INSIDE, dtype=np.uint8)
    after[BLANK] = BETWEEN
    emits = np.zeros((2, 6), dtype=np.uint8)
    emits[:, :CONTINUES] |= POINT
    emits[:, CAPITAL] |= IS_CAPITAL
    emits[:, SYMBOL] |= IS_SYMBOL
    emits[BETWEEN, CAPITAL:] |= BEGINS
    emits[INSIDE, BLANK] |= ENDS
    return after, emits


AFTER, EMITS = _tables()
#: Spans longer than this are hashed and compared by Python, each as a whole.
LONG_SPAN = 256
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)


def transduce(data: np.ndarray) -> np.ndarray:
    """What each byte emits; the pass begins between words."""
    classes = CLASSES[data]
    states = np.empty(len(data), dtype=np.uint8)
    states[:1] = BETWEEN
    states[1:] = AFTER[classes[:-1]]
    return EMITS.reshape(-1)[states * np.uint8(6) + classes]


class Spans:
    """Byte spans with hashes and an equality test on whole spans at once."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, groups: np.ndarray):
        self.data, self.starts, self.groups, self.sizes = data, starts, groups, ends - starts
        padded = data + bytes(8)
        #: The eight bytes from each place on.
        self.eight = np.ndarray((len(data),), dtype="<u8", buffer=padded, strides=(1,))
        self.long = self.sizes > LONG_SPAN

    def _part(self, spans: np.ndarray, at: int) -> np.ndarray:
        return self.eight[self.starts[spans] + at] & _TAIL[np.minimum(8, self.sizes[spans] - at)]

    def bytes(self, span: int) -> bytes:
        return self.data[self.starts[span] : self.starts[span] + self.sizes[span]]

    def hashes(self) -> np.ndarray:
        out = hashing.mix(self.groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.sizes.astype(np.uint64))
        left, at = np.flatnonzero(~self.long), 0
        while len(left):
            out[left] = hashing.mix(out[left] ^ self._part(left, at))
            at += 8
            left = left[self.sizes[left] > at]
        for span in np.flatnonzero(self.long).tolist():
            out[span] ^= np.uint64(hash(self.bytes(span)) & 0xFFFFFFFFFFFFFFFF)
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether spans ``a[i]`` and ``b[i]`` have one group and the same bytes."""
        same = (self.groups[a] == self.groups[b]) & (self.sizes[a] == self.sizes[b])
        left, at = np.flatnonzero(same & ~self.long[a]), 0
        while len(left):
            same[left] = self._part(a[left], at) == self._part(b[left], at)
            at += 8
            left = left[same[left] & (self.sizes[a[left]] > at)]
        for i in np.flatnonzero(same & self.long[a]).tolist():
            same[i] = self.bytes(a[i]) == self.bytes(b[i])
        return same


def new_spans(spans: Spans, hashes: np.ndarray) -> np.ndarray:
    """Which spans the hash table took in; the others equal one of them."""
    count = len(hashes)
    taken = np.zeros(count, dtype=bool)
    size = 1 << max(4, int(2 * count).bit_length())
    slots = np.full(size, -1, dtype=np.int64)
    left = np.arange(count)
    place = (hashes & np.uint64(size - 1)).astype(np.int64)
    while len(left):
        at = place[left]
        free = slots[at] < 0
        slots[at[free]] = left[free]  # one of those that want a slot gets it
        owner = slots[at]
        done = owner == left
        taken[left[done]] = True
        rest = np.flatnonzero(~done)
        done[rest] = spans.equal(owner[rest], left[rest])
        left = left[~done]
        place[left] = (place[left] + 1) & (size - 1)
    return taken


def count_signals(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    data = b"\n".join([*texts, b""])
    emitted = transduce(np.frombuffer(data, dtype=np.uint8))
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])

    def total(flag: int) -> np.ndarray:
        # every text has at least the line end after it
        return np.add.reduceat((emitted & flag) != 0, bounds[:-1], dtype=np.int64)

    starts, ends = np.flatnonzero(emitted & BEGINS), np.flatnonzero(emitted & ENDS)
    groups = np.searchsorted(bounds, starts, side="right") - 1
    spans = Spans(data, starts, ends, groups)
    taken = new_spans(spans, spans.hashes())
    return {
        "n_words": np.bincount(groups, minlength=len(texts)),
        "n_distinct": np.bincount(groups[taken], minlength=len(texts)),
        "n_capitals": total(IS_CAPITAL),
        "n_points": total(POINT) - 1,
        "n_symbols": total(IS_SYMBOL),
    }


def text_signals(docs: DataFrame, *, id: str = "doc_id", part: str = "source", text: str = "text") -> DataFrame:
    """``(id, part, n_words, n_distinct, n_capitals, n_points, n_symbols, digest)`` of each row."""
    read = docs.select(
        F.col(f"`{id}`").alias("id"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        F.col(f"`{text}`").alias("text"),
    )

    def apply(batches):
        for batch in hashing.text_steps(batches):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "part": batch.column("part"),
                **{name: pa.array(values, pa.int64()) for name, values in count_signals(texts).items()},
                "digest": pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()),
            })

    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(
        apply,
        f"id {kind}, part string, n_words long, n_distinct long, n_capitals long, n_points long, "
        "n_symbols long, digest binary",
    )


def text_failures() -> list[Column]:
    """Whether each of the filters on a text alone fails, in the order of ``LETTERS``."""
    return [
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITAL_PERCENT * F.col("n_points"),
        F.col("n_symbols") > 0,
    ]


def failed_sets(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, failed, docs, good, toxic)``: documents per part and set of failures.

    The last filter fails where a smaller id has the same digest. The smallest id of a
    digest is joined on digest and id, so copies of one text are spread over tasks.
    """
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_failures())]
    failed = sum(bits[1:], bits[0])
    rows = store(signals.select("id", "part", "digest", failed.alias("failed")), "signals")
    rows = rows.groupBy("id", "digest", "part", "failed").agg(F.count("*").alias("docs"))
    first = (
        rows.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"))
        .withColumn("first", F.lit(True))
    )
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        *[F.max(F.when(F.col(name) == 1, 1).otherwise(0)).alias(to) for name, to in (("quality", "good"), ("toxic", "toxic"))]
    )
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    return (
        rows.join(first, ["digest", "id"], "left").join(said, "id", "left")
        .groupBy("part", (F.col("failed") + F.when(copy, 1 << len(bits)).otherwise(0)).alias("failed"))
        .agg(F.sum("docs").alias("docs"), *[
            F.sum(F.col("docs") * F.coalesce(name, F.lit(0))).alias(name) for name in ("good", "toxic")
        ])
    )


def audit_orders(sets: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from ``failed_sets``.

    Bit ``i`` of ``failed`` is the filter ``letters[i]``. A part has at most
    ``2**len(letters)`` sets, which one row holds; orders are exploded from a literal.
    """
    count = len(letters)
    full = (1 << count) - 1
    subsets = F.sequence(F.lit(0), F.lit(full))

    def kept(name: str) -> Column:
        """By set of filters: the documents that fail none of them."""
        return F.transform(subsets, lambda s: F.aggregate(
            F.filter("_sets", lambda x: x["failed"].bitwiseAND(s) == 0), F.lit(0).cast("long"),
            lambda sum, x: sum + x[name],
        ))

    def shapley(i: int) -> str:
        """Removals by one filter over all orders, grouped by the set of filters before it."""
        return " + ".join(
            f"{factorial(s.bit_count()) * factorial(count - 1 - s.bit_count())} * (_docs[{s}] - _docs[{s | 1 << i}])"
            for s in range(full + 1) if not s & 1 << i
        )

    orders = F.lit(",".join(map("".join, permutations(letters))))
    bit = f"shiftleft(1, instr('{letters}', {{}}) - 1)"
    before = f"aggregate(slice(split(filter_order, ''), 1, _at), 0, (sum, x) -> sum + {bit.format('x')})"
    parts = (
        sets.groupBy("part").agg(F.collect_list(F.struct("failed", "docs", "good", "toxic")).alias("_sets"))
        .select("part", *[kept(name).alias(f"_{name}") for name in ("docs", "good", "toxic")])
        .withColumn("_shapley", F.expr(f"array({', '.join(shapley(i) for i in range(count))})"))
        .select("*", F.explode(F.split(orders, ",")).alias("filter_order"))
        .select("*", F.posexplode(F.split("filter_order", "")).alias("_at", "_letter"))
        .withColumns({"_before": F.expr(before), "_bit": F.expr(bit.format("_letter"))})
        .withColumn("_after", F.col("_before") + F.col("_bit"))
    )
    lost = "_{0}[_before] - _{0}[_after]".format
    return parts.selectExpr(
        "part", "filter_order", "_at + 1 as step", "_docs[_after] as kept",
        f"{lost('docs')} as removed", f"_docs[0] - _docs[_bit] - ({lost('docs')}) as redundant",
        f"_docs[{full} - _bit] - _docs[{full}] as unique_fails",
        f"{lost('good')} as good_lost", f"{lost('toxic')} as toxic_lost",
        f"_shapley[instr('{letters}', _letter) - 1] as shapley",
    )


AUDIT_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
f as (
  select part, coalesce(l.good, 0) as good, coalesce(l.toxic, 0) as toxic,
    (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as failed
  from d left join l on l.doc_id = d.doc_id),
c as (select part, failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, failed),
x(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p as (
  select [a.letter, b.letter, c1.letter, d1.letter, e.letter] as letters, [a.bit, b.bit, c1.bit, d1.bit, e.bit] as bits
  from x a join x b on b.bit <> a.bit join x c1 on c1.bit not in (a.bit, b.bit)
  join x d1 on d1.bit not in (a.bit, b.bit, c1.bit) join x e on e.bit not in (a.bit, b.bit, c1.bit, d1.bit)),
s as (
  select array_to_string(letters, '') as filter_order, step, bits[step] as bit,
    coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from p, (select unnest(range(1, 6)) as step)),
r as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (where failed & (before | bit) = 0), 0) as kept,
    coalesce(sum(n) filter (where failed & before = 0 and failed & bit <> 0), 0) as removed,
    coalesce(sum(n) filter (where failed & before <> 0 and failed & bit <> 0), 0) as redundant,
    coalesce(sum(n) filter (where failed = bit), 0) as unique_fails,
    coalesce(sum(good) filter (where failed & before = 0 and failed & bit <> 0), 0) as good_lost,
    coalesce(sum(toxic) filter (where failed & before = 0 and failed & bit <> 0), 0) as toxic_lost
  from c, s group by part, filter_order, step, bit, before)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley
from r
"""


@query("op11_filter_audit", AUDIT_SQL)
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return audit_orders(failed_sets(text_signals(docs), labels))

"""Operator 4: documents whose sets of five-word shingles are similar, by a grouped prefix join.

Sets that are equal form a class. All shingles are put in one order, frequent ones last,
and the first ``n - ceil(t * n) + 1`` of a set are its prefix: two sets with a similarity
of at least ``t`` share one of them (Chaudhuri et al. 2006). Classes with the same prefix
and size form a group (Bouros et al., "Spatio-textual similarity joins", 2012) that is
filtered as one: by size and by the place of the shared shingle. Pairs of groups that
remain are expanded to their members and verified on the whole sets.

What is asked for are links up to connection, so not every pair is verified:

1. In a shingle's list, ordered by size, each group is paired with the one before it and
   with the first; in a group, each member with the first. Verified links give components.
2. Lists whose groups lie in several components are still open, and so are groups whose
   members do; a whole list of three groups or less, of one class each, is not, for step 1
   paired them all. Each list is put in a random order of its own and neighbours of different
   components are verified; dense groups of near copies grow together here. Rounds go on
   while each takes away a fifth of the open pairs or more.
3. In lists still open, every pair of different components that passes the filters is
   verified, except pairs done before. A pair left out is either filtered or inside one
   component.

Pairs are also filtered by bitmaps, from step 2 on before they leave a list (Sandes et al., "Bitmap filter", 2020):
each shingle flips one of ``64 * WORDS`` bits of its set, so two sets differ in at least
as many shingles as their bitmaps differ in bits. For several sets together, bits that
are set in all of one side and in none of the other count.

A very long list is dealt in random parts for steps 1 and 2; step 3 covers what lies in
different parts.

The order of shingles is a bounded table of the most frequent ones (``FREQUENT``) with
the rest by hash; any order gives the same links, a better one gives fewer candidates.

Defined cases: a document without words or text has an empty set and no link; fewer
than ``width`` words make one shingle of all of them; rows with a null id link with
nothing; rows of one id are one node; repeated rows are one class; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import store
from . import hashing
from .registry import query, table

WIDTH = 5
#: The similarity, in hundredths.
PERCENT = 75
#: Bound of the broadcast table of frequent shingles.
FREQUENT = 500_000
#: Shingles counted together in a task before repeats are sent on.
WINDOW = 1_000_000

#: Words of 64 bits in the bitmap of a set.
WORDS = 8
#: A round of step 2 is followed by another if it leaves less than this share of the open pairs.
SHRINK = 0.8
#: Rows before it that a row is compared with in step 2.
REACH = 3
#: Rows of a list that one task sorts.
LIST_PART = 20_000
#: Groups of a list that step 1 pairs all with each other: each with the one before it and with the first.
PAIRED = 3
#: Bits of the broadcast bitmap of wanted ids (4 MB).
MARKS = 1 << 25

_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(batch, width: int = WIDTH, text: str = "text") -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = hashing.word_runs(batch, text, fold=True)
    runs = hashing.shingles(hashes, width)
    out = []
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if end - start >= width:
            out.append(np.unique(runs[start : end - width + 1]))
        elif end > start:
            out.append(hashing.shingles(hashes[start:end], end - start) + np.uint64(end - start))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def prefix_size(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


class Order:
    """Frequent shingles come last, by count; the others by hash."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray):
        self.frequent, self.counts = frequent, counts

    def _ranks(self, shingles: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.frequent, shingles)
        at[at == len(self.frequent)] = 0
        return np.where(self.frequent[at] == shingles, self.counts[at], 0)

    def list_parts(self, shingles: np.ndarray, group: int) -> np.ndarray:
        """The part of each shingle's list that a group goes to; 0 where lists are whole."""
        parts = self._ranks(shingles) // LIST_PART if len(self.frequent) else np.zeros(len(shingles), dtype=np.int64)
        return np.where(parts > 0, 1 + group % (parts + 1), 0)

    def prefix(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """The first ``size`` of some sorted shingles in this order."""
        if not len(self.frequent):
            return shingles[:size]
        taken = size
        while True:  # look no further than rare ones fill the prefix
            head = shingles[:taken]
            ranks = self._ranks(head)
            rare = head[ranks == 0]
            if len(rare) >= size or taken == len(shingles):
                break
            taken = min(len(shingles), taken + 2 * (size - len(rare)))
        often = ranks > 0
        last = head[often][np.lexsort((head[often], ranks[often]))]
        return np.concatenate((rare, last))[:size]


def frequent_shingles(docs: DataFrame, *, limit: int = FREQUENT, width: int = WIDTH) -> Order:
    """Shingles that repeat within the windows of tasks, the most frequent ``limit`` of them."""

    def count(batches):
        held, rows = [], 0

        def repeats():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often])], names=["shingle", "count"]
            )

        for batch in hashing.text_steps(batches):
            for shingles in shingle_sets(batch, width):
                held.append(shingles)
                rows += len(shingles)
            if rows > WINDOW:
                yield repeats()
                held, rows = [], 0
        if rows:
            yield repeats()

    counted = docs.select("text").mapInArrow(count, "shingle long, count long").groupBy("shingle").agg(
        F.sum("count").alias("count")
    )
    found = counted.orderBy(F.desc("count"), "shingle").limit(limit).toArrow()  # bounded by `limit`
    shingles = found.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return Order(shingles[order], found.column("count").to_numpy()[order].astype(np.int64))


def _fingerprints(shingles: np.ndarray) -> tuple[int, int]:
    """Sums of two mixes: 128 bits of a set."""
    with np.errstate(over="ignore"):
        return tuple(
            int(np.sum(hashing.mix(shingles ^ salt), dtype=np.uint64).view(np.int64))
            for salt in (np.uint64(0), _SALT)
        )


def _bitmap(shingles: np.ndarray) -> list[int]:
    """The parity of shingles at each of ``64 * WORDS`` places."""
    places = (shingles & np.uint64(64 * WORDS - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=64 * WORDS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


def _columns(rows: list[tuple], names: str, kinds: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names.split())
    types = {"l": pa.int64(), "b": pa.binary(), "w": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays(
        [pa.array(values, types[kind]) for values, kind in zip(columns, kinds, strict=True)], names=names.split()
    )


def document_classes(docs: DataFrame, order, *, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``(doc_id, t, n, a, b, g, bits)``: the size of each document's set, its class, group and bitmap."""

    def describe(batches):
        for batch in hashing.text_steps(batches):
            rows = []
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(), strict=True)
            for (doc_id, t), shingles in zip(keys, shingle_sets(batch, width), strict=True):
                group = _group(order.value, shingles, percent)
                rows.append((doc_id, t, len(shingles), *_fingerprints(shingles), group, _bitmap(shingles)))
            yield _columns(rows, "doc_id t n a b g bits", "llllllw")

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(
        describe, "doc_id long, t long, n long, a long, b long, g long, bits array<long>"
    )


def _group(order: Order, shingles: np.ndarray, percent: int) -> int:
    """Names a group: the prefix, as a set, and the size."""
    if not len(shingles):
        return 0
    prefix = order.prefix(shingles, prefix_size(len(shingles), percent))
    with np.errstate(over="ignore"):
        total = np.sum(hashing.mix(prefix ^ np.uint64(len(shingles))), dtype=np.uint64)
    return int(hashing.mix(total.reshape(1) + np.uint64(len(shingles)))[0].view(np.int64))


def prefix_lists(docs: DataFrame, order, *, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``(shingle, g, place, part)``: prefixes of groups; ``place`` is size * 2**32 + position.

    A task sends each group once, so copies do not pile up in a shingle's list.
    """

    def send(batches):
        seen: set[int] = set()
        for batch in hashing.text_steps(batches):
            shingles_, groups, places, parts = [], [], [], []
            for shingles in shingle_sets(batch, width):
                size = len(shingles)
                if not size:
                    continue
                group = _group(order.value, shingles, percent)
                if group in seen:
                    continue
                seen.add(group)
                prefix = order.value.prefix(shingles, prefix_size(size, percent))
                shingles_.append(prefix)
                groups.append(np.full(len(prefix), group, dtype=np.int64))
                places.append((size << 32) + np.arange(len(prefix), dtype=np.int64))
                parts.append(order.value.list_parts(prefix, group))
            if shingles_:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(shingles_).view(np.int64)),
                        *[pa.array(np.concatenate(x)) for x in (groups, places)],
                        pa.array(np.concatenate(parts).astype(np.int32)),
                    ],
                    names=["shingle", "g", "place", "part"],
                )

    return docs.filter(F.col("doc_id").isNotNull()).select("text").mapInArrow(send, "shingle long, g long, place long, part int")


def _maybe_among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` may be among ``ids(doc_id)``; keeps all that are.

    The ids are hashed to a bitmap of ``MARKS`` bits, which is broadcast: most other texts
    need not be shuffled. The join that follows takes out what is left of them.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    block, bit = F.shiftright(place, 15), place.bitwiseAND(F.lit((1 << 15) - 1))
    marks = ids.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_marks"))
    byte = F.substring("_marks", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))
    marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("bigint"), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return docs.join(F.broadcast(marks), block == F.col("_block")).filter(marked).select(docs.columns)


def similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, *, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The pairs ``(left, right)`` of class documents whose whole sets are similar; stored.

    Pairs that the bitmaps rule out go first; texts travel for the others only.
    """
    sides = [
        classes.select(F.col("rep").alias(side), F.struct("n", "bits").alias(f"_{side}")) for side in ("left", "right")
    ]
    differ = [
        F.bit_count(F.col("_left.bits")[i].bitwiseXOR(F.col("_right.bits")[i])) for i in range(WORDS)
    ]
    possible = (100 + percent) * sum(differ[1:], differ[0]) <= (100 - percent) * (F.col("_left.n") + F.col("_right.n"))
    likely = store(
        pairs.join(sides[0], "left").join(sides[1], "right").filter(possible).select("left", "right").distinct(),
        "likely-pairs",
    )
    drop_finished(pairs.sparkSession)
    ends = likely.select(F.col("left").alias("rep")).unionByName(likely.select(F.col("right").alias("rep"))).distinct()
    # an id may have several texts; the hash tells which one stands for the class
    wanted = store(classes.join(ends, "rep", "left_semi").select(F.col("rep").alias("doc_id"), "t"), "pair-ends")
    # a merge join by the id alone (so no plain equality of t) leaves the texts dealt as all that follows needs them
    texts = _maybe_among(docs, wanted.select("doc_id")).join(wanted.hint("merge"), "doc_id").filter(
        F.xxhash64("text").bitwiseXOR(F.col("t")) == 0
    ).dropDuplicates(["doc_id", "t"])
    joined = likely.join(
        texts.select(F.col("doc_id").alias("left"), F.col("text").alias("_l")), "left"
    ).join(texts.select(F.col("doc_id").alias("right"), F.col("text").alias("_r")), "right")

    def sets(column):
        distinct = column.dictionary_encode()
        found = shingle_sets(pa.RecordBatch.from_arrays([distinct.dictionary], names=["text"]), width)
        return [found[i] for i in distinct.indices.to_pylist()]

    def compare(batches):
        for batch in hashing.text_steps(batches, "_l"):
            keep = []
            for a, b in zip(sets(batch.column("_l")), sets(batch.column("_r")), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["left", "right"]).filter(pa.array(keep, pa.bool_()))

    links = store(
        joined.select("left", "right", "_l", "_r").mapInArrow(compare, "left long, right long"), "similar-pairs"
    )
    drop_finished(pairs.sparkSession)
    return links


def drop_finished(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of steps whose results are stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _pairs(one, other) -> list:
    return [F.least(one, other).alias("left"), F.greatest(one, other).alias("right")]


def _fits(one, other, percent: int):
    """Whether sizes and places of a shared shingle allow two sets to be similar."""
    size = [F.shiftright(place, 32) for place in (one, other)]
    rest = [n - place.bitwiseAND(F.lit(0xFFFFFFFF)) for n, place in zip(size, (one, other), strict=True)]
    return (100 * F.least(*size) >= percent * F.greatest(*size)) & (
        (100 + percent) * F.least(*rest) >= percent * (size[0] + size[1])
    )


def _bits_fit(one: str, other: str, percent: int):
    """Whether bitmaps and sizes allow two units to hold similar sets.

    ``all`` has the bits set in all bitmaps of a unit, ``any`` those set in one or more.
    """
    differ = [
        F.bit_count(
            F.col(f"{one}.all{i}").bitwiseAND(F.bitwise_not(F.col(f"{other}.any{i}"))).bitwiseOR(
                F.col(f"{other}.all{i}").bitwiseAND(F.bitwise_not(F.col(f"{one}.any{i}")))
            )
        )
        for i in range(WORDS)
    ]
    sizes = F.shiftright(F.col(f"{one}.place"), 32) + F.shiftright(F.col(f"{other}.place"), 32)
    return (100 + percent) * sum(differ[1:], differ[0]) <= (100 - percent) * sizes


_ALL = [f"all{i}" for i in range(WORDS)]
_ANY = [f"any{i}" for i in range(WORDS)]


def _untried(shared: DataFrame, plural: DataFrame) -> DataFrame:
    """``(key, g, place)`` of the lists in which step 1 has not paired all classes.

    Of three groups or less each is the first or next to the others, so a whole list of them
    is done with if none is ``plural``, that is, of several classes.
    """
    rows = shared.select(F.col("shingle").alias("key"), "g", "place", "part")
    whole = rows.filter(F.col("part") == 0).join(plural.withColumn("_plural", F.lit(True)), "g", "left").select(
        "key", "g", "place", "_plural"
    ).repartition("key").distinct()
    of_list = Window.partitionBy("key")
    untried = whole.withColumn("_groups", F.count("*").over(of_list)).withColumn(
        "_any", F.max("_plural").over(of_list)
    ).filter((F.col("_groups") > PAIRED) | F.col("_any"))
    parted = rows.filter(F.col("part") > 0).select("key", "g", "place").distinct()
    return untried.select("key", "g", "place").unionByName(parted)


def _members(grouped: DataFrame, parts: DataFrame) -> DataFrame:
    return grouped.join(parts.withColumnRenamed("node_id", "rep"), "rep").select("g", "n", "rep", "component", "bits")


def _open_lists(lists: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of the lists that lie in several components; stored.

    ``inner`` lists hold the members of one group, the others the units of a shingle: a unit
    is what one group has in one component. ``_outside`` marks rows that are not in the
    component most frequent in their list, ``_rows`` counts a list.
    """
    units = members.groupBy("g", "component").agg(
        F.min("rep").alias("unit"),
        *[F.bit_and(F.col("bits")[i]).alias(name) for i, name in enumerate(_ALL)],
        *[F.bit_or(F.col("bits")[i]).alias(name) for i, name in enumerate(_ANY)],
    )
    mixed = units.groupBy("g").count().filter(F.col("count") > 1).select("g")
    apart = members.join(mixed, "g", "left_semi").select(
        F.lit(True).alias("inner"), F.col("g").alias("key"), "g", F.shiftleft("n", 32).alias("place"), "component",
        F.col("rep").alias("unit"), *[F.col("bits")[i].alias(name) for names in (_ALL, _ANY) for i, name in enumerate(names)],
    )
    columns = ["inner", "key", "g", "place", "component", "unit", *_ALL, *_ANY]
    # which lists are open is decided on narrow rows
    narrow = lists.join(units.select("g", "component"), "g").select(F.lit(False).alias("inner"), "key", "component")
    counts = narrow.unionByName(apart.select("inner", "key", "component")).groupBy("inner", "key", "component").agg(
        F.count("*").alias("_n")
    )
    open_ = counts.groupBy("inner", "key").agg(
        F.count("*").alias("_parts"), F.sum("_n").alias("_rows"), F.max(F.struct("_n", "component")).alias("_main")
    ).filter(F.col("_parts") > 1).select("inner", "key", "_rows", F.col("_main.component").alias("_main"))
    outer = lists.join(open_.filter(~F.col("inner")), "key").join(units, "g")
    inner = apart.join(open_.filter("inner"), ["inner", "key"])
    opened = outer.unionByName(inner).withColumn("_outside", F.col("component") != F.col("_main"))
    return store(opened.select(*columns, "_rows", "_outside"), "open-lists")


def _neighbours(opened: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of different components that are neighbours in a random order of their list."""
    part = F.pmod(F.xxhash64("unit", F.lit(turn)), F.ceil(F.col("_rows") / LIST_PART))
    order = Window.partitionBy("inner", "key", "_part").orderBy(
        F.xxhash64("key", "unit", "component", F.lit(turn)), "unit", "component"
    )
    here = F.struct("unit", "component", "place", *_ALL, *_ANY)
    return opened.select("inner", "key", here.alias("_x"), "unit", "component", part.alias("_part")).select(
        "_x", F.array(*[F.lag("_x", i).over(order) for i in range(1, REACH + 1)]).alias("_before")
    ).select("_x", F.explode("_before").alias("_o")).filter(
        F.col("_o").isNotNull() & (F.col("_x.component") != F.col("_o.component"))
        & _fits(F.col("_x.place"), F.col("_o.place"), percent) & _bits_fit("_x", "_o", percent)
    ).select(*_pairs(F.col("_x.unit"), F.col("_o.unit"))).distinct()


def _open_pairs(opened: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes that are open: of different components, in one list, fit in size and place."""
    one, two = opened.filter("_outside").alias("one"), opened.alias("two")
    crossing = one.join(
        two, (F.col("one.inner") == F.col("two.inner")) & (F.col("one.key") == F.col("two.key"))
    ).filter(
        (F.col("one.component") != F.col("two.component"))
        & (~F.col("two._outside") | (F.col("one.unit") < F.col("two.unit")))
        & _fits(F.col("one.place"), F.col("two.place"), percent)
        & _bits_fit("one", "two", percent)
    ).select(
        F.col("one.inner").alias("_inner"), F.col("one.g").alias("_g1"), F.col("one.component").alias("_c1"),
        F.col("one.unit").alias("_u1"), F.col("two.g").alias("_g2"), F.col("two.component").alias("_c2"),
        F.col("two.unit").alias("_u2"),
    ).distinct()
    in_one = members.select(F.col("g").alias("_g1"), F.col("component").alias("_c1"), F.col("rep").alias("_r1"))
    in_two = members.select(F.col("g").alias("_g2"), F.col("component").alias("_c2"), F.col("rep").alias("_r2"))
    expanded = crossing.filter(~F.col("_inner")).join(in_one, ["_g1", "_c1"]).join(in_two, ["_g2", "_c2"])
    return expanded.select(*_pairs("_r1", "_r2")).unionByName(
        crossing.filter("_inner").select(*_pairs("_u1", "_u2"))
    ).distinct()


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``(node_id, component)`` after some links, which are contracted to their components first."""
    ends = [parts.select(F.col("node_id").alias(side), F.col("component").alias(name)) for side, name in (("left", "src"), ("right", "dst"))]
    edges = store(
        links.join(ends[0], "left").join(ends[1], "right").filter(F.col("src") != F.col("dst"))
        .select("src", "dst").distinct(),
        "component-links",
    )
    nodes = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    moved = connected_components(nodes, edges).select(F.col("node_id").alias("component"), F.col("component").alias("_to"))
    return store(
        parts.join(moved, "component", "left").select("node_id", F.coalesce("_to", "component").alias("component")),
        "merged-components",
    )


def jaccard_components(docs: DataFrame, *, percent: int = PERCENT, limit: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(frequent_shingles(docs, limit=limit))
    described = store(document_classes(docs, order, percent=percent), "document-classes")
    usable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    classes = store(
        described.filter(usable).groupBy("n", "a", "b", "g").agg(
            F.min("doc_id").alias("rep"), F.min_by("t", "doc_id").alias("t"), F.first("bits").alias("bits"),
        ),
        "shingle-classes",
    )
    heads = classes.groupBy("g").agg(F.min("rep").alias("head"), F.max("rep").alias("_last"))
    # 1. neighbours in the lists, and members of a group with its first
    by_size = Window.partitionBy("shingle", "part").orderBy("place", "g")
    lists = prefix_lists(docs, order, percent=percent).withColumn(
        "_before", F.lag(F.struct("g", "place")).over(by_size)
    ).withColumn("_first", F.first(F.struct("g", "place")).over(by_size)).withColumn(
        "_after", F.lead("g").over(by_size)
    )
    shared = store(
        lists.filter(
            (F.col("part") > 0) | (F.col("g") != F.col("_first.g")) | (F.col("g") != F.coalesce("_after", "g"))
        ),
        "shared-prefixes",
    )
    drop_finished(spark)

    near = shared.select("g", "place", F.explode(F.array("_before", "_first")).alias("_o")).filter(
        F.col("_o").isNotNull() & (F.col("g") != F.col("_o.g")) & _fits(F.col("place"), F.col("_o.place"), percent)
    ).select(*[c.alias(n) for c, n in zip((F.least("g", "_o.g"), F.greatest("g", "_o.g")), ("_one", "_two"), strict=True)]).distinct()
    first = heads.select(F.col("g").alias("_one"), F.col("head").alias("_h1"))
    second = heads.select(F.col("g").alias("_two"), F.col("head").alias("_h2"))
    across = near.join(first, "_one").join(second, "_two").select(*_pairs("_h1", "_h2"))
    plural = store(heads.filter(F.col("head") != F.col("_last")), "plural-groups")
    inside = classes.join(plural, "g").filter(F.col("rep") != F.col("head")).select(*_pairs("rep", "head"))
    done = store(across.unionByName(inside).distinct(), "first-pairs")
    drop_finished(spark)
    links = similar(done, classes, docs, percent=percent)
    nodes = classes.select(F.col("rep").alias("node_id")).distinct()
    parts = store(
        connected_components(nodes, links.select(F.col("left").alias("src"), F.col("right").alias("dst"))),
        "first-components",
    )
    # 2. neighbours in lists that are still open
    lists = store(_untried(shared, plural.select("g")), "lists")
    drop_finished(spark)
    several = lists.select("g").unionByName(plural.select("g")).distinct()
    grouped = store(classes.join(several, "g", "left_semi").select("g", "n", "rep", "bits"), "open-classes")
    drop_finished(spark)
    turn, before = 0, None
    while True:
        members = _members(grouped, parts)
        opened = _open_lists(lists, members)
        drop_finished(spark)
        open_rows, open_pairs = opened.agg(F.count("*"), F.sum(F.when(F.col("_outside"), F.col("_rows")))).first()
        if (open_pairs or 0) <= open_rows or (before is not None and open_pairs >= SHRINK * before):
            break
        near = _neighbours(opened, turn, percent).join(done, ["left", "right"], "left_anti")
        tried = store(near, "close-pairs")
        links = similar(tried, classes, docs, percent=percent)
        done = done.unionByName(tried)
        if links.isEmpty():
            break
        parts = _merged(parts, links)
        lists = opened.filter(~F.col("inner")).select("key", "g", "place").distinct()
        turn, before = turn + 1, open_pairs
    # 3. all that is still open
    todo = store(_open_pairs(opened, members, percent).join(done, ["left", "right"], "left_anti"), "open-pairs")
    more = similar(todo, classes, docs, percent=percent)
    final = parts if more.isEmpty() else _merged(parts, more)
    known = classes.join(final.withColumnRenamed("node_id", "rep"), "rep").select("n", "a", "b", "component")
    return described.join(known, ["n", "a", "b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(usable, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


@query("op4_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))

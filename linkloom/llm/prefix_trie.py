"""Operator 13: the trie of shared conversation prefixes, by fixed-length block hashing.

A turn is a 128-bit digest of its role and text. ``BLOCK`` successive turns of a
conversation make a block, hashed as one. The digest of a prefix that ends with a block is
the exclusive-or of the hashes of its numbered blocks, so prefixes come from running
totals in two levels, and a very long conversation is not one task. Conversations are
grouped by the prefix before a block and the block: that is the trie in steps of a block.

Where all conversations that go on from a prefix share the next block, its inner turns
have the same members as the block, and its nodes follow at once. Only where siblings
diverge are the distinct blocks (not the conversations) hashed turn by turn and grouped.

A node's smallest member owns it; the nodes that a conversation owns are the end of its
path. A sum over a subtree is therefore, over the members of the node, the sum of what
each owns, less what the node's owner owns above it: two passes of grouped sums, with no
walk over levels. The ids that end at a node are hashed in order from sorted runs, so a
node where very many end is never held as a whole.

Defined cases: rows with a null conversation id belong to none; a null role or text is an
empty one; rows of equal turn are ordered by their digests, so by their contents alone;
repeated rows are turns each; an empty table gives no rows, not even a root; columns
other than those named are not read. Lengths are code points of a whole text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import store
from .registry import query, table

#: Turns of a block, and blocks of a conversation that one running total goes over.
BLOCK = 4
RUN = 1024
#: Ids that one piece of a sorted run may hold.
PIECE_IDS = 65_536

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def _words(digest: Column) -> list[Column]:
    """Two 64-bit numbers from the first 128 bits of a digest in hex."""
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0).cast("long"))


def numbered_turns(
    conversations: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)`` with a row per turn and a row per conversation and sorted range.

    Digests are sorted by range of conversation and turn, so a long conversation goes to
    several tasks; the position of a turn is its place in the range after those of the
    ranges before. ``rows``: ``(conv, part, seq, digest, points)``; ``spans``: ``(conv,
    part, first, turns, before)``.
    """
    said = F.concat_ws("", F.length(F.col("role")).cast("string"), F.lit(":"), "role", "text")
    turns = (
        conversations.filter(F.col(f"`{id}`").isNotNull())
        .select(
            F.col(f"`{id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        )
        .select(
            "conv", "turn", F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("digest"),
            F.length("text").cast("long").alias("points"), F.monotonically_increasing_id().alias("_row"),
        )
    )
    order = ["conv", F.asc_nulls_first("turn"), "digest"]
    ordered = (
        turns.repartitionByRange(*order, "_row").sortWithinPartitions(*order)
        .select("conv", "digest", "points", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"))
    )
    rows = store(ordered, "turns")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("conv", "part").agg(F.min("seq").alias("first"), F.count("*").alias("turns"))
    return rows, spans.withColumn("before", _zero(F.sum("turns").over(earlier)))


def rebuilt_turns(rows: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(turns, lengths)`` of the rebuilt conversations.

    The head of ``c`` is the first ``h = crc32(c) % 6`` turns of ``c - c % 100``; its own
    turns after its first ``h`` follow. ``turns``: ``(conv, length, at, digest, points)``.
    """
    position = F.col("before") + F.col("seq") - F.col("first")
    heads = (
        rows.filter(F.col("conv") % 100 == 0)
        .join(spans.filter("before < 5").select("conv", "part", "first", "before"), ["conv", "part"])
        .withColumn("at", position).filter("at < 5")
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("at", "digest", "points"))).alias("head"))
    )
    convs = (
        spans.groupBy("conv").agg(F.sum("turns").alias("turns"))
        .select("conv", "turns", (F.col("conv") - F.col("conv") % 100).alias("base"),
                (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).alias("cut"))
        .join(heads, "base", "left")
        .withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("cut").cast("int"))))
        .withColumn("given", F.when(F.col("head").isNotNull(), F.size("head")).otherwise(0).cast("long"))
        .withColumn("length", F.col("given") + F.greatest(F.col("turns") - F.col("cut"), F.lit(0)))
        .select("conv", "cut", "given", "length", "head")
    )
    convs = store(convs, "conversations")
    places = spans.join(convs.drop("head"), "conv")
    own = (
        rows.join(places, ["conv", "part"]).withColumn("at", position).filter("at >= cut")
        .select("conv", "length", (F.col("at") - F.col("cut") + F.col("given")).alias("at"), "digest", "points")
    )
    given = convs.select("conv", "length", F.inline("head"))
    return own.unionByName(given), convs.select("conv", "length")


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """``(conv, length, block, digests, points, q1, q2, p1, p2)``: blocks with the prefixes before and after."""
    blocks = (
        turns.groupBy("conv", F.floor(F.col("at") / BLOCK).alias("block"))
        .agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("at", "digest", "points"))).alias("_turns"))
        .select("conv", "length", "block", F.col("_turns.digest").alias("digests"), F.col("_turns.points").alias("points"))
        .withColumn("run", F.floor(F.col("block") / RUN))
        .withColumns(dict(zip(("x1", "x2"), _words(_block_hash(F.col("block"), F.col("digests"))), strict=True)))
    )
    blocks = store(blocks, "blocks")
    totals = blocks.groupBy("conv", "run").agg(*[F.bit_xor(f"x{i}").alias(f"t{i}") for i in (1, 2)])
    runs = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("conv", "run", *[_zero(F.bit_xor(f"t{i}").over(runs)).alias(f"e{i}") for i in (1, 2)])
    inside = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = {f"q{i}": F.col(f"e{i}").bitwiseXOR(_zero(F.bit_xor(f"x{i}").over(inside))) for i in (1, 2)}
    after = {f"p{i}": F.col(f"q{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}
    return blocks.join(earlier, ["conv", "run"]).withColumns(before).withColumns(after).drop("run", "e1", "e2")


def _block_hash(block: Column, digests: Column) -> Column:
    """SHA-256 in hex of a numbered run of turn digests."""
    return F.sha2(F.concat(F.encode(F.concat(block.cast("string"), F.lit(":")), "utf-8"), F.array_join(F.transform(digests, F.hex), "").cast("binary")), 256)


PREFIX, AFTER, NODE, PARENT = ["block", "q1", "q2"], ["block", "q1", "q2", "p1", "p2"], ["depth", "k1", "k2"], ["up", "u1", "u2"]


def block_trie(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(alone, diverging)``: distinct blocks after a prefix, without and with siblings."""
    distinct = store(
        blocks.groupBy(*AFTER).agg(
            F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("digests").alias("digests"), F.first("points").alias("points")
        ),
        "block-trie",
    )
    alone = distinct.groupBy(*PREFIX).agg(
        F.count("*").alias("_count"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    ).filter("_count = 1").select(*AFTER)
    # keyed by the block too, so that a prefix with very many next blocks is spread
    return distinct.join(alone, AFTER, "left_semi"), distinct.join(alone, AFTER, "left_anti")


def _inner_nodes(blocks: DataFrame, values: list[str], refine: bool) -> DataFrame:
    """A row per inner turn of a block: its node's key and its parent's, and ``values``.

    A block alone names its inner nodes by its own end; diverging blocks by the digest of
    the turns so far, so that siblings agree on the nodes they share.
    """
    base = F.col("block") * BLOCK
    rows = blocks.select("*", F.posexplode("points").alias("_i", "length"))
    first = F.col("_i") == 0
    if refine:
        def key(count: Column) -> list[Column]:
            hashed = _words(_block_hash(F.col("block"), F.slice("digests", F.lit(1), count)))
            return [F.col(q).bitwiseXOR(x) for q, x in zip(("q1", "q2"), hashed, strict=True)]

        at, above = key(F.col("_i") + 1), key(F.col("_i"))
    else:
        at = above = [F.col("p1"), F.col("p2")]
    up = [F.when(first, F.col(q)).otherwise(a) for q, a in zip(("q1", "q2"), above, strict=True)]
    return rows.select(
        (base + F.col("_i") + 1).alias("depth"), at[0].alias("k1"), at[1].alias("k2"),
        (base + F.col("_i")).alias("up"), up[0].alias("u1"), up[1].alias("u2"),
        "length", (F.col("_i") + 1 == F.size("points")).alias("last"), *values,
    )


def trie_nodes(alone: DataFrame, diverging: DataFrame) -> DataFrame:
    """``(depth, k1, k2, up, u1, u2, conv, n, length)`` of all nodes below the root."""
    columns = [*NODE, *PARENT, "conv", "n", "length"]
    straight = _inner_nodes(alone, ["conv", "n"], refine=False).select(*columns)
    refined = _inner_nodes(diverging, ["conv", "n"], refine=True).groupBy(*NODE).agg(
        *[F.first(c).alias(c) for c in (*PARENT, "length")], F.min("conv").alias("conv"), F.sum("n").alias("n")
    )
    return straight.unionByName(refined.select(*columns))


def _members_sums(blocks: DataFrame, alone: DataFrame, diverging: DataFrame, values: DataFrame) -> DataFrame:
    """By node: ``owned`` and ``leaf`` of ``values`` (by conversation), summed over its members."""
    sums = store(
        blocks.select("conv", *AFTER).join(values, "conv").groupBy(*AFTER).agg(
            F.sum("owned").alias("owned"), F.sum("leaf").alias("leaf")
        ),
        "block-sums",
    )

    def with_sums(part: DataFrame) -> DataFrame:
        return part.drop("n", "conv").join(sums, AFTER)

    totals = [F.sum(c).alias(c) for c in ("owned", "leaf")]
    straight = _inner_nodes(with_sums(alone), ["owned", "leaf"], refine=False).select(*NODE, "owned", "leaf")
    refined = _inner_nodes(with_sums(diverging), ["owned", "leaf"], refine=True).groupBy(*NODE).agg(*totals)
    return straight.unionByName(refined)


def _batch(rows: list[tuple], numbers: list[str], text: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * (len(numbers) + 1)
    kinds = [*[pa.int64()] * len(numbers), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names=[*numbers, text]
    )


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``(depth, k1, k2, ends_sha256)`` from ``(depth, k1, k2, conv)``: SHA-256 of the sorted ids, comma-joined.

    Ids are sorted by range of node and id and joined to pieces where they lie; a node's
    pieces are then hashed one after the other.
    """
    kinds = "depth long, k1 long, k2 long"

    def pieces(batches):
        at, held = None, []

        def piece():
            return (*at, held[0], ",".join(map(str, held)))

        for batch in batches:
            out = []
            for *node, conv in zip(*[batch.column(c).to_pylist() for c in (*NODE, "conv")], strict=True):
                if held and (node != at or len(held) == PIECE_IDS):
                    out.append(piece())
                    held = []
                at = node
                held.append(conv)
            yield _batch(out, [*NODE, "first"], "ids")
        if held:
            yield _batch([piece()], [*NODE, "first"], "ids")

    def digests(batches):
        at, state = None, None
        for batch in batches:
            out = []
            for *node, ids in zip(*[batch.column(c).to_pylist() for c in (*NODE, "ids")], strict=True):
                if node != at:
                    if state is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _batch(out, NODE, "ends_sha256")
        if state is not None:
            yield _batch([(*at, state.hexdigest())], NODE, "ends_sha256")

    runs = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    joined = runs.mapInArrow(pieces, f"{kinds}, first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, f"{kinds}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, **columns) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    turns, lengths = rebuilt_turns(*numbered_turns(conversations, **columns))
    blocks = store(conversation_blocks(turns), "prefixes")
    alone, diverging = block_trie(blocks)
    root = lengths.agg(
        F.count("*").alias("n"), F.min("conv").alias("conv")
    ).filter("n > 0").select(
        *[F.lit(0).cast("long").alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in PARENT],
        "conv", "n", F.lit(0).cast("long").alias("length"),
    )
    below = trie_nodes(alone, diverging)
    children = below.groupBy(*[F.col(c).alias(to) for c, to in zip(PARENT, NODE, strict=True)]).agg(F.count("*").alias("n_children"))
    nodes = store(below.unionByName(root).join(children, NODE, "left").withColumn("n_children", _zero(F.col("n_children"))), "nodes")

    saved = (F.col("n") - 1) * F.col("length")
    values = store(
        nodes.groupBy("conv").agg(
            F.sum(saved).alias("owned"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf")
        ),
        "owned",
    )
    shared = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    # a node of one member saves nothing, nor does what is below it
    above = nodes.filter("n > 1").select(*NODE, _zero(F.sum(saved).over(shared)).alias("above"))
    sums = _members_sums(blocks, alone, diverging, values).unionByName(
        values.agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaf"))
        .select(*[F.lit(0).cast("long").alias(c) for c in NODE], "owned", "leaf")
    )
    ends = blocks.filter(F.col("length") == F.col("block") * BLOCK + F.size("points")).select(
        F.col("length").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv"
    ).unionByName(lengths.filter("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv"))
    parents = nodes.select(*[F.col(c).alias(to) for c, to in zip(NODE, PARENT, strict=True)], F.col("conv").alias("parent_conv_id"))
    return (
        nodes.join(sums, NODE).join(above, NODE, "left").join(hashed_ends(ends), NODE, "left").join(parents, PARENT, "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
            F.col("leaf").alias("n_leaves"),
            F.when(F.col("n") > 1, F.col("owned") - _zero(F.col("above"))).otherwise(0).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )


TRIE_SQL = """
with t as (
  select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
d as (select *, substring(sha256(length(role) || ':' || role || text), 1, 32) as digest from t),
m as (select c, digest, length(text) as points, row_number() over (partition by c order by turn nulls first, digest) - 1 as place from d),
k as (
  select c, c - c % 100 as base, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda v, i: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end))) % 6 as h
  from (select distinct c from m)),
z as (select c, count(*) as turns from m group by c),
r as (
  select k.c, m.place, digest, points from k join m on m.c = k.base and m.place < k.h
  union all
  select k.c, m.place - k.h + least(k.h, coalesce(z.turns, 0)), digest, points
  from k join m on m.c = k.c and m.place >= k.h left join z on z.c = k.base),
p as (
  select c, place + 1 as depth, points, array_to_string(list(digest) over (partition by c order by place), ',') as key,
    place + 1 = count(*) over (partition by c) as ends from r),
e as (
  select c, depth, points, key, coalesce(lag(key) over (partition by c order by depth), '') as up, ends from p
  union all
  select c, 0, 0, '', null, c not in (select c from r) from k),
n as (
  select key, depth, any_value(up) as up, min(c) as conv, count(*) as n, any_value(points) as points,
    sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where ends), '')) as ends_sha256
  from e group by key, depth),
b as (select up as key, count(*) as children from n where up is not null group by up),
w as (select n.*, coalesce(children, 0) as children from n left join b on b.key = n.key),
s as (select distinct a.key as top, o.key from e a join e o on o.c = a.c and o.depth >= a.depth),
u as (
  select s.top, count(*) filter (where children = 0) as leaves, sum((n - 1) * points) as saved
  from s join w on w.key = s.key group by s.top)
select w.conv as conv_id, w.depth::bigint as depth, o.conv as parent_conv_id, w.n as n_convs, w.children as n_children,
  u.leaves as n_leaves, u.saved::bigint as saved_tokens, w.ends_sha256
from w join u on u.top = w.key left join n o on o.key = w.up
"""


@query("op13_prefix_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))

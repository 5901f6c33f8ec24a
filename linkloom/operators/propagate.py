"""One hop of message passing: a join on the sender and a sum per receiver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_array, let
from .joins import HotKeys, lookup_join

#: Vector entries summed side by side in one aggregate row. Up to this width a sum
#: needs one shuffle; wider vectors travel as blocks and are put together after.
BLOCK = 32


def blocks_of(vec: Column) -> Column:
    """A vector as an array of blocks; the last one may be shorter."""

    def cut(v: Column) -> Column:
        count = F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK))
        )

    return let(vec, cut)


def _entry_sums(vec: Column, n: int, weight: str | None) -> list[Column]:
    factor = F.col(weight) if weight else F.lit(1.0)
    return [F.sum(F.get(vec, F.lit(i)) * factor) for i in range(n)]


def neighbour_sum(
    rows: DataFrame,
    *,
    by: str,
    vec: str = "vec",
    width: int | None = None,
    weight: str | None = None,
    carry: dict[str, Column] | None = None,
    in_blocks: bool = False,
    most: int = BLOCK,
) -> DataFrame:
    """Sum the vectors of each group, times ``weight`` if given.

    Plain column sums in a hash aggregate: partial before the shuffle, so a hub
    receives one row per task, in compiled code, and able to spill. ``width`` is
    the vector length where it is known; up to ``most`` entries are summed side by
    side. ``carry`` adds further aggregates.
    """
    carried = [value.alias(name) for name, value in (carry or {}).items()]
    if width is not None and width <= most:
        summed = F.array(*_entry_sums(as_array(rows, vec), width, weight))
        return rows.groupBy(by).agg(summed.alias(vec), *carried)
    parts = F.col(vec) if in_blocks else blocks_of(as_array(rows, vec))
    others = [c for c in rows.columns if c != vec]
    spread = rows.select(*others, F.posexplode(parts).alias("_block", "_part"))
    summed = F.array(*_entry_sums(F.col("_part"), BLOCK, weight))
    per_block = spread.groupBy(by, "_block").agg(
        F.array_compact(summed).alias("_sum"), *carried
    )
    # a group has width / BLOCK rows here
    ordered = F.sort_array(F.collect_list(F.struct("_block", "_sum")))
    names = [F.max(name).alias(name) for name in (carry or {})]
    return (
        per_block.groupBy(by)
        .agg(ordered.alias("_sums"), *names)
        .select(by, F.flatten("_sums._sum").alias(vec), *(carry or {}))
    )


def hop(
    hops: DataFrame,
    senders: DataFrame,
    *,
    hot: HotKeys,
    vec: str = "vec",
    own_vec: str | None = None,
    width: int | None = None,
    weight: str | None = None,
    keep: tuple[str, ...] = (),
    most: int = BLOCK,
) -> DataFrame:
    """Sum ``vec`` of all senders per receiver, times the sender's ``weight`` if given.

    Where hop rows have a ``weight`` of their own, it is multiplied too.
    ``own_vec`` is what a node sends to itself, if different. ``keep`` names
    scalar columns of the receiver that are carried through its own row. Wide
    vectors, of over ``most`` entries, are cut into blocks per sender, before they are
    repeated per edge.
    """
    in_blocks = width is None or width > most
    sending = {name: as_array(senders, name) for name in (vec, own_vec) if name}
    if in_blocks:
        sending = {name: blocks_of(column) for name, column in sending.items()}
    scalars = sorted({*keep, *([weight] if weight else [])})
    factor = weight
    if "weight" in hops.columns:
        factor = "_factor"
        hops = hops.withColumnRenamed("weight", factor)
    prepared = senders.select(
        F.col("node_id").alias("_sender"), *[c.alias(n) for n, c in sending.items()], *scalars
    )
    sent = lookup_join(hops, prepared, "src", "_sender", hot=hot)
    message = F.col(vec)
    if own_vec:
        message = F.when(F.col("own"), F.col(own_vec)).otherwise(message)
    scalars = [F.col(name) for name in scalars]
    if factor == "_factor":
        scalars.append((F.col(factor) * (F.col(weight) if weight else F.lit(1.0))).alias(factor))
    rows = sent.select(F.col("dst").alias("node_id"), "own", message.alias("vec"), *scalars)
    carry = {name: F.max(F.when(F.col("own"), F.col(name))) for name in keep}
    return neighbour_sum(
        rows, by="node_id", width=width, weight=factor, carry=carry, in_blocks=in_blocks, most=most
    )

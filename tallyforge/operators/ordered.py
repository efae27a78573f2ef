"""Ordered computations per key that stay distributed however rows are spread over keys.

A plain window over a key sends all rows of the key to one task. Here rows are
dealt by ranges of key and order into blocks of like size, whatever the keys;
each block is handled by itself, and one row per key and block carries what lies
before or behind it. The dealt rows are written once, because two passes have to
see the same blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyforge.session import settled

#: Rows of a chunk in which trailing frames are computed.
CHUNK_ROWS = 1_000_000

#: Buckets of keys that are counted before keys are.
KEY_BUCKETS = 1 << 16


def _in_blocks(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds ``_value`` and ``_block``, which grows along ``order`` within a key; rows of one block fit a task."""
    ranged = df.withColumn("_value", value).repartitionByRange(*keys, *order)
    return settled(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def _carried(blocked: DataFrame, per_block: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their key's block was given; null keys are keys like any other."""
    names = [*keys, "_block"]
    renamed = per_block.withColumnsRenamed({n: f"_of_{n}" for n in names})
    same = reduce(lambda a, b: a & b, [blocked[n].eqNullSafe(renamed[f"_of_{n}"]) for n in names])
    return blocked.join(renamed, same, "left").drop(*[f"_of_{n}" for n in names])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` from the key's first row up to this one."""
    blocked = _in_blocks(df, keys, order, value)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_block", F.sum("_total").over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _carried(blocked.withColumn("_inside", F.sum("_value").over(inside)), before, keys)
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)))
        .drop("_block", "_value", "_before", "_inside")
    )


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Adds the row number, from one, along the key."""
    numbered = running_sum(df, keys, order, F.lit(1), out)
    return numbered.withColumn(out, F.col(out).cast("long"))


def trailing_mean(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    rows: int,
    out: str,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds the mean of ``value`` over the ``rows`` rows before this one.

    Rows are numbered along the key and cut into chunks of ``chunk_rows``; the last
    ``rows`` of a chunk are also sent to the next one, which is all it lacks.
    """
    if chunk_rows < rows:
        raise ValueError("a chunk must hold at least the trailing rows")
    numbered = row_numbers(df.withColumn("_trailed", value), keys, order, "_row")
    chunk = F.floor((F.col("_row") - 1) / chunk_rows)
    closing = (F.col("_row") - 1) % chunk_rows >= chunk_rows - rows
    homes = F.when(closing, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    lent = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_row").rowsBetween(-rows, -1)
    return (
        lent.withColumn(out, F.avg("_trailed").over(frame))
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_trailed", "_row", "_home", "_chunk")
    )


def next_matching(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the smallest non-null ``value`` among the key's later rows.

    Meant for a value that grows along ``order``, such as the time of the next success.
    """
    blocked = _in_blocks(df, keys, order, value)
    firsts = blocked.groupBy(*keys, "_block").agg(F.min("_value").alias("_first"))
    # Descending order turns "following" into a running frame, which costs one step per row.
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select(*keys, "_block", F.min("_first").over(later).alias("_after"))
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*[F.col(c).desc() for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _carried(blocked.withColumn("_inside", F.min("_value").over(inside)), after, keys)
        .withColumn(out, F.coalesce("_inside", "_after"))
        .drop("_block", "_value", "_after", "_inside")
    )


def framed(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int,
    after: int,
    outs: dict[str, Callable[[WindowSpec], Column]],
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Adds columns over a window along the key that look at most ``before`` rows back and ``after`` rows ahead.

    ``outs`` makes each column from the window, as in ``lambda w: F.lag("x").over(w)``.
    Chunks of numbered rows borrow the few rows they lack from both neighbours.
    """
    if chunk_rows < max(before, after):
        raise ValueError("a chunk must hold at least the rows that are looked at")
    numbered = row_numbers(df, keys, order, "_row")
    chunk, place = F.floor((F.col("_row") - 1) / chunk_rows), (F.col("_row") - 1) % chunk_rows
    homes = F.filter(
        F.array(
            chunk,
            F.when(place >= chunk_rows - before, chunk + 1) if before else F.lit(None),
            F.when((place < after) & (chunk > 0), chunk - 1) if after else F.lit(None),
        ),
        lambda c: c.isNotNull(),
    )
    lent = numbered.withColumn("_home", chunk).withColumn("_chunk", F.explode(homes))
    window = Window.partitionBy(*keys, "_chunk").orderBy("_row")
    return (
        lent.withColumns({name: out(window) for name, out in outs.items()})
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_row", "_home", "_chunk")
    )


def crowded(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The keys, not null, with more than ``rows`` rows.

    Buckets of keys are counted first, so where no bucket is that full nothing
    moves for each key.
    """
    bucketed = df.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).alias("_bucket"))
    full = bucketed.groupBy("_bucket").count().where(F.col("count") > rows).select("_bucket")
    return bucketed.join(F.broadcast(full), "_bucket", "left_semi").groupBy(key).count().where(F.col("count") > rows).select(key)


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    start: Column,
    end: Column,
    gap: Column | int | float,
    measures: dict[str, tuple[Callable[[Column | str], Column], Column]],
    member: Column | None = None,
) -> DataFrame:
    """One row per island of a key: its keys, ``start``, ``end``, ``rows`` and ``measures``.

    A row joins the island before it unless it starts more than ``gap`` after
    all that lies before has ended. ``member`` tells which rows belong to
    islands at all; neighbouring members always stay together, so only other
    rows between them make a gap count. A measure is an aggregate that can be
    applied to its own results (sum, min, max) and its column. ``order`` has to
    follow ``start``.

    Blocks are cut into pieces by themselves, given how far the key's earlier
    blocks reach; then the piece that a block begins with joins the island
    before it. No task sees more of a key than a block and one row per block.
    """
    runs = member is not None
    columns = {f"_m_{name}": column for name, (_, column) in measures.items()}
    rows = df.select(*keys, *order, start.alias("_start"), end.alias("_end"), *[c.alias(n) for n, c in columns.items()],
                     F.coalesce(member, F.lit(False)).alias("_member") if runs else F.lit(True).alias("_member"))
    blocked = _in_blocks(rows, keys, order, F.lit(None))
    reach = F.when(F.col("_member"), F.col("_end"))
    last_place = F.max_by("_member", F.struct(*order))
    ends = blocked.groupBy(*keys, "_block").agg(F.max(reach).alias("_reach"), last_place.alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_block")
    carried = ends.select(
        *keys,
        "_block",
        F.max("_reach").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_reach"),
        F.lag("_last").over(along).alias("_last"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max(reach).over(earlier), "_reach")
    sticks = F.coalesce(F.lag("_member").over(inside), F.col("_last"), F.lit(False)) if runs else F.lit(False)
    apart = F.coalesce(F.col("_start") - seen > gap, F.lit(True))
    flagged = _carried(blocked, carried, keys).withColumn("_opens", F.col("_member") & ~sticks & apart)
    placed = flagged.withColumn("_piece", F.sum(F.col("_opens").cast("long")).over(inside)).filter("_member")
    merged = [f(n).alias(n) for n, (f, _) in zip(columns, measures.values())]
    bounds = [F.min("_start").alias("_start"), F.max("_end").alias("_end")]
    pieces = placed.groupBy(*keys, "_block", "_piece").agg(*bounds, F.count(F.lit(1)).alias("_rows"), *merged)
    pieces = settled(pieces, "pieces")
    opened = pieces.groupBy(*keys, "_block").agg(F.max("_piece").alias("_opened"))
    before = opened.select(
        *keys, "_block", F.coalesce(F.sum("_opened").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    )
    numbered = _carried(pieces, before, keys).withColumn("_island", F.col("_before") + F.col("_piece"))
    whole = numbered.groupBy(*keys, "_island").agg(*bounds, F.sum("_rows").alias("rows"), *merged)
    return whole.select(
        *keys, F.col("_start").alias("start"), F.col("_end").alias("end"), "rows", *[F.col(n).alias(n.removeprefix("_m_")) for n in columns]
    )

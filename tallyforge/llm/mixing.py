"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import own_name, settle, word_count
from tallyforge.operators.ordered import row_numbers

#: A document is taken this often at most.
MAX_COPIES = 3
#: Units in a leaf of the reduction tree, and residuals in an inner node.
LEAF_UNITS = 4_000
FAN_IN = 256
#: Equal rows that are listed at once.
BLOCK_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` from the rows ``source``, ``source_size``.

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes by weight. A target stops at ``max_copies`` times the
    source's size, and the others share the excess by weight until none is
    above. With sources ordered by cap per weight, the capped ones are a
    prefix, and the first source that its level does not exceed has the highest
    such level. The table has one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), turn + 1))
    cap = F.col("source_size").cast("double") * max_copies
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    levelled = weighed.withColumn("cap", cap).withColumn("level", level)
    found = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(Window.partitionBy())
    return levelled.select(
        "source", "source_size", F.coalesce(F.least("cap", found * F.col("weight")), "cap").alias("target")
    )


def _draw(*parts) -> float:
    """A number in [0, 1) fixed by ``parts``."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little") / 2.0**64


def pivot(mass: np.ndarray, share: np.ndarray, seed: tuple) -> np.ndarray:
    """Shares in [0, 1] after pivotal rounding in the given order; at most one stays between 0 and 1.

    Two open units trade words until one is wholly in or out: what ``mass *
    share`` one gains the other loses, and the direction is drawn so that each
    unit's expected share stays as it was.
    """
    random = np.random.Generator(np.random.PCG64(int(_draw(*seed) * 2**63))).random(len(mass))
    result, held = share.copy(), -1
    for i in range(len(mass)):
        if not 0.0 < result[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = mass[held], mass[i]
        p, q = result[held], result[i]
        up = min((1 - p) * a, q * b)  # words that may flow from i to held
        down = min(p * a, (1 - q) * b)  # and back
        flow = up if random[i] * (up + down) < down else -down
        p, q = p + flow / a, q - flow / b
        # The side that hit its bound is set exactly.
        if flow > 0:
            p, q = (1.0, q) if (1 - result[held]) * a <= result[i] * b else (p, 0.0)
        else:
            p, q = (0.0, q) if result[held] * a <= (1 - result[i]) * b else (p, 1.0)
        result[held], result[i] = min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
        if not 0.0 < result[held] < 1.0:
            held = i if 0.0 < result[i] < 1.0 else -1
    return result


def _round_group(last: bool):
    def round_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["mass", "mark", "id"], ascending=[False, True, True], kind="stable")
        seed = (str(rows["source"].iloc[0]), int(rows["node"].iloc[0]), len(rows))
        share = pivot(rows["mass"].to_numpy(float), rows["share"].to_numpy(float), seed)
        if last:
            share = np.where(share == np.floor(share), share, float(_draw("last", *seed) < share.max(where=share % 1 > 0, initial=0)))
        rows["share"] = share
        return rows

    return round_group


def mix_units(units: DataFrame, weights=(1, 2, 3), max_copies: int = MAX_COPIES) -> DataFrame:
    """``units`` with ``source_size``, ``target``, ``whole`` and ``more``: how often the mix takes each row of a unit,
    and how many of its rows once more.

    ``units``: ``id``, ``source``, ``mark`` (long that tells units apart), ``size``
    (words of one copy), ``rows`` (equal rows). The whole part of target by
    source size is taken for certain, and so is the whole number of further
    rows that the fraction gives for a unit of many rows. What is left, less than a row, is rounded in
    leaves dealt by ``mark``; each leaf leaves one open unit per source at
    most, and those meet in a tree of nodes of ``FAN_IN`` leaves until one per
    source remains, which is drawn. Words are kept exactly up to that last
    unit. The tree has log(leaves) levels, and each row is written once at the
    level that decides it.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sizes, weights, max_copies)
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    kind = units.schema["id"].dataType
    # As text, ids pass through pandas unharmed when some are null.
    units = units.withColumn("id", F.col("id").cast("string"))
    joined = units.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    leaves = max(1, -(-units.count() // LEAF_UNITS))
    rows = (
        joined.withColumn("whole", F.when(F.col("size") > 0, F.least(F.floor(wanted), F.lit(max_copies))).otherwise(0).cast("int"))
        .withColumn("all", F.when(F.col("size") > 0, F.col("rows") * (wanted - F.col("whole"))).otherwise(0.0))
        .withColumn("sure", F.when(F.col("rows") > 1, F.floor("all")).otherwise(0))
        .withColumn("share", F.col("all") - F.col("sure"))
        .withColumn("mass", F.col("size").cast("double"))
        .drop("all")
        .withColumn("node", F.pmod(F.xxhash64("mark"), F.lit(leaves)))
    )
    decided = []
    while True:
        last = leaves == 1
        rows = settle(rows.groupBy("source", "node").applyInPandas(_round_group(last), rows.schema), "mix")
        whole = F.col("share").isin(0.0, 1.0)
        decided.append(rows if last else rows.where(whole))
        if last:
            break
        leaves = -(-leaves // FAN_IN)
        rows = rows.where(~whole).withColumn("node", F.col("node") % leaves)
    result = decided[0]
    for more in decided[1:]:
        result = result.union(more)
    more = (F.col("sure") + F.round("share")).cast("long")
    return result.withColumns({"more": more, "id": F.col("id").cast(kind)}).drop("sure", "share", "mass", "node")


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows of equal id, source and text are one unit; null texts count as empty."""
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.xxhash64(text_col).alias("key"),
        word_count(F.col(text_col)).alias("size"),
    )
    units = slim.groupBy("id", "source", "key", "size").agg(F.count("*").alias("rows"))
    return settle(units.withColumn("mark", F.xxhash64("id", "source", "key")), "mix-units")


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3)
) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target`` of its source, ``copies``, ``taken`` words.

    Of rows of equal id, source and text as many are taken as their share
    gives. A null source is a
    source of its own, last in order. Wordless and null texts have size 0 and
    take nothing; a source without words has target 0. An empty table gives no
    rows. The result depends on the rows alone, not on how they are split.
    """
    mixed = mix_units(_units(docs, id_col, text_col, source_col), weights)
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / BLOCK_ROWS)))
    ends = F.col("block") * BLOCK_ROWS + 1, F.least("rows", (F.col("block") + 1) * BLOCK_ROWS)
    each = mixed.withColumn("block", blocks).withColumn("row", F.explode(F.sequence(*ends)))
    copies = F.col("whole") + (F.col("row") <= F.col("more")).cast("int")
    return each.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3)
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns as they came.

    Wordless documents belong to no share and are left out. Of equal rows as
    many are taken as their share gives. Texts move once, to meet the plan.
    """
    taken = mix_units(_units(docs, id_col, text_col, source_col), weights).where("whole + more > 0")
    wishes = ("mix_key", "mix_id", "mix_source", "mix_mark", "mix_whole", "mix_more", "mix_rows", "mix_order", "mix_row")
    names = {n: own_name(docs.columns, n) for n in wishes}
    planned = {"id": "mix_id", "source": "mix_source", "key": "mix_mark", "whole": "mix_whole", "more": "mix_more", "rows": "mix_rows"}
    plan = settle(taken.select(*[F.col(c).alias(names[n]) for c, n in planned.items()]), "mix-plan")
    keyed = docs.withColumn(names["mix_key"], F.xxhash64(text_col))
    met = keyed.join(
        plan,
        keyed[id_col].eqNullSafe(plan[names["mix_id"]])
        & keyed[source_col].eqNullSafe(plan[names["mix_source"]])
        & (keyed[names["mix_key"]] == plan[names["mix_mark"]]),
    )
    whole, more, rows = (F.col(names[n]) for n in ("mix_whole", "mix_more", "mix_rows"))
    some = (more > 0) & (more < rows)

    def taken_rows(part: DataFrame, copies) -> DataFrame:
        return part.withColumn(names["mix_whole"], F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)

    result = taken_rows(met.where(~some), whole + (more > 0).cast("int"))
    if plan.where(some).isEmpty():
        return result
    # Of some equal rows a part is taken once more: they are numbered, spread over as many blocks as they need.
    ordered = met.where(some).withColumn(names["mix_order"], F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    same = [names["mix_id"], names["mix_source"], names["mix_mark"]]
    numbered = row_numbers(ordered, same, [names["mix_order"]], names["mix_row"])
    return result.union(taken_rows(numbered, whole + (F.col(names["mix_row"]) <= more).cast("int")))

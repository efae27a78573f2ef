"""Exact quantiles per group without gathering a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordered import row_numbers
from tallyforge.session import settled

#: Steps of a mergeable summary, and its accuracy in ranks: one part in so many.
STEPS = 256
ACCURACY = 8 * STEPS
#: Rows of a bracket that are ranked in one task.
BRACKET_ROWS = 200_000
#: Brackets that are broadcast after a count; with more groups rows are ranked by ranges instead.
BROADCAST_BRACKETS = 100_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_of_{k}"]) for k in keys], F.lit(True))


def _marked(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probabilities: dict[str, float],
    bracket_rows: int = BRACKET_ROWS,
    broadcast_brackets: int = BROADCAST_BRACKETS,
) -> DataFrame:
    """Per group the number ``n`` of its values and the interpolated quantiles named in ``probabilities``.

    A quantile at p lies between the values of ranks floor and ceil of
    p * (n - 1). For each, a bracket of values narrows: one pass over the rows
    counts what lies below and inside, and sums the inside up in a mergeable
    summary, whose steps give the next bracket. A bracket that is small enough
    is ranked by its distinct values. So a group of any size moves only its
    summaries. Many groups are ranked by ranges of key and value.

    Null and NaN values take no part; a null key is a group. Groups without a
    value give no row.
    """
    rows = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    rows = settled(rows, "quantile-rows")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in probabilities.items()])
    place = F.col("_asked.p") * (F.col("n") - 1)
    targets = sizes.withColumn("_asked", F.explode(asked)).select(
        *keys,
        "n",
        F.col("_asked.name").alias("_name"),
        F.floor(place).alias("_floor"),
        F.ceil(place).alias("_ceil"),
        (place - F.floor(place)).alias("_share"),
        "_low",
        "_high",
        F.lit(0).cast("long").alias("_below"),
        F.col("n").alias("_inside"),
    )
    targets = settled(targets, "quantile-targets")
    if targets.count() > broadcast_brackets:
        found = _by_ranges(rows, targets, keys)
    else:
        found = _by_brackets(rows, targets, keys, bracket_rows)
    quantile = F.col("_at_floor") + (F.col("_at_ceil") - F.col("_at_floor")) * F.col("_share")
    named = [F.max(F.when(F.col("_name") == name, quantile)).alias(name) for name in probabilities]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *named)


def _by_ranges(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    ranked = row_numbers(rows, keys, ["_v"], "_rank")
    wanted = targets.withColumn("_rank", F.explode(F.array_distinct(F.array(F.col("_floor") + 1, F.col("_ceil") + 1))))
    wanted = _marked(wanted, [*keys, "_rank"])
    met = ranked.join(wanted, _same(ranked, wanted, [*keys, "_rank"]))
    first = F.when(F.col("_rank") == F.col("_floor") + 1, F.col("_v"))
    last = F.when(F.col("_rank") == F.col("_ceil") + 1, F.col("_v"))
    return met.groupBy(*keys, "_name", "n", "_share").agg(F.max(first).alias("_at_floor"), F.max(last).alias("_at_ceil"))


def _inside(rows: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows at or below the upper ends of their group's brackets; one row per bracket."""
    wanted = F.broadcast(_marked(brackets, keys))
    met = rows.join(wanted, _same(rows, wanted, keys) & (rows["_v"] <= wanted["_high"]))
    return met.drop(*[f"_of_{k}" for k in keys])


def _by_brackets(rows: DataFrame, targets: DataFrame, keys: list[str], bracket_rows: int) -> DataFrame:
    done, open_ = [], targets
    fixed = [*keys, "n", "_name", "_floor", "_ceil", "_share"]
    wide = (F.col("_inside") > bracket_rows) & (F.col("_low") < F.col("_high"))
    while True:
        done.append(open_.where(~wide))
        open_ = open_.where(wide)
        if open_.isEmpty():
            break
        steps = F.percentile_approx(
            F.when(F.col("_v") >= F.col("_low"), F.col("_v")), F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)]), ACCURACY
        )
        summed = _inside(rows, open_, keys).groupBy(*fixed, "_low", "_high", "_below", "_inside").agg(steps.alias("_steps"))

        def step(rank: str, away: int) -> Column:
            at = F.floor((F.col(rank) - F.col("_below")) / F.col("_inside") * STEPS) + away
            return F.get("_steps", F.greatest(F.least(at, F.lit(STEPS)), F.lit(0)).cast("int"))

        narrowed = summed.select(*fixed, "_low", "_high", "_below", "_inside", step("_floor", -1).alias("_l"), step("_ceil", 2).alias("_h"))
        narrowed = settled(narrowed, "quantile-brackets")
        tried = narrowed.select(*fixed, F.col("_l").alias("_low"), F.col("_h").alias("_high"))
        counted = _inside(rows, tried, keys).groupBy(*fixed, "_low", "_high")
        counted = counted.agg(
            F.count_if(F.col("_v") < F.col("_low")).alias("_below"), F.count_if(F.col("_v") >= F.col("_low")).alias("_inside")
        )
        # Counts prove a bracket. One that does not hold its ranks, or is no smaller, gives way to the one before.
        holds = (F.col("_below") <= F.col("_floor")) & (F.col("_ceil") < F.col("_below") + F.col("_inside"))
        old = _marked(narrowed.select(*keys, "_name", F.col("_low").alias("_l"), F.col("_high").alias("_h"),
                                      F.col("_below").alias("_b"), F.col("_inside").alias("_i")), [*keys, "_name"])
        met = counted.join(old, _same(counted, old, [*keys, "_name"]))
        better = holds & (F.col("_inside") < F.col("_i"))
        chosen = {"_low": "_l", "_high": "_h", "_below": "_b", "_inside": "_i"}
        met = met.select(*fixed, better.alias("_better"), *[F.when(better, F.col(new)).otherwise(F.col(o)).alias(new) for new, o in chosen.items()])
        met = settled(met, "quantile-brackets")
        done.append(met.where("NOT _better").drop("_better"))
        open_ = met.where("_better").drop("_better")
    last = reduce(DataFrame.unionByName, [d.select(*fixed, "_low", "_high", "_below") for d in done])
    counts = _inside(rows, last, keys).where(F.col("_v") >= F.col("_low")).groupBy(*fixed, "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys, "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_upto", F.col("_below") + F.sum("_c").over(upto))
    # A value covers the ranks from _upto - _c up to _upto - 1.
    covers = lambda rank: (F.col(rank) < F.col("_upto")) & (F.col(rank) >= F.col("_upto") - F.col("_c"))
    return ranked.groupBy(*keys, "_name", "n", "_share").agg(
        F.max(F.when(covers("_floor"), F.col("_v"))).alias("_at_floor"), F.max(F.when(covers("_ceil"), F.col("_v"))).alias("_at_ceil")
    )

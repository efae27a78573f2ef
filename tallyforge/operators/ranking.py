"""Ranking by weighted min-max utility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criterion:
    metric: str
    weight: float
    higher_is_better: bool = True


# How architecture candidates are weighed.
ARCHITECTURE_CRITERIA = (
    Criterion("validation_loss", 0.25, higher_is_better=False),
    Criterion("tokens_per_second_per_gpu", 0.20),
    Criterion("reasoning_score", 0.25),
    Criterion("memory_gb_per_gpu", 0.15, higher_is_better=False),
    Criterion("stability_score", 0.15),
)


def utility(entities: DataFrame, criteria: tuple[Criterion, ...]) -> DataFrame:
    """Adds ``utility_score``; a metric that never varies gives everyone full marks.

    The ranges are one scalar subquery, not a window over all rows.
    """
    bounds = entities.agg(
        F.struct(
            *[F.min(c.metric).alias(f"lo_{c.metric}") for c in criteria],
            *[F.max(c.metric).alias(f"hi_{c.metric}") for c in criteria],
        ).alias("bounds")
    )

    def marks(c: Criterion) -> Column:
        low, high = F.col(f"_bounds.lo_{c.metric}"), F.col(f"_bounds.hi_{c.metric}")
        scaled = (F.col(c.metric) - low) / F.nullif(high - low, F.lit(0.0))
        directed = scaled if c.higher_is_better else 1.0 - scaled
        return c.weight * F.when(low == high, F.lit(1.0)).otherwise(directed)

    total = marks(criteria[0])
    for c in criteria[1:]:
        total = total + marks(c)
    return (
        entities.withColumn("_bounds", bounds.scalar()).withColumn("utility_score", F.round(total, 4)).drop("_bounds")
    )


def minmax_utility_rank(
    entities: DataFrame, criteria: tuple[Criterion, ...], position: str, block_rows: int = 1_000_000
) -> DataFrame:
    """Adds ``utility_score`` and ``rank``: best first, ties in order of ``position``, rows without a score last.

    Scores have four decimals, so there are few distinct ones. A rank is the count
    of better scores, plus earlier blocks of the same score, plus the place inside
    the block: no task sorts more than one block of one score.
    """
    scored = utility(entities, criteria).withColumn("_block", F.floor(F.col(position) / block_rows))
    cells = scored.groupBy("utility_score", "_block").agg(F.count(F.lit(1)).alias("n"))
    scores = cells.groupBy("utility_score").agg(F.sum("n").alias("n"))
    # At most one row per four-decimal score goes through this window.
    better = Window.orderBy(F.desc("utility_score")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("utility_score").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.withColumn("_earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
        .withColumnsRenamed({"utility_score": "_score", "_block": "_part"})
    )
    above = scores.select(F.col("utility_score").alias("_other"), F.coalesce(F.sum("n").over(better), F.lit(0)).alias("_better"))
    offsets = offsets.join(above, F.col("_score").eqNullSafe(F.col("_other"))).drop("_other")
    inside = F.row_number().over(Window.partitionBy("utility_score", "_block").orderBy(position))
    return (
        scored.withColumn("_inside", inside)
        .join(offsets, F.col("utility_score").eqNullSafe(F.col("_score")) & F.col("_block").eqNullSafe(F.col("_part")))
        .withColumn("rank", (F.col("_better") + F.col("_earlier") + F.col("_inside")).cast("long"))
        .drop("_block", "_inside", "_better", "_earlier", "_score", "_part")
    )


def top_k(entities: DataFrame, criteria: tuple[Criterion, ...], position: str, k: int) -> DataFrame:
    """The k best; each task keeps its own k, so no full sort."""
    return utility(entities, criteria).orderBy(F.desc("utility_score"), position).limit(k)

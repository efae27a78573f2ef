"""Benchmarks of an evaluation suite, as configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallyforge.session import config_table


@dataclass(frozen=True)
class Benchmark:
    name: str
    dimension: str
    datasets: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    weight: float = 1.0
    gate: dict[str, float] = field(default_factory=dict)


def suite_metrics(suite: list[Benchmark]) -> list[str]:
    return sorted({metric for b in suite for metric in b.metrics})


def benchmarks_table(spark: SparkSession, suite: list[Benchmark]) -> DataFrame:
    rows = [(b.name, b.dimension, list(b.datasets), list(b.metrics), float(b.weight)) for b in suite]
    return config_table(
        spark,
        rows,
        {
            "benchmark": "string",
            "dimension": "string",
            "datasets": "array<string>",
            "metrics": "array<string>",
            "weight": "double",
        },
    )


def gates_table(spark: SparkSession, suite: list[Benchmark]) -> DataFrame:
    rows = [(b.name, metric, float(value)) for b in suite for metric, value in b.gate.items()]
    return config_table(spark, rows, {"benchmark": "string", "metric": "string", "threshold": "double"})

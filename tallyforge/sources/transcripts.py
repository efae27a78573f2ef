"""Scored samples written out as JSON Lines, one folder per benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import safe_name


def write_transcripts(scored: DataFrame, path: str) -> DataFrame:
    """Writes ``id, benchmark, dataset, prompt, reference, prediction`` and counts what is read back.

    The folder ``file=<name>.jsonl`` lets a reader pick one benchmark by name.
    """
    line = F.to_json(
        F.struct("id", "benchmark", "dataset", "prompt", "reference", "prediction"), {"ignoreNullFields": "false"}
    )
    (
        scored.select(F.concat(safe_name(F.col("benchmark")), F.lit(".jsonl")).alias("file"), line.alias("value"))
        .write.mode("errorifexists")
        .partitionBy("file")
        .text(path)
    )
    spark = scored.sparkSession
    return (
        spark.read.text(path)
        .select(F.get_json_object("value", "$.benchmark").alias("benchmark"))
        .groupBy("benchmark")
        .agg(F.count(F.lit(1)).alias("samples"))
    )

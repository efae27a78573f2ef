"""Prediction files: JSON Lines, a list, ``{predictions: [...]}`` or one flat object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.variant import entries, field, first_present, first_truthy, items
from tallyforge.sources.lines import scanned_lines


def _id_and_prediction(row: str) -> tuple[Column, Column]:
    return (
        F.expr(f"coalesce({first_truthy(row, ('id', 'sample_id'))}, 'None')").alias("id"),
        F.expr(f"coalesce({first_present(row, ('prediction', 'response'))}, {row})").alias("prediction"),
    )


def last_prediction(rows: DataFrame, order: str = "place") -> DataFrame:
    """One prediction per id, the last one in order.

    An aggregate rather than a ranking window, so that copies of one id shrink
    before the shuffle.
    """
    return rows.groupBy("id").agg(F.max_by("prediction", order).alias("prediction"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``id, prediction`` (VARIANT). A path that ends in ``.json`` holds one JSON document per file."""
    if path.endswith(".json"):
        # Of several documents the one whose file comes last by name counts last.
        file = F.col("_metadata.file_path").alias("file")
        document = spark.read.option("wholetext", "true").text(path).select(file, F.parse_json("value").alias("doc"))
        listed = f"coalesce({items(field('doc', 'predictions'))}, {items('doc')})"
        document = document.withColumn("listed", F.expr(listed))
        rows = document.select("file", F.posexplode("listed").alias("at", "row"))
        place = F.struct("file", "at").alias("place")
        flat = (
            document.filter(F.col("listed").isNull())
            .select("file", F.lit(0).alias("at"), F.explode(F.expr(entries("doc"))).alias("id", "prediction"))
            .select("id", F.expr("coalesce(prediction, parse_json('null'))").alias("prediction"), place)
        )
        return last_prediction(rows.select(*_id_and_prediction("row"), place).unionByName(flat))
    lines = scanned_lines(spark, path).filter(F.trim("value") != "")
    rows = lines.withColumn("row", F.parse_json("value"))
    return last_prediction(rows.select(*_id_and_prediction("row"), "place"))

"""Text lines with their file and place, without reading a file in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ``name.jsonl`` is a file, or a folder of part files such as a Spark job writes.
STEM = r"([^/=]+)\.jsonl(?:/[^/]*)?$"


def _scan(spark: SparkSession, path: str) -> DataFrame:
    # The path comes encoded as in a URL, where a plus stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            "value",
            F.regexp_extract(name, STEM, 1).alias("stem"),
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("scan_order"),
        )
    )


def line_place() -> Column:
    """Sortable place of a line: file, split of the file, order inside the split."""
    return F.struct("file_path", "block_start", "scan_order")


def scanned_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a ``place`` that sorts them as they stand in the files."""
    return _scan(spark, path).select("value", "stem", line_place().alias("place"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, stem, line_index`` of JSON Lines files; the index counts from zero within a stem.

    Files that are not JSON Lines are passed over. Lines are counted per file
    split, the few counts are summed up in order, and a line's place in its
    split comes from the scan itself, so the lines do not move.
    """
    lines = _scan(spark, path).filter("stem <> ''")
    split = ["stem", "file_path", "block_start"]
    in_order = Window.partitionBy("stem").orderBy("file_path", "block_start")
    offsets = (
        lines.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("n"), F.min("scan_order").alias("first"))
        .withColumn(
            "offset",
            F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("n")
    )
    return lines.join(offsets, split).select(
        "value", "stem", (F.col("offset") + F.col("scan_order") - F.col("first")).alias("line_index")
    )

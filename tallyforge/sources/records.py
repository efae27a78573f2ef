"""Training records from JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.variant import kind, text_of

# White space that ends count as blank.
_EDGE = r"^[\x09-\x0d\x1c-\x20\x85\p{Z}]+|[\x09-\x0d\x1c-\x20\x85\p{Z}]+$"


def ingest_jsonl_records(lines: DataFrame, value_column: str = "value") -> DataFrame:
    """One ``record`` (VARIANT) per non-blank line; other columns pass through.

    ``kind`` says how the line was read: ``object`` keeps the JSON object,
    ``scalar`` wraps any other JSON value as ``{text: value}`` and ``invalid``
    wraps the line itself.
    """
    stripped = lines.withColumn(value_column, F.regexp_replace(value_column, _EDGE, ""))
    parsed = stripped.filter(F.col(value_column) != "").withColumn("_json", F.try_parse_json(value_column))
    read_as = f"CASE WHEN _json IS NULL THEN 'invalid' WHEN {kind('_json')} = 'OBJECT' THEN 'object' ELSE 'scalar' END"
    text = F.expr(f"coalesce({text_of('_json')}, {value_column})")
    return (
        parsed.withColumn("kind", F.expr(read_as))
        .withColumn(
            "record",
            F.when(F.col("kind") == "object", F.col("_json")).otherwise(
                F.to_variant_object(F.struct(text.alias("text")))
            ),
        )
        .drop("_json", value_column)
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON Lines files."""
    return ingest_jsonl_records(spark.read.text(path))

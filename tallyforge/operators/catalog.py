"""Checks and facets over catalogue tables."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import config_table


@dataclass(frozen=True)
class Rule:
    """One requirement on a column.

    Kinds: ``required``, ``type``, ``minimum``, ``above``, ``allowed``, ``prefix``, ``not_empty`` (text, list or
    map) and ``listed_in``, whose argument is a list column that must hold the value.
    """

    column: str
    kind: str
    argument: Any = None


def _broken(rule: Rule, is_collection: bool) -> tuple[Column, Column]:
    value = F.col(rule.column)
    shown = value.cast("string")
    if rule.kind == "required":
        return value.isNull(), F.lit(f"missing required key '{rule.column}'")
    if rule.kind == "type":
        wrong = value.isNotNull() & value.try_cast(rule.argument).isNull()
        return wrong, F.lit(f"expected {rule.argument}")
    if rule.kind == "minimum":
        return value < rule.argument, F.concat(F.lit(f"expected >= {rule.argument}, got "), shown)
    if rule.kind == "above":
        return ~(value > rule.argument), F.lit(f"must be above {rule.argument}")
    if rule.kind == "allowed":
        allowed = ", ".join(str(item) for item in rule.argument)
        return ~value.isin(list(rule.argument)), F.concat(F.lit(f"expected one of {allowed}, got "), shown)
    if rule.kind == "prefix":
        starts = [F.startswith(F.coalesce(value, F.lit("")), F.lit(prefix)) for prefix in rule.argument]
        anyone = starts[0]
        for start in starts[1:]:
            anyone = anyone | start
        return ~anyone, F.lit("must start with " + ", ".join(rule.argument))
    if rule.kind == "not_empty":
        size = F.size(value) if is_collection else F.length(shown)
        return value.isNull() | (size == 0), F.lit("must not be empty")
    if rule.kind == "listed_in":
        return ~F.array_contains(rule.argument, value), F.lit(f"must be listed in {rule.argument}")
    raise ValueError(f"unknown rule kind {rule.kind}")


def validate_rules(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``key, column, rule, message``, one row per broken rule; no shuffle."""
    collections = {field.name for field in df.schema.fields if field.dataType.typeName() in ("array", "map")}
    checks = []
    for rule in rules:
        broken, message = _broken(rule, rule.column in collections)
        checks.append(
            F.when(
                F.coalesce(broken, F.lit(False)),
                F.struct(F.lit(rule.column).alias("column"), F.lit(rule.kind).alias("rule"), message.alias("message")),
            )
        )
    issues = F.filter(F.array(*checks), lambda issue: issue.isNotNull())
    return df.select(F.col(key), F.explode(issues).alias("issue")).select(key, "issue.column", "issue.rule", "issue.message")


def required_coverage(df: DataFrame, column: str, required: list[str]) -> DataFrame:
    """Required values that no row has. Only required values survive the scan, so the rest is tiny."""
    wanted = config_table(df.sparkSession, [(value,) for value in sorted(set(required))], {"missing": "string"})
    present = df.filter(F.col(column).isin(list(required))).select(F.col(column).alias("missing")).distinct()
    return wanted.join(present, "missing", "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Second and later rows of each key, first one by ``order`` (unique).

    The first row per key comes from an aggregate that shrinks before the shuffle;
    joining it back lets Spark split a key that holds many rows.
    """
    firsts = (
        df.groupBy(*keys)
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > 1)
        .drop("_rows")
    )
    same = F.lit(True)
    renamed = firsts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(renamed, same & (F.col(order) > F.col("_first"))).select(df.columns)


def probability_map_check(df: DataFrame, key: str, column: str, tolerance: float = 1e-6) -> DataFrame:
    """``key, entry, message`` for negative weights and for a total other than one."""
    weights = F.col(column)
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, x: s + x)
    negative = F.transform(
        F.filter(F.map_entries(weights), lambda e: e["value"] < 0),
        lambda e: F.struct(e["key"].alias("entry"), F.lit("probability must be non-negative").alias("message")),
    )
    off = F.when(
        F.abs(total - 1.0) > tolerance,
        F.array(
            F.struct(
                F.lit("*").alias("entry"),
                F.format_string("probabilities must sum to 1.0, got %.6f", total).alias("message"),
            )
        ),
    ).otherwise(F.array().cast("array<struct<entry:string,message:string>>"))
    issues = F.concat(negative.cast("array<struct<entry:string,message:string>>"), off)
    return df.select(F.col(key), F.explode(issues).alias("issue")).select(key, "issue.entry", "issue.message")


def catalog_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows that meet all given conditions; an array column must contain the value."""
    arrays = {field.name for field in df.schema.fields if field.dataType.typeName() == "array"}
    for column, value in wanted.items():
        if value:
            df = df.filter(F.array_contains(column, value) if column in arrays else F.col(column) == value)
    return df


def catalog_facets(df: DataFrame, facets: list[str]) -> DataFrame:
    """``facet, value, entries``: rows per value of each facet, array elements one by one.

    All facets go through one exploded pass and one shuffle of partial counts.
    """
    arrays = {field.name for field in df.schema.fields if field.dataType.typeName() == "array"}

    def values(facet: str) -> Column:
        listed = F.col(facet) if facet in arrays else F.array(F.col(facet))
        named = F.transform(listed, lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value")))
        # A missing list has no values; left as NULL it would void the row's other facets.
        return F.coalesce(named, F.array().cast("array<struct<facet:string,value:string>>"))

    pairs = F.flatten(F.array(*[values(facet) for facet in facets]))
    return (
        df.select(F.explode(pairs).alias("pair"))
        .groupBy("pair.facet", "pair.value")
        .agg(F.count(F.lit(1)).alias("entries"))
    )


def catalog_listing(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in catalogue order with arrays written out."""
    arrays = {field.name for field in df.schema.fields if field.dataType.typeName() == "array"}
    shown = [F.array_join(c, ", ").alias(c) if c in arrays else F.col(c) for c in df.columns]
    return df.orderBy(*order).select(*shown)


# Text fragments that show a processing capability.
CAPABILITIES = {
    "clean": ("clean", "filter", "redaction", "repair"),
    "deduplicate": ("dedup",),
    "cluster": ("cluster", "taxonomy"),
    "quality": ("quality", "score", "perplexity"),
}


def _tags(text: Column, needles: dict[str, tuple[str, ...]]) -> Column:
    low = F.lower(text)

    def seen(words: tuple[str, ...]) -> Column:
        hit = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(low, F.lit(word))
        return hit

    marks = F.array(*[F.when(seen(words), F.lit(tag)) for tag, words in sorted(needles.items())])
    return F.array_compact(marks)


def keyword_tag(df: DataFrame, key: str, text: str, needles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``key, tag`` for each tag of which the text holds a needle."""
    return df.select(F.col(key), F.explode(_tags(F.col(text), needles or CAPABILITIES)).alias("tag"))


def keyword_coverage(df: DataFrame, text: str, needles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``tag, records, missing``: how many texts show each tag, and the tags none shows."""
    needles = needles or CAPABILITIES
    counts = df.select(F.explode(_tags(F.col(text), needles)).alias("tag")).groupBy("tag").count()
    tags = config_table(df.sparkSession, [(tag,) for tag in sorted(needles)], {"tag": "string"})
    records = F.coalesce("count", F.lit(0))
    return tags.join(counts, "tag", "left").select("tag", records.alias("records"), (records == 0).alias("missing"))

"""Data sources: sizes, shares, gates, licences, plans and lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import compact_text_hash, digest_prefix
from tallyforge.session import config_table

# Fixed values.
REQUIRED_MODALITIES = ("pure_text", "multimodal", "video_pretraining", "audio_speech", "vla")
BLOCKED_LICENSES = ("unknown", "restricted")
MIN_QUALITY, MAX_DUPLICATE_RATE = 0.72, 0.08


@dataclass(frozen=True)
class Stage:
    name: str
    operations: tuple[str, ...]
    output: str
    owner: str = "data-platform"


def source_measures(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``source, documents, distinct_texts, duplicate_rate, quality_score`` from documents.

    Copies of a text shrink to one row per source and hash before the source is
    summed up, so neither a large source nor a much-copied text meets one task.
    A source without labels has quality 0.
    """
    rows = docs.select("doc_id", "source", compact_text_hash(F.col("text")).alias("hash"))
    if labels is not None:
        rows = rows.join(labels.select("doc_id", "quality"), "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(None).cast("int"))
    per_text = rows.groupBy("source", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("q"), F.count("quality").alias("labelled")
    )
    return per_text.groupBy("source").agg(
        F.sum("n").alias("documents"),
        F.count(F.lit(1)).alias("distinct_texts"),
        (1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_rate"),
        F.coalesce(F.try_divide(F.sum("q"), F.sum("labelled")), F.lit(0.0)).alias("quality_score"),
    )


def duplicate_rate_by_source(measures: DataFrame, max_duplicate_rate: float = MAX_DUPLICATE_RATE) -> DataFrame:
    return measures.select(
        "source",
        "documents",
        (F.col("documents") - F.col("distinct_texts")).alias("duplicates"),
        F.round("duplicate_rate", 6).alias("duplicate_rate"),
        (F.col("duplicate_rate") <= max_duplicate_rate).alias("dedup_passed"),
    )


def source_quality_gate(
    measures: DataFrame, min_quality: float = MIN_QUALITY, max_duplicate_rate: float = MAX_DUPLICATE_RATE
) -> DataFrame:
    """Flags and issue text per source."""
    quality, duplicates = F.col("quality_score"), F.col("duplicate_rate")
    low = F.when(
        quality < min_quality, F.format_string(f"quality_score %.3f is below gate {min_quality:.3f}", quality)
    )
    many = F.when(
        duplicates > max_duplicate_rate,
        F.format_string(f"duplicate_rate %.3f exceeds gate {max_duplicate_rate:.3f}", duplicates),
    )
    return measures.select(
        "source",
        "documents",
        F.round(quality, 6).alias("quality_score"),
        F.round(duplicates, 6).alias("duplicate_rate"),
        (quality >= min_quality).alias("quality_passed"),
        (duplicates <= max_duplicate_rate).alias("dedup_passed"),
        F.concat_ws("; ", low, many).alias("issues"),
    )


def license_allowlist(sources: DataFrame, blocked: tuple[str, ...] = BLOCKED_LICENSES) -> DataFrame:
    """Adds the pass flag of each source and of all of them."""
    flagged = sources.withColumn(
        "license_allowlist_passed", ~F.coalesce("license", F.lit("unknown")).isin(list(blocked))
    )
    overall = flagged.agg(F.bool_and("license_allowlist_passed").alias("all_passed"))
    return flagged.withColumn("all_passed", overall.scalar())


def source_join_license(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents with the attributes of their source.

    A ledger that was counted and is small goes to every task, so a source that
    holds much of the documents is not gathered anywhere; a larger ledger joins by
    shuffle, where Spark splits skewed partitions.
    """
    return docs.join(ledger, "source", "left")


def risk_counts(df: DataFrame, column: str = "risks") -> DataFrame:
    return (
        df.select(F.explode(column).alias("risk")).groupBy("risk").agg(F.count(F.lit(1)).alias("entries"))
    )


def size_by_modality(sources: DataFrame, size: str = "size", modalities: str = "modalities") -> DataFrame:
    """A source's size is split evenly over its modalities."""
    share = F.col(size) / F.size(modalities)
    return (
        sources.select(F.explode(modalities).alias("modality"), share.alias("share"))
        .groupBy("modality")
        .agg(F.round(F.sum("share"), 3).alias("size"))
    )


def mixture_plan(stages: DataFrame) -> DataFrame:
    """``stage, axis, target, amount`` from ``name, total, modality_targets, language_targets``."""

    def axis(name: str, column: str) -> DataFrame:
        return stages.select(
            F.col("name").alias("stage"), F.lit(name).alias("axis"), "total", F.explode(column).alias("target", "ratio")
        )

    both = axis("modality", "modality_targets").unionByName(axis("language", "language_targets"))
    return both.select("stage", "axis", "target", F.round(F.col("total") * F.col("ratio"), 3).alias("amount"))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """One row: size, distinct languages, modalities in order, sources.

    ``docs`` has ``source, lang, modality, size``. Grouping on the three small
    dimensions first leaves a few rows for the distinct counts.
    """
    cells = docs.groupBy("source", "lang", "modality").agg(F.sum("size").alias("size"))
    return cells.agg(
        F.round(F.sum("size"), 3).alias("total_size"),
        F.count_distinct("lang").alias("language_count"),
        F.array_join(F.sort_array(F.collect_set("modality")), ",").alias("modalities"),
        F.count_distinct("source").alias("source_count"),
    )


def scale_gates(
    summary: DataFrame,
    min_size: float,
    min_languages: int,
    modalities: tuple[str, ...] = REQUIRED_MODALITIES,
) -> DataFrame:
    missing = F.array_except(F.array(*[F.lit(m) for m in modalities]), F.split("modalities", ","))
    return summary.select(
        "total_size",
        "language_count",
        "modalities",
        (F.col("total_size") >= min_size).alias("scale_passed"),
        (F.col("language_count") >= min_languages).alias("language_passed"),
        (F.size(missing) == 0).alias("modalities_passed"),
        F.array_join(F.sort_array(missing), ",").alias("missing_modalities"),
    )


def lineage_ledger(pool: DataFrame, stages: list[Stage], source: str = "source") -> DataFrame:
    """Plan entry per processing stage with a digest of what goes into it.

    The digest covers the stage's name, its operations and the sorted names of the
    pool's sources; only distinct names are gathered.
    """
    names = pool.select(F.col(source).alias("name")).distinct()
    gathered = names.agg(F.sort_array(F.collect_list("name")).alias("sources")).withColumn(
        "source_count", F.size("sources").cast("long")
    )
    table = config_table(
        pool.sparkSession,
        [(i, s.name, list(s.operations), s.output, s.owner) for i, s in enumerate(stages)],
        {"position": "long", "stage": "string", "operations": "array<string>", "output": "string", "owner": "string"},
    )

    def listed(items):
        return F.concat(
            F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]")
        )

    inputs = gathered.select(F.struct("sources", "source_count").alias("inputs")).scalar()
    body = F.concat(
        F.lit('{"operations": '),
        listed(F.col("operations")),
        F.lit(', "sources": '),
        listed(F.col("inputs.sources")),
        F.lit(', "stage": "'),
        F.col("stage"),
        F.lit('"}'),
    )
    return (
        table.withColumn("inputs", inputs)
        .withColumn("digest", digest_prefix(body, 12))
        .select(
            "position",
            "stage",
            F.lit("planned").alias("status"),
            F.concat(F.lit("artifact://data/"), "output", F.lit("/"), "digest").alias("output_uri"),
            F.size("operations").cast("long").alias("operation_count"),
            "owner",
            F.col("inputs.source_count").alias("source_count"),
        )
    )

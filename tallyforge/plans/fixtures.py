"""Inputs that Spark derives from the given tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.suite import Benchmark
from tallyforge.session import spread
from tallyforge.sources.samples import sample_from_payload

# Values of a document's sample that read the same in both SQL dialects.
SAMPLE_FIELDS = {
    "confidence": "CASE WHEN doc_id % 7 <> 0 THEN CAST(doc_id % 10 AS DOUBLE) / 10 END",
    "success": "CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 <> 0 END",
    "recovered": "CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 = 0 END",
    "collision_free": "CASE WHEN doc_id % 4 <> 1 THEN doc_id % 7 <> 0 END",
    "unsafe_action": "CASE WHEN doc_id % 6 <> 0 THEN doc_id % 11 = 0 END",
    "steps": "CASE WHEN doc_id % 3 <> 2 THEN doc_id % 9 + 1 END",
    "cost": "CASE WHEN doc_id % 4 <> 3 THEN CAST(n_chars AS DOUBLE) / 1000 END",
    "latency_ms": "CAST(n_chars AS DOUBLE) / 10",
    "peak_memory_gb": "CAST(doc_id % 30 AS DOUBLE)",
    "power_w": "CASE WHEN doc_id % 10 = 0 THEN 'unplugged' ELSE concat('', doc_id % 50) END",
}
SCORE_FIELDS = {
    "wer": "CAST(doc_id % 20 AS DOUBLE) / 20",
    "mos": "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS DOUBLE) END",
    "consensus_pass": "CASE WHEN doc_id % 6 = 0 THEN CAST(doc_id % 4 AS DOUBLE) / 4 END",
    "memory_gb": "CASE WHEN doc_id % 8 = 0 THEN 'n/a' ELSE concat('', doc_id % 40) END",
}

SUITE = [
    Benchmark(
        "core_en", "general", ("src0",), ("accuracy", "macro_average", "calibration_error"), 1.0, {"macro_average": 0.72}
    ),
    Benchmark(
        "core_fr", "reasoning", ("src1",), ("pass_at_1", "consensus_pass", "f1"), 1.4, {"pass_at_1": 0.48, "f1": 0.5}
    ),
    Benchmark(
        "core_de", "general", ("src2",), ("accuracy", "wer", "mos"), 1.2, {"accuracy": 0.3, "wer": 0.6, "max_wer": 0.9}
    ),
    Benchmark(
        "core_es",
        "vla",
        ("src3",),
        ("success_rate", "collision_free_rate", "recovery_rate", "unsafe_action_rate", "steps_to_success", "memory_gb"),
        1.1,
        {"success_rate": 0.3, "unsafe_action_rate": 0.5},
    ),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _payload(df: DataFrame, fields: dict[str, str], keep: list[str]) -> DataFrame:
    body = F.struct(*[F.expr(sql).alias(name) for name, sql in fields.items()])
    return df.select(*keep, F.parse_json(F.to_json(body)).alias("payload"))


def answer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per document: the text is the reference, a changed copy the prediction."""
    fields = {
        "id": "concat('doc-', doc_id)",
        "benchmark": "concat('core_', lang)",
        "dataset": "source",
        "prompt": "concat('Repeat document ', doc_id)",
        "answer": "text",
        "prediction": r"""CASE doc_id % 4
            WHEN 0 THEN concat(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '.')
            WHEN 1 THEN regexp_replace(text, r'(\S+\s+\S+\s+)\S+\s*', '$1')
            WHEN 2 THEN replace(text, ' the ', ' a ')
            ELSE '' END""",
        **SAMPLE_FIELDS,
        "scores": "CASE WHEN doc_id % 2 = 0 THEN struct("
        + ", ".join(f"{sql} AS {name}" for name, sql in SCORE_FIELDS.items())
        + ") END",
    }
    rows = _payload(spread(table(spark, sf_dir, "documents")), fields, ["doc_id"])
    return sample_from_payload(rows, F.lit("documents"), F.col("doc_id"))


def choice_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One multiple-choice sample per label; the answer is a letter."""
    fields = {
        "id": "concat('label-', doc_id)",
        "benchmark": "'choices'",
        "dataset": "'labels'",
        "question": "'Is the text good?'",
        "answer": "CASE quality WHEN 1 THEN 'B' ELSE 'A' END",
        "choices": "array('bad text', 'good text')",
        "prediction": """CASE doc_id % 5 WHEN 0 THEN 'b' WHEN 1 THEN 'Good text!' WHEN 2 THEN 'the bad  text'
            WHEN 3 THEN '' ELSE 'A.' END""",
    }
    rows = _payload(table(spark, sf_dir, "labels"), fields, ["doc_id"])
    return sample_from_payload(rows, F.lit("labels"), F.col("doc_id"))


def tool_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool call per document: right, wrong tool, wrong argument, or no JSON."""
    fields = {
        "id": "concat('call-', doc_id)",
        "benchmark": "'tools'",
        "dataset": "source",
        "prompt": "concat('Look up ', doc_id)",
        "expected_tool": "'lookup'",
        "expected_arguments": "struct(lang AS lang, n_chars AS n, array(1, n_chars) AS more)",
        "required_fields": "CASE WHEN doc_id % 3 = 0 THEN array('arguments', 'trace') ELSE array('arguments') END",
        "prediction": """CASE doc_id % 4
            WHEN 0 THEN concat('{"tool": "lookup", "arguments": {"lang": "', lang, '", "n": ', n_chars, ', "more": [1e0, ',
                CASE doc_id % 7 WHEN 2 THEN concat('"', n_chars, '"') WHEN 3 THEN concat(n_chars, '.0') ELSE concat(n_chars, '') END, ']}}')
            WHEN 1 THEN concat('{"name": "other", "arguments": {"lang": "', lang, '", "n": ', n_chars, '}}')
            WHEN 2 THEN concat('{"name": "lookup", "arguments": {"lang": "', lang, '"}}')
            ELSE 'call lookup' END""",
        "tool_error": "CASE WHEN doc_id % 5 = 1 THEN doc_id % 2 = 1 END",
        "metrics": "CASE WHEN doc_id % 5 = 0 THEN struct(CAST(doc_id % 8 AS DOUBLE) / 8 AS tool_error_rate) END",
    }
    rows = _payload(spread(table(spark, sf_dir, "documents")), fields, ["doc_id"])
    return sample_from_payload(rows, F.lit("tools"), F.col("doc_id"))


def action_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of each embedding as reference and predicted action; some held in objects, some of unequal length."""
    said = "transform(slice(embedding, 33, CASE WHEN vec_id % 10 = 0 THEN 31 ELSE 32 END), x -> CAST(x AS DOUBLE))"
    fields = {
        "id": "concat('vec-', vec_id)",
        "benchmark": "'actions'",
        "dataset": "CAST(label AS STRING)",
        "prompt": "'move'",
        "reference_action": "transform(slice(embedding, 1, 32), x -> CAST(x AS DOUBLE))",
        "prediction": f"""CASE vec_id % 10 WHEN 1 THEN to_json(struct({said} AS action))
            WHEN 2 THEN to_json(struct(to_json(struct({said} AS trajectory)) AS predicted_action))
            WHEN 3 THEN to_json(struct(struct(to_json({said}) AS action) AS action))
            WHEN 9 THEN to_json(struct({said} AS other)) ELSE to_json({said}) END""",
    }
    rows = _payload(table(spark, sf_dir, "embeddings"), fields, ["vec_id"])
    return sample_from_payload(rows, F.lit("actions"), F.col("vec_id"))


def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two predictions per labelled document, in order; the second one is the text itself or a flag."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id")
    rows = labels.select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"),
        "doc_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("place"), F.concat(F.lit("first "), "quality").alias("prediction")),
                F.struct(
                    F.lit(1).alias("place"),
                    F.when(F.col("quality") == 1, F.col("text")).otherwise("rejected").alias("prediction"),
                ),
            )
        ).alias("p"),
    )
    return rows.select("id", "doc_id", "p.place", F.col("p.prediction").cast("variant").alias("prediction"))


def source_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.sum("n_chars").cast("double").alias("size"))
        .select(
            "source",
            "size",
            F.element_at(F.array(*map(F.lit, ("web", "collected", "business"))), number % 3 + 1).alias("source_type"),
            F.element_at(
                F.array(*map(F.lit, ("cc-by", "unknown", "mit", "restricted", "apache-2.0"))), number % 5 + 1
            ).alias("license"),
            F.when(number % 2 == 0, F.array(F.lit("pure_text"), F.lit("multimodal")))
            .otherwise(F.array(F.lit("pure_text")))
            .alias("modalities"),
        )
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts read as catalogue entries."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("position"),
        F.concat(F.lit("part-"), "p_partkey").alias("name"),
        F.col("p_brand").alias("family"),
        F.split("p_name", " ").alias("modalities"),
        F.col("p_type").alias("license"),
        F.concat(F.lit("P"), F.col("p_size") % 4).alias("priority"),
        F.concat(
            F.element_at(F.array(F.lit("https://"), F.lit("s3://"), F.lit("ftp://")), (F.col("p_size") % 3 + 1).cast("int")),
            F.replace("p_name", F.lit(" "), F.lit("/")),
        ).alias("download_url"),
        F.col("p_retailprice").alias("price"),
    )


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with five measures of their order lines.

    Means come from whole hundredths, whose sums do not depend on the order of rows.
    """

    def mean_of_hundredths(column: str):
        return F.sum(F.round(F.col(column) * 100).cast("long")).cast("double") / F.count(F.lit(1))

    measures = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(
            mean_of_hundredths("l_discount").alias("validation_loss"),
            F.round(F.sum("l_quantity"), 6).alias("tokens_per_second_per_gpu"),
            F.round(F.sum("l_extendedprice"), 2).alias("reasoning_score"),
            mean_of_hundredths("l_tax").alias("memory_gb_per_gpu"),
            F.count(F.lit(1)).cast("double").alias("stability_score"),
        )
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("family"))
    joined = parts.join(measures, parts.p_partkey == measures.l_partkey).drop("l_partkey")
    # Some parts were not measured by one of the criteria.
    return joined.withColumn("reasoning_score", F.expr("CASE WHEN p_partkey % 50 <> 7 THEN reasoning_score END"))


def modality_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables as one corpus: ``source, lang, modality, size``."""

    def part(name: str, source: str, lang: str, modality: str, size: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.expr(source).alias("source"),
            F.expr(lang).alias("lang"),
            F.lit(modality).alias("modality"),
            F.expr(f"CAST({size} AS DOUBLE)").alias("size"),
        )

    return (
        part("documents", "source", "lang", "pure_text", "n_chars")
        .unionByName(part("pages", "'web'", "'und'", "multimodal", "length(html)"))
        .unionByName(part("conversations", "'chat'", "'und'", "audio_speech", "length(text)"))
        .unionByName(part("embeddings", "concat('frames', label)", "'none'", "video_pretraining", "size(embedding)"))
        .unionByName(part("events", "event_type", "'none'", "vla", "length(props)"))
    )


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a rollout of its conversation's batch."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.expr("CASE WHEN (conv_id + turn) % 3 <> 0 THEN CAST(length(text) AS DOUBLE) / 1000 END").alias("reward"),
        F.expr("CASE WHEN role <> 'system' THEN length(text) > 200 END").alias("success"),
        F.col("text").alias("response"),
    )


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps: ``value`` is the loss, broken for errors; ``tokens`` comes from the properties."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        F.expr(
            "CASE event_type WHEN 'error' THEN CAST('NaN' AS DOUBLE) WHEN 'signup' THEN NULL ELSE value END"
        ).alias("loss"),
    )


def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text, and an answer without every fifth word and with every seventh one twice."""
    words = "split(text, ' ')"
    heard = f"transform({words}, (w, i) -> CASE WHEN i % 5 = 4 THEN '' WHEN i % 7 = 6 THEN concat(w, ' ', w) ELSE w END)"
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("reference"), F.expr(f"array_join(filter({heard}, w -> w <> ''), ' ')").alias("answer")
    )


def played_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of users over time, and some users once more later on: the whole series, or without some of its events."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    again = events.where("user_id % 10 = 0").selectExpr("user_id + 1000000 AS user_id", "ts + INTERVAL 3 DAYS AS ts", "event_id", "value")
    edited = events.where("user_id % 10 IN (0, 5) AND event_id % 23 <> 0").selectExpr(
        "user_id + 2000000 AS user_id", "ts + INTERVAL 5 HOURS AS ts", "event_id", "value"
    )
    return events.union(again).union(edited)

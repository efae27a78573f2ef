"""Stage gates, deployment envelopes, release gates and the run ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import config_table


def stage_gate_check(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Judges ``stage, gate, threshold`` against ``stage, metric, value``.

    The prefix of a gate gives its direction and is cut off to find the metric; a
    gate without prefix asks for equality. A metric that was not measured fails.
    """
    direction = F.regexp_extract("gate", "^(max|min)_", 1)
    named = gates.withColumn("direction", direction).withColumn("metric", F.regexp_replace("gate", "^(max|min)_", ""))
    value, limit = F.col("value"), F.col("threshold")
    passed = (
        F.when(F.col("direction") == "max", value <= limit)
        .when(F.col("direction") == "min", value >= limit)
        .otherwise(value == limit)
    )
    return named.join(metrics.select("stage", "metric", "value"), ["stage", "metric"], "left").select(
        "stage", "gate", "threshold", "value", F.coalesce(passed, F.lit(False)).alias("passed")
    )


@dataclass(frozen=True)
class Target:
    name: str
    runtime: str
    max_latency_ms: float
    max_memory_gb: float
    min_decode_tokens_per_second: float
    max_power_w: float | None = None


# Deployment envelopes, and the share of a limit assumed for a target nobody measured.
DEPLOYMENT_TARGETS = (
    Target("server-h100-vllm", "vllm", 180.0, 80.0, 80.0),
    Target("edge-orin", "tensorrt-llm", 450.0, 24.0, 18.0, 60.0),
    Target("cockpit-soc", "onnx-runtime", 700.0, 16.0, 12.0, 35.0),
)
ASSUMED_LATENCY, ASSUMED_MEMORY, ASSUMED_DECODE, ASSUMED_POWER = 0.9, 0.85, 1.1, 0.8
ASSUMED_POWER_LIMIT_W = 100.0


def targets_table(spark: SparkSession, targets: tuple[Target, ...] = DEPLOYMENT_TARGETS) -> DataFrame:
    limits = ("max_latency_ms", "max_memory_gb", "min_decode_tokens_per_second", "max_power_w")
    return config_table(
        spark,
        [(t.name, *(getattr(t, limit) for limit in limits)) for t in targets],
        {"target": "string", **{limit: "double" for limit in limits}},
    )


def envelope_check(targets: DataFrame, measured: DataFrame) -> DataFrame:
    """Issues of each target; ``measured`` has one row per measured target.

    A latency, memory or decode rate that a measurement leaves out is an issue.
    Power is only checked when the target limits it, and counts as zero when a
    measurement leaves it out.
    """
    was_measured = F.col("_measured").isNotNull()
    joined = targets.join(measured.withColumn("_measured", F.lit(True)), "target", "left")

    def value(name: str, assumed):
        return F.when(was_measured, F.col(name)).otherwise(assumed)

    filled = joined.withColumns(
        {
            "latency_ms": value("latency_ms", F.col("max_latency_ms") * ASSUMED_LATENCY),
            "memory_gb": value("memory_gb", F.col("max_memory_gb") * ASSUMED_MEMORY),
            "decode_tokens_per_second": value(
                "decode_tokens_per_second", F.col("min_decode_tokens_per_second") * ASSUMED_DECODE
            ),
            "power_w": value(
                "power_w", F.coalesce("max_power_w", F.lit(ASSUMED_POWER_LIMIT_W)) * ASSUMED_POWER
            ),
        }
    )

    def issue(name: str, limit: str, word: str):
        broken = F.col(name) > F.col(limit) if word == "exceeds" else F.col(name) < F.col(limit)
        text = F.concat(F.lit(f"{name} "), F.col(name).cast("string"), F.lit(f" {word} "), F.col(limit).cast("string"))
        if name == "power_w":
            return F.when(broken, text)
        return F.when(F.col(name).isNull(), F.lit(f"{name} was not measured")).when(broken, text)

    issues = F.concat_ws(
        "; ",
        issue("latency_ms", "max_latency_ms", "exceeds"),
        issue("memory_gb", "max_memory_gb", "exceeds"),
        issue("decode_tokens_per_second", "min_decode_tokens_per_second", "below"),
        issue("power_w", "max_power_w", "exceeds"),
    )
    return filled.select(
        "target",
        "latency_ms",
        "memory_gb",
        "decode_tokens_per_second",
        "power_w",
        issues.alias("issues"),
        (issues == "").alias("passed"),
    )


@dataclass(frozen=True)
class ReleaseGate:
    """``condition`` is a Spark SQL predicate over the columns in ``needs``."""

    name: str
    owner: str
    needs: tuple[str, ...]
    condition: str


# Names, owners and limits of the release gates.
RELEASE_GATES = (
    ReleaseGate(
        "data_license_and_privacy_approved",
        "data-governance",
        ("license_allowlist_passed", "pii_redaction_passed"),
        "license_allowlist_passed AND pii_redaction_passed",
    ),
    ReleaseGate(
        "data_scale_and_modalities_met",
        "data-platform",
        ("total_tb", "language_count", "modalities"),
        "total_tb >= 2500 AND language_count >= 20 AND size(array_except("
        "array('pure_text', 'multimodal', 'video_pretraining', 'audio_speech', 'vla'), split(modalities, ','))) = 0",
    ),
    ReleaseGate(
        "training_stability_met",
        "training-platform",
        ("nan_incidents", "gpu_utilization"),
        "nan_incidents = 0 AND gpu_utilization >= 0.88",
    ),
    ReleaseGate(
        "checkpoint_conversion_verified",
        "model-platform",
        ("target_format", "tokenizer_bundle_verified"),
        "target_format = 'hf-safetensors' AND tokenizer_bundle_verified",
    ),
    ReleaseGate("core_evaluation_passed", "evaluation-platform", ("core_gates_passed",), "core_gates_passed"),
    ReleaseGate(
        "multimodal_vla_evaluation_passed",
        "evaluation-platform",
        ("vla_success_rate", "agent_task_success"),
        "vla_success_rate >= 0.58 AND agent_task_success >= 0.50",
    ),
    ReleaseGate(
        "audio_speech_evaluation_passed",
        "evaluation-platform",
        ("wer", "cer", "accuracy"),
        "wer <= 0.18 AND cer <= 0.12 AND accuracy >= 0.75",
    ),
    ReleaseGate(
        "deployment_envelope_passed",
        "serving-platform",
        ("server_passed", "edge_passed"),
        "server_passed AND edge_passed",
    ),
    ReleaseGate(
        "safety_and_governance_signoff",
        "release",
        ("safety_approved", "privacy_approved", "release_approved", "rollback_approved"),
        "safety_approved AND privacy_approved AND release_approved AND rollback_approved",
    ),
)


def release_gates(evidence: DataFrame, gates: tuple[ReleaseGate, ...] = RELEASE_GATES) -> DataFrame:
    """``gate, owner, evidence_present, passed, blocked`` from rows of evidence.

    A gate whose evidence is missing, as a column or as a value, is blocked.
    """
    needed = {name for gate in gates for name in gate.needs}
    full = evidence.withColumns(
        {name: F.lit(None).cast("string") for name in needed if name not in evidence.columns}
    )
    verdicts = []
    for gate in gates:
        present = F.lit(True)
        for name in gate.needs:
            present = present & F.col(name).isNotNull()
        known = all(name in evidence.columns for name in gate.needs)
        holds = F.coalesce(F.expr(gate.condition), F.lit(False)) if known else F.lit(False)
        verdicts.append(
            F.struct(
                F.lit(gate.name).alias("gate"),
                F.lit(gate.owner).alias("owner"),
                present.alias("evidence_present"),
                holds.alias("passed"),
            )
        )
    return full.select(F.explode(F.array(*verdicts)).alias("v")).select(
        "v.gate", "v.owner", "v.evidence_present", "v.passed", (~F.col("v.passed")).alias("blocked")
    )


def release_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count(F.lit(1)).alias("gate_count"),
        F.count_if("passed").alias("ready"),
        F.count_if("blocked").alias("blocked"),
        F.when(F.bool_or("blocked"), "blocked").otherwise("ready_for_promotion").alias("status"),
    )


def run_ledger(events: DataFrame, order: str = "place") -> DataFrame:
    """Latest status of each run and its entries, later values of a key replacing earlier ones.

    ``events`` has ``run_id, status, entries`` (a map) and a sortable ``place``. Both
    steps are aggregates that shrink before the shuffle; what is left per run is one
    value per key.
    """
    latest = events.groupBy("run_id").agg(
        F.max_by("status", order).alias("status"),
        F.min(order).alias("_started"),
        F.count(F.lit(1)).alias("updates"),
    )
    merged = (
        events.select("run_id", F.col(order).alias("_order"), F.explode("entries").alias("key", "value"))
        .groupBy("run_id", "key")
        .agg(F.max_by("value", "_order").alias("value"))
        .groupBy("run_id")
        .agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    )
    return latest.join(merged, "run_id", "left").select(
        "run_id", "status", "updates", F.map_from_entries("pairs").alias("entries")
    )

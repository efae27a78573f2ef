"""Training and pipeline monitors: rewards, tokens, spikes, incidents, lag, service levels, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ordered import next_matching, running_sum, trailing_mean
from tallyforge.session import config_table

# Loss spike limit, lag limit, service levels.
LOSS_SPIKE_RATIO = 1.35
INGESTION_LAG_HOURS = 6.0
PIPELINE_SUCCESS = 0.995
RECOVERY_MINUTES = 30.0
FRESHNESS_HOURS = 24.0


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric: str
    op: str
    threshold: float
    severity: str


# Alert rules.
ALERT_RULES = (
    AlertRule("data_ingestion_lag", "data_ingestion_lag_hours", ">", 6.0, "warning"),
    AlertRule("data_quality_drop", "data_quality_score", "<", 0.82, "critical"),
    AlertRule("dedup_rate_spike", "duplicate_rate", ">", 0.18, "critical"),
    AlertRule("training_loss_spike", "loss_spike_ratio", ">", 1.35, "critical"),
    AlertRule("training_nan_detected", "nan_incidents", ">", 0.0, "critical"),
    AlertRule("gpu_utilization_low", "gpu_utilization", "<", 0.88, "warning"),
    AlertRule("moe_expert_imbalance", "expert_balance", "<", 0.80, "warning"),
    AlertRule("rl_kl_high", "rl_kl", ">", 0.12, "critical"),
    AlertRule("tool_error_rate_high", "tool_error_rate", ">", 0.08, "warning"),
    AlertRule("eval_gate_failed", "eval_gate_passed", "==", 0.0, "critical"),
    AlertRule("serving_latency_high", "prefill_latency_ms", ">", 180.0, "warning"),
    AlertRule("edge_power_high", "edge_power_w", ">", 60.0, "critical"),
    AlertRule("release_gate_blocked", "release_gate_blocked", ">", 0.0, "critical"),
)


def alert_table(spark: SparkSession, rules: tuple[AlertRule, ...] = ALERT_RULES) -> DataFrame:
    return config_table(
        spark,
        [(r.name, r.metric, r.op, r.threshold, r.severity) for r in rules],
        {"rule": "string", "metric": "string", "op": "string", "threshold": "double", "severity": "string"},
    )


def alert_rules(metrics: DataFrame, rules: tuple[AlertRule, ...] = ALERT_RULES) -> DataFrame:
    """Adds ``rule, severity, threshold, firing`` to rows with ``metric, value``.

    A metric without a rule drops out; the rule list is a fixed handful of rows.
    """
    value, limit = F.col("value"), F.col("threshold")
    firing = (
        F.when(F.col("op") == ">", value > limit)
        .when(F.col("op") == "<", value < limit)
        .when(F.col("op") == "==", value == limit)
    )
    joined = metrics.join(F.broadcast(alert_table(metrics.sparkSession, rules)), "metric")
    return joined.withColumn("firing", F.coalesce(firing, F.lit(False))).drop("op")


def reward(stated: Column, success: Column) -> Column:
    """The stated reward, else one for success (the default) and zero for failure."""
    return F.coalesce(stated.cast("double"), F.when(F.coalesce(success, F.lit(True)), 1.0).otherwise(0.0))


def reward_advantage(rollouts: DataFrame, batch: str = "batch") -> DataFrame:
    """Adds ``reward_value`` and ``advantage`` over the mean of the batch.

    Batch means are aggregated and joined back, so a batch of any size stays spread out.
    """
    rewarded = rollouts.withColumn("reward_value", reward(F.col("reward"), F.col("success")))
    means = rewarded.groupBy(batch).agg(F.avg("reward_value").alias("_mean"))
    return (
        rewarded.join(means, batch).withColumn("advantage", F.col("reward_value") - F.col("_mean")).drop("_mean")
    )


def rollout_monitor(rollouts: DataFrame, group: str, response: str = "response") -> DataFrame:
    """Rollouts, mean reward and response lengths in characters per group, for the reward gate and the length monitor.

    A missing response has no length; percentiles are exact, over the distinct lengths of a group.
    """
    length = F.length(response)
    return (
        rollouts.withColumn("reward_value", reward(F.col("reward"), F.col("success")))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("rollouts"),
            F.round(F.avg("reward_value"), 6).alias("mean_reward"),
            F.round(F.avg(length), 6).alias("mean_length"),
            F.round(F.percentile(length, 0.5), 6).alias("median_length"),
            F.round(F.percentile(length, 0.95), 6).alias("p95_length"),
        )
    )


def token_accounting(steps: DataFrame, stage: str, order: list[str], tokens: str) -> DataFrame:
    """Adds ``tokens_seen``, the running total of a stage."""
    return running_sum(steps, [stage], order, F.col(tokens), "tokens_seen")


def loss_spike_ratio(
    steps: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    rows: int = 10,
    limit: float = LOSS_SPIKE_RATIO,
) -> DataFrame:
    """Adds ``ratio`` of a value to the mean of the previous ``rows`` steps, and ``spike``."""
    trailed = trailing_mean(steps, keys, order, F.col(value), rows, "_trailing")
    ratio = F.try_divide(F.col(value), F.col("_trailing"))
    return (
        trailed.withColumn("ratio", ratio)
        .withColumn("spike", F.coalesce(F.col("ratio") > limit, F.lit(False)))
        .drop("_trailing")
    )


def nan_incidents(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Steps and how many of them have a null or non-finite value."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return steps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("steps"), F.count_if(bad).alias("nan_incidents")
    )


def ingestion_lag(
    records: DataFrame, source: str, ts: str, limit_hours: float = INGESTION_LAG_HOURS, now: Column | None = None
) -> DataFrame:
    """Hours from a source's last record to ``now``, by default the newest record of all.

    Give the present time, as in ``F.current_timestamp()``, to see all sources stall.
    """
    last = records.groupBy(source).agg(F.max(ts).alias("last_seen"))
    if now is None:
        now = last.agg(F.max("last_seen").alias("now")).scalar()
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3.6e9
    return last.select(source, F.round(hours, 6).alias("lag_hours"), (hours > limit_hours).alias("firing"))


def slo_report(
    events: DataFrame,
    source: str,
    order: list[str],
    ts: str,
    failed: Column,
    succeeded: Column,
) -> DataFrame:
    """Success share, age of the last success and slowest recovery per source, each against its level.

    ``order`` starts with ``ts``. A failure that never recovers has no recovery time and fails the level.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = events.select(
        source, *order, micros.alias("_at"), failed.alias("_failed"), succeeded.alias("_succeeded")
    )
    success_at = F.when(F.col("_succeeded"), F.col("_at"))
    followed = next_matching(timed, [source], order, success_at, "_next")
    wait = F.when(F.col("_failed"), (F.col("_next") - F.col("_at")) / 6e7)
    per_source = followed.groupBy(source).agg(
        F.count(F.lit(1)).alias("events"),
        (1 - F.count_if("_failed") / F.count(F.lit(1))).alias("success_share"),
        F.max(success_at).alias("_last_success"),
        F.max(wait).alias("recovery_minutes"),
        F.count_if(F.col("_failed") & F.col("_next").isNull()).alias("unrecovered"),
    )
    now = timed.agg(F.max("_at").alias("now")).scalar()
    age = (now - F.col("_last_success")) / 3.6e9
    return per_source.select(
        source,
        "events",
        F.round("success_share", 6).alias("success_share"),
        F.round(age, 6).alias("freshness_hours"),
        F.round("recovery_minutes", 6).alias("recovery_minutes"),
        "unrecovered",
        (F.col("success_share") >= PIPELINE_SUCCESS).alias("success_met"),
        F.coalesce(age <= FRESHNESS_HOURS, F.lit(False)).alias("freshness_met"),
        (
            (F.col("unrecovered") == 0) & (F.coalesce("recovery_minutes", F.lit(0.0)) <= RECOVERY_MINUTES)
        ).alias("recovery_met"),
    )

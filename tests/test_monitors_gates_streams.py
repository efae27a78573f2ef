"""Ordered operators against brute force with a hot key; monitors, gates and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import gates, monitors, ordered
from tallyforge.session import config_table
from tallyforge.streaming import split_late_rows, stream_files, stream_spike_state, stream_window_alerts


def steps(n=600):
    """Half of the rows belong to one key; times repeat."""
    random.seed(3)
    rows = []
    for i in range(n):
        key = "hot" if i % 2 else random.choice("abc")
        when = datetime(2024, 1, 1) + timedelta(minutes=random.randint(0, 600))
        rows.append((i, key, when, None if i % 31 == 0 else round(random.uniform(1, 9), 2)))
    return rows


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(steps(), "i long, k string, ts timestamp, v double").cache()


@pytest.mark.parametrize("key", ["one", None])
def test_one_key_in_one_hour_is_split(spark, key):
    rows = [(i, key, datetime(2024, 1, 1), 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp, v double")
    # A few rows would be put together into one block.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = ordered._in_blocks(df, ["k"], ["ts", "i"], F.col("v")).groupBy("_block").count().collect()
        assert len(blocks) > 1 and max(b["count"] for b in blocks) < 3000
        out = ordered.running_sum(df, ["k"], ["ts", "i"], F.col("v"), "s").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out) == 4000 and all(r.s == r.i + 1 for r in out)


def test_running_sum_and_numbers(frame):
    summed = ordered.running_sum(frame, ["k"], ["ts", "i"], F.coalesce("v", F.lit(0.0)), "s")
    numbered = ordered.row_numbers(summed, ["k"], ["ts", "i"], "n")
    out = {r.i: r for r in numbered.collect()}
    assert len(out) == 600
    for rows in by_key(steps()).values():
        total = 0.0
        for place, row in enumerate(rows, start=1):
            total += row[3] or 0.0
            assert out[row[0]].n == place and out[row[0]].s == pytest.approx(total)


@pytest.mark.parametrize("chunk_rows", [4, 7, 100, 10_000])
def test_trailing_mean(frame, chunk_rows):
    df = ordered.trailing_mean(frame, ["k"], ["ts", "i"], F.col("v"), 4, "m", chunk_rows)
    out = {r.i: r.m for r in df.collect()}
    assert len(out) == 600
    for rows in by_key(steps()).values():
        for place, row in enumerate(rows):
            before = [r[3] for r in rows[max(0, place - 4) : place] if r[3] is not None]
            expected = sum(before) / len(before) if before else None
            assert out[row[0]] == (None if expected is None else pytest.approx(expected))


def test_next_matching(frame):
    good = F.when(F.col("v") > 8, F.col("ts"))
    out = {r.i: r.n for r in ordered.next_matching(frame, ["k"], ["ts", "i"], good, "n").collect()}
    for rows in by_key(steps()).values():
        for place, row in enumerate(rows):
            later = [r[2] for r in rows[place + 1 :] if r[3] is not None and r[3] > 8]
            assert out[row[0]] == (min(later) if later else None)


def test_rewards(spark):
    df = spark.createDataFrame(
        [(1, "x", 0.5, None), (2, "x", None, True), (3, "x", None, False), (4, "y", None, None)],
        "i long, batch string, reward double, success boolean",
    )
    out = {r.i: (r.reward_value, r.advantage) for r in monitors.reward_advantage(df).collect()}
    assert out == {1: (0.5, 0.0), 2: (1.0, 0.5), 3: (0.0, -0.5), 4: (1.0, 0.0)}


def test_spikes_and_incidents(spark):
    rows = [(i, "k", datetime(2024, 1, 1, i), v) for i, v in enumerate([1.0, 1.0, 1.5, 0.0, 9.0])]
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp, v double")
    out = {r.i: (r.ratio, r.spike) for r in monitors.loss_spike_ratio(df, ["k"], ["ts", "i"], "v", rows=2).collect()}
    assert out == {0: (None, False), 1: (1.0, False), 2: (1.5, True), 3: (0.0, False), 4: (12.0, True)}
    odd = spark.createDataFrame([("k", x) for x in (1.0, None, float("nan"), float("inf"))], "k string, v double")
    row = monitors.nan_incidents(odd, ["k"], "v").first()
    assert (row.steps, row.nan_incidents) == (4, 3)


def test_alert_rules(spark):
    rows = [("rl_kl", 0.13), ("gpu_utilization", 0.9), ("eval_gate_passed", 0.0), ("nan_incidents", 0.0), ("other", 1.0)]
    df = config_table(spark, rows, {"metric": "string", "value": "double"})
    out = {r.rule: r.firing for r in monitors.alert_rules(df).collect()}
    assert out == {"rl_kl_high": True, "gpu_utilization_low": False, "eval_gate_failed": True, "training_nan_detected": False}
    assert len(monitors.ALERT_RULES) == 13


def test_stage_gates(spark):
    metrics = config_table(spark, [("s", "kl", 0.1), ("s", "world", 4.0)], {"stage": "string", "metric": "string", "value": "double"})
    limits = config_table(
        spark,
        [("s", "max_kl", 0.12), ("s", "min_kl", 0.12), ("s", "world", 4.0), ("s", "max_none", 1.0)],
        {"stage": "string", "gate": "string", "threshold": "double"},
    )
    out = {r.gate: r.passed for r in gates.stage_gate_check(metrics, limits).collect()}
    assert out == {"max_kl": True, "min_kl": False, "world": True, "max_none": False}


def test_envelopes(spark):
    columns = {"target": "string", "latency_ms": "double", "memory_gb": "double", "decode_tokens_per_second": "double", "power_w": "double"}
    measured = config_table(spark, [("server-h100-vllm", 200.0, 81.0, 79.5, 900.0), ("edge-orin", 10.0, 1.0, 20.0, None)], columns)
    silent = config_table(spark, [("edge-orin", None, 1.0, 20.0, None)], columns)
    row = gates.envelope_check(gates.targets_table(spark), silent).filter("target = 'edge-orin'").first()
    assert (row.issues, row.passed) == ("latency_ms was not measured", False)
    out = {r.target: r for r in gates.envelope_check(gates.targets_table(spark), measured).collect()}
    assert out["server-h100-vllm"].issues == (
        "latency_ms 200.0 exceeds 180.0; memory_gb 81.0 exceeds 80.0; decode_tokens_per_second 79.5 below 80.0"
    )
    assert out["edge-orin"].passed and out["cockpit-soc"].passed
    assert (out["cockpit-soc"].latency_ms, out["cockpit-soc"].power_w) == (630.0, 28.0)


def test_release_gates(spark):
    evidence = spark.range(1).select(
        F.lit(True).alias("license_allowlist_passed"),
        F.lit(True).alias("pii_redaction_passed"),
        F.lit(2835.0).alias("total_tb"),
        F.lit(25).alias("language_count"),
        F.lit("audio_speech,multimodal,pure_text,video_pretraining,vla").alias("modalities"),
        F.lit(None).cast("double").alias("nan_incidents"),
        F.lit(0.9).alias("gpu_utilization"),
        F.lit(0.1).alias("wer"),
        F.lit(0.2).alias("cer"),
        F.lit(0.8).alias("accuracy"),
    )
    verdicts = gates.release_gates(evidence)
    out = {r.gate: (r.evidence_present, r.passed) for r in verdicts.collect()}
    assert len(out) == 9
    assert out["data_license_and_privacy_approved"] == out["data_scale_and_modalities_met"] == (True, True)
    assert out["training_stability_met"] == (False, False)
    assert out["audio_speech_evaluation_passed"] == (True, False)
    assert out["core_evaluation_passed"] == (False, False)
    total = gates.release_summary(verdicts).first()
    assert (total.gate_count, total.ready, total.blocked, total.status) == (9, 2, 7, "blocked")


def test_run_ledger(spark):
    df = spark.createDataFrame(
        [("r", "started", {"a": "1", "b": "1"}, 1), ("r", "completed", {"b": "2"}, 3), ("r", "running", {"c": "9", "b": "x"}, 2), ("q", "started", {}, 1)],
        "run_id string, status string, entries map<string,string>, place long",
    )
    out = {r.run_id: (r.status, r.updates, r.entries) for r in gates.run_ledger(df).collect()}
    assert out == {"r": ("completed", 3, {"a": "1", "b": "2", "c": "9"}), "q": ("started", 1, None)}


def arrivals(spark, frame, folder, parts=4):
    """One file per quarter of the ids, so that later files hold rows of the past too."""
    for part in range(parts):
        frame.filter((F.col("i") >= part * 150) & (F.col("i") < (part + 1) * 150)).coalesce(1).write.mode("append").parquet(folder)
    return stream_files(spark, folder, "*.parquet", "ts", files_per_batch=1)


def test_spike_state_over_batches_of_ordered_time(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else "k", datetime(2024, 1, 1) + timedelta(minutes=i), float(i % 7 + 1)) for i in range(120)]
    df = spark.createDataFrame(rows, "i long, k string, ts timestamp, v double")
    folder = str(tmp_path / "in")
    for part in range(4):
        df.filter((F.col("i") >= part * 30) & (F.col("i") < (part + 1) * 30)).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_files(spark, folder, "*.parquet", "ts", files_per_batch=1)
    live = stream_spike_state(stream, ["k"], ["ts", "i"], "v", str(tmp_path / "state"), rows=5)
    batch = monitors.loss_spike_ratio(df, ["k"], ["ts", "i"], "v", rows=5)
    pick = lambda d: {r.i: (r.ratio and round(r.ratio, 9), r.spike) for r in d.collect()}
    assert pick(live) == pick(batch)
    assert len(list((tmp_path / "state" / "ratios").glob("batch=*"))) == 4


def test_late_rows_are_kept(spark, frame, tmp_path):
    timely, late = split_late_rows(arrivals(spark, frame, str(tmp_path / "in")), "ts", "30 MINUTES", str(tmp_path / "out"))
    rows = steps()
    seen, expected = None, set()
    for part in range(4):
        mine = [r for r in rows if part * 150 <= r[0] < (part + 1) * 150]
        expected |= {r[0] for r in mine if seen is not None and r[2] < seen - timedelta(minutes=30)}
        seen = max([r[2] for r in mine] + ([seen] if seen else []))
    assert {r.i for r in late.collect()} == expected and expected
    assert timely.count() + late.count() == len(rows)


def test_window_alerts_over_batches(spark, frame, tmp_path):
    stream = arrivals(spark, frame, str(tmp_path / "in"))
    metrics = {"nan_incidents": F.count_if(F.col("v").isNull()), "edge_power_w": F.sum("v")}
    # The delay covers the whole span, so that nothing counts as late here.
    alerts = stream_window_alerts(stream, "ts", metrics, str(tmp_path / "out"), "1 hour", watermark="1 day")
    out = {(r.window_start, r.metric): r.value for r in alerts.collect()}
    expected = {}
    for r in frame.groupBy(F.date_trunc("hour", "ts").alias("w")).agg(*[m.alias(n) for n, m in metrics.items()]).collect():
        expected[r.w, "nan_incidents"], expected[r.w, "edge_power_w"] = float(r.nan_incidents), pytest.approx(r.edge_power_w)
    assert out == expected

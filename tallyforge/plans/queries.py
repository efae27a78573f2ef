"""Registered queries: each reads the given tables, or data derived from them, as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import char_error_rate, word_error_rate
from tallyforge.functions.variant import text_of
from tallyforge.operators import catalog, corpus, evaluate, gates, monitors, ranking, records, series, snapshot
from tallyforge.operators.suite import Benchmark, benchmarks_table, gates_table
from tallyforge.plans import fixtures as fx
from tallyforge.plans.fixtures import table
from tallyforge.session import config_table, shared_dir, spread
from tallyforge.sources import (
    file_manifest,
    ingest_jsonl_records,
    last_prediction,
    read_eval_samples,
    read_predictions,
    write_transcripts,
)
from tallyforge.streaming import split_late_rows, stream_files, stream_sessions, stream_spike_state, stream_window_alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def digests(*columns: str):
    """Long texts are compared as a whole by digest, which keeps the result small."""
    return [F.md5(column).alias(column) for column in columns]


# --- records, samples, predictions -----------------------------------------------------------


@query("ingest_jsonl_records")
def _(spark, sf):
    line = F.expr(
        """CASE doc_id % 5
            WHEN 2 THEN to_json(CAST(text AS VARIANT))
            WHEN 3 THEN concat('{"text": ', replace(text, '\n', ' '))
            WHEN 4 THEN CASE WHEN lang = 'en' THEN '   ' ELSE CAST(n_chars AS STRING) END
            ELSE to_json(struct(doc_id, text, lang)) END"""
    )
    lines = spread(table(spark, sf, "documents")).select("doc_id", line.alias("value"))
    return records.map_record_text(ingest_jsonl_records(lines)).select("doc_id", "kind", *digests("text"))


@query("map_record_text")
def _(spark, sf):
    def as_records(name: str, key: str, body: str) -> DataFrame:
        return spread(table(spark, sf, name)).select(
            F.expr(key).alias("key"), F.expr(f"parse_json(to_json({body}))").alias("record")
        )

    rows = (
        as_records("documents", "concat('doc-', doc_id)", "struct(text, lang)")
        .unionByName(as_records("benchmark", "concat('item-', item_id)", "struct(text AS prompt, item_id AS response)"))
        .unionByName(as_records("pages", "concat('page-', page_id)", "struct(url AS instruction, html AS output)"))
        .unionByName(
            as_records(
                "conversations",
                "concat('turn-', conv_id, '-', turn)",
                "struct(array(struct(role, text AS content), struct(CAST(NULL AS STRING) AS role, text AS content)) AS messages)",
            )
        )
        .unionByName(
            as_records(
                "events",
                "concat('event-', event_id)",
                "struct(struct(user_id, event_type, array(event_type, 'a, b: c') AS steps) AS trajectory)",
            )
        )
        .unionByName(as_records("labels", "concat('label-', doc_id)", "struct(toxic, doc_id, quality)"))
    )
    return records.map_record_text(rows).select("key", *digests("text"))


@query("map_prompt_reference")
def _(spark, sf):
    body = F.expr(
        """CASE role
            WHEN 'user' THEN to_json(struct(concat('turn-', conv_id, '-', turn) AS sample_id, '' AS prompt,
                text AS question, role AS target))
            WHEN 'assistant' THEN to_json(struct(0 AS question, text AS input, conv_id AS gold, role AS expected))
            ELSE to_json(struct(role, turn)) END"""
    )
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line_index"), F.parse_json(body).alias("payload")
    )
    mapped = records.map_prompt_reference(rows, F.lit("bench"), F.col("line_index"))
    return mapped.select("line_index", "id", *digests("prompt"), F.expr(text_of("reference")).alias("reference"))


@query("map_prediction")
def _(spark, sf):
    body = F.expr(
        """CASE role
            WHEN 'user' THEN to_json(struct(text AS model_output, 'x' AS output))
            WHEN 'assistant' THEN to_json(struct(text AS output, role AS response))
            ELSE to_json(struct(role, turn)) END"""
    )
    output = F.expr(
        """CASE role
            WHEN 'user' THEN to_json(struct(text AS output, role AS answer))
            WHEN 'assistant' THEN text
            ELSE to_json(struct(role, turn)) END"""
    )
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.parse_json(body).alias("payload"), output.alias("output")
    )
    return records.map_prediction(rows).select(
        "conv_id", "turn", *digests("sample_prediction", "model_prediction")
    )


@query("read_eval_samples")
def _(spark, sf):
    folder = shared_dir(spark, "samples")
    docs = table(spark, sf, "documents")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("doc-"), "doc_id").alias("id"),
            F.when(F.col("lang") != "en", F.concat(F.lit("core_"), "lang")).alias("benchmark"),
            F.col("source").alias("dataset"),
            F.col("text").alias("prompt"),
            F.col("lang").alias("answer"),
        )
    )
    stem = F.when(F.col("lang") == "en", "core_en.jsonl").when(F.col("lang") == "de", "Core, German +1.jsonl")
    docs.select(stem.otherwise("mixed.jsonl").alias("file"), body.alias("value")).write.partitionBy("file").text(folder)
    # A file that is not JSON Lines lies among them.
    docs.select(F.concat(F.lit("# "), "source").alias("value")).write.text(f"{folder}/file=README.md")
    suite = [
        Benchmark("Core, German +1", "languages"),
        Benchmark("core_en", "general"),
        Benchmark("core_fr", "reasoning"),
        Benchmark("by_dataset", "reasoning", ("src1", "src2")),
        Benchmark("Empty One", "vla", ("nowhere",)),
    ]
    samples = read_eval_samples(spark, folder, suite)
    return samples.select("id", "benchmark", "dataset", *digests("prompt"), F.expr(text_of("reference")).alias("reference"))


@query("read_predictions")
def _(spark, sf):
    folder = shared_dir(spark, "predictions")
    rows = fx.label_predictions(spark, sf)
    line = F.when(F.col("place") == 0, F.to_json(F.struct(F.col("id").alias("sample_id"), F.col("prediction").alias("response")))).otherwise(
        F.to_json(F.struct("id", "prediction"))
    )
    (
        rows.repartitionByRange(4, "doc_id")
        .sortWithinPartitions("doc_id", "place")
        .select(line.alias("value"))
        .write.text(folder)
    )
    read = read_predictions(spark, folder).select("id", F.expr(text_of("prediction")).alias("prediction"))
    return read.select("id", *digests("prediction"))


@query("conversation_to_text")
def _(spark, sf):
    texts = records.conversation_to_text(table(spark, sf, "conversations"))
    return texts.select("conv_id", "turns", *digests("text"))


@query("write_transcripts")
def _(spark, sf):
    samples = evaluate.join_predictions(fx.answer_samples(spark, sf))
    return write_transcripts(samples, shared_dir(spark, "transcripts"))


@query("file_manifest")
def _(spark, sf):
    return file_manifest(spark, sf, "*.parquet")


@query("byte_tokenize")
def _(spark, sf):
    tokens = records.byte_tokenize(spread(table(spark, sf, "documents")), seq_len=512)
    place = F.transform("input_ids", lambda t, i: t.cast("long") * (i + 1))
    return tokens.select(
        "doc_id",
        F.size("input_ids").cast("long").alias("length"),
        F.size(F.filter("labels", lambda t: t != records.IGNORED_LABEL)).cast("long").alias("tokens"),
        F.aggregate(place, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"),
        F.element_at("input_ids", -1).cast("long").alias("last_id"),
    )


# --- sources, plans, lineage -----------------------------------------------------------------

PLAN_STAGES = [
    corpus.Stage("ingest", ("schema_mapping", "hash_indexing"), "raw_shards"),
    corpus.Stage("assess", ("quality_score",), "ranked_pool", "model-quality"),
]


@query("lineage_ledger")
def _(spark, sf):
    return corpus.lineage_ledger(table(spark, sf, "documents"), PLAN_STAGES)


@query("source_join_license")
def _(spark, sf):
    flagged = table(spark, sf, "documents").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi")
    ledger = fx.source_ledger(spark, sf).join(flagged.select("source").distinct(), "source", "left_semi")
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return corpus.source_join_license(docs, ledger.select("source", "source_type", "license"))


@query("license_allowlist")
def _(spark, sf):
    return corpus.license_allowlist(fx.source_ledger(spark, sf).select("source", "license"))


@query("duplicate_rate_by_source")
def _(spark, sf):
    return corpus.duplicate_rate_by_source(corpus.source_measures(table(spark, sf, "documents")))


@query("source_quality_gate")
def _(spark, sf):
    measures = corpus.source_measures(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return corpus.source_quality_gate(measures)


@query("size_by_modality")
def _(spark, sf):
    return corpus.size_by_modality(fx.source_ledger(spark, sf))


@query("mixture_plan")
def _(spark, sf):
    def shares(targets: dict[str, float]):
        return F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])

    modality = {"pure_text": 0.69, "multimodal": 0.16, "video_pretraining": 0.08, "audio_speech": 0.03, "vla": 0.04}
    stages = fx.source_ledger(spark, sf).select(
        F.col("source").alias("name"),
        F.col("size").alias("total"),
        shares(modality).alias("modality_targets"),
        shares({"en": 0.38, "zh": 0.24, "other": 0.38}).alias("language_targets"),
    )
    return corpus.mixture_plan(stages)


@query("risk_counts")
def _(spark, sf):
    text = F.col("text")
    marks = F.array_compact(
        F.array(
            F.when(F.contains(text, F.lit("@")), "pii"),
            F.when(F.contains(text, F.lit("token = ")), "secrets"),
            F.when(F.contains(text, F.lit("icense")), "mixed-license"),
        )
    )
    return corpus.risk_counts(table(spark, sf, "documents").select(marks.alias("risks")))


@query("corpus_summary")
def _(spark, sf):
    return corpus.corpus_summary(fx.modality_pool(spark, sf))


@query("scale_gates")
def _(spark, sf):
    return corpus.scale_gates(corpus.corpus_summary(fx.modality_pool(spark, sf)), 1e6, 20)


# --- catalogue -------------------------------------------------------------------------------

CATALOG_RULES = [
    catalog.Rule("license", "type", "int"),
    catalog.Rule("price", "minimum", 950),
    catalog.Rule("price", "above", 1000),
    catalog.Rule("priority", "allowed", ("P0", "P1", "P2")),
    catalog.Rule("download_url", "prefix", ("https://", "http://", "s3://", "gs://")),
    catalog.Rule("family", "not_empty"),
    catalog.Rule("name", "required"),
]


@query("validate_rules")
def _(spark, sf):
    return catalog.validate_rules(fx.part_catalog(spark, sf), "position", CATALOG_RULES)


@query("required_coverage")
def _(spark, sf):
    return catalog.required_coverage(table(spark, sf, "documents"), "lang", ["en", "fr", "zh", "ja", "de"])


@query("duplicate_keys")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return catalog.duplicate_keys(orders, ["o_custkey", "o_orderpriority"], "o_orderkey")


@query("probability_map_check")
def _(spark, sf):
    counts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("user_id").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("event_type", "n")).alias("kinds")
    )
    share = lambda e: F.struct(e["event_type"], F.round(e["n"] / F.col("total") - 0.15, 2))
    weights = F.map_from_entries(F.transform("kinds", share))
    return catalog.probability_map_check(listed.select("user_id", weights.alias("weights")), "user_id", "weights")


@query("catalog_filter")
def _(spark, sf):
    picked = catalog.catalog_filter(fx.part_catalog(spark, sf), license="ECONOMY", modality=None, modalities="ring", priority="P1")
    return picked.select("position", "name", "family", "price")


@query("catalog_facets")
def _(spark, sf):
    return catalog.catalog_facets(fx.part_catalog(spark, sf), ["family", "license", "priority", "modalities"])


@query("catalog_listing")
def _(spark, sf):
    return catalog.catalog_listing(fx.part_catalog(spark, sf), ["priority", "family", "name"])


NEEDLES = {
    "contact": ("@", "+1 ("),
    "license": ("license", "licence", "copyright"),
    "secret": ("token =", "password"),
    "never": ("zq-never-zq",),
}


@query("keyword_tag")
def _(spark, sf):
    return catalog.keyword_tag(spread(table(spark, sf, "documents")), "doc_id", "text", NEEDLES)


@query("keyword_coverage")
def _(spark, sf):
    return catalog.keyword_coverage(spread(table(spark, sf, "documents")), "text", NEEDLES)


@query("minmax_utility_rank")
def _(spark, sf):
    ranked = ranking.minmax_utility_rank(fx.part_entities(spark, sf), ranking.ARCHITECTURE_CRITERIA, "p_partkey")
    return ranked.select("p_partkey", "family", "utility_score", "rank")


@query("top_k")
def _(spark, sf):
    best = ranking.top_k(fx.part_entities(spark, sf), ranking.ARCHITECTURE_CRITERIA, "p_partkey", 10)
    return best.select("p_partkey", "family", "utility_score")


# --- evaluation ------------------------------------------------------------------------------


def scored_answers(spark, sf, suite=None):
    return evaluate.score_samples(evaluate.join_predictions(fx.answer_samples(spark, sf)), suite)


def scored_tools(spark, sf):
    return evaluate.score_samples(evaluate.join_predictions(fx.tool_samples(spark, sf)))


def metric_rows(scored: DataFrame, metrics: tuple[str, ...], decimals: int = 6) -> DataFrame:
    """``id, metric, value`` for several metrics of one scan."""
    values = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.round(evaluate.metric_value(m), decimals).alias("value"))
            for m in metrics
        ]
    )
    return scored.select("id", F.explode(values).alias("m")).select("id", "m.metric", "m.value")


@query("join_predictions")
def _(spark, sf):
    predictions = last_prediction(fx.label_predictions(spark, sf))
    joined = evaluate.join_predictions(fx.answer_samples(spark, sf), predictions)
    shown = joined.select("id", F.expr(text_of("prediction")).alias("prediction"))
    return shown.select("id", *digests("prediction"))


@query("exact_match")
def _(spark, sf):
    both = fx.answer_samples(spark, sf).drop("doc_id").unionByName(fx.choice_samples(spark, sf).drop("doc_id"))
    return evaluate.sample_metric(evaluate.score_samples(evaluate.join_predictions(both)), "exact_match")


@query("token_f1")
def _(spark, sf):
    return evaluate.sample_metric(scored_answers(spark, sf), "f1")


@query("proxy_metric")
def _(spark, sf):
    return evaluate.sample_metric(scored_answers(spark, sf), "consensus_pass")


@query("calibration_error")
def _(spark, sf):
    return evaluate.sample_metric(scored_answers(spark, sf), "calibration_error")


@query("schema_validity")
def _(spark, sf):
    return evaluate.sample_metric(scored_tools(spark, sf), "schema_validity")


@query("success_rate")
def _(spark, sf):
    return metric_rows(scored_answers(spark, sf), ("success_rate", "recovery_rate", "task_success"))


@query("tool_error_rate")
def _(spark, sf):
    return evaluate.sample_metric(scored_tools(spark, sf), "tool_error_rate")


@query("unsafe_action_rate")
def _(spark, sf):
    return evaluate.sample_metric(scored_answers(spark, sf), "unsafe_action_rate")


@query("collision_free_rate")
def _(spark, sf):
    return evaluate.sample_metric(scored_answers(spark, sf), "collision_free_rate")


@query("action_l2")
def _(spark, sf):
    scored = evaluate.score_samples(evaluate.join_predictions(fx.action_samples(spark, sf)))
    return scored.select("id", F.round("action_l2", 6).alias("value"), F.col("action_valid").alias("valid"))


@query("system_metrics")
def _(spark, sf):
    metrics = ("steps_to_success", "cost_per_success", "frame_action_latency_ms", "prefill_ms")
    rows = metric_rows(scored_answers(spark, sf), metrics)
    return rows.groupBy("metric").agg(
        F.count("value").alias("measured"),
        F.round(F.sum("value"), 3).alias("total"),
        evaluate.mean4(F.sum("value"), F.count("value")).alias("mean"),
    )


@query("generic_metric")
def _(spark, sf):
    return metric_rows(scored_answers(spark, sf), ("wer", "mos", "bleu"))


@query("numeric_lookup")
def _(spark, sf):
    scored = scored_answers(spark, sf)
    values = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.round(F.expr(evaluate.numeric_lookup(m)), 6).alias("value"))
            for m in ("memory_gb", "power_w", "success")
        ]
    )
    return scored.select("id", F.explode(values).alias("m")).select("id", "m.metric", "m.value")


@query("macro_average")
def _(spark, sf):
    return evaluate.macro_average(scored_answers(spark, sf))


def answers_scorecard(spark, sf):
    return evaluate.benchmark_scorecard(scored_answers(spark, sf, fx.SUITE), fx.SUITE)


@query("gate_evaluate")
def _(spark, sf):
    return evaluate.gate_evaluate(answers_scorecard(spark, sf), gates_table(spark, fx.SUITE))


@query("benchmark_scorecard")
def _(spark, sf):
    return answers_scorecard(spark, sf)


@query("eval_report")
def _(spark, sf):
    suite = [
        *fx.SUITE,
        Benchmark("core_it", "general", (), ("accuracy",), 1.0, {"accuracy": 0.5}),
        Benchmark("core_pt", "reasoning"),
    ]
    card = evaluate.benchmark_scorecard(scored_answers(spark, sf, suite), suite)
    results = evaluate.evaluation_results(card, gates_table(spark, suite), benchmarks_table(spark, suite))
    return evaluate.eval_report(results)


def measured_benchmarks(spark, sf):
    """Documents per source and language, read as benchmarks with a weight."""
    return (
        table(spark, sf, "documents")
        .groupBy(F.col("source").alias("benchmark"), F.col("lang").alias("dimension"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


@query("dimension_weights")
def _(spark, sf):
    return evaluate.dimension_weights(measured_benchmarks(spark, sf))


@query("benchmark_select")
def _(spark, sf):
    return evaluate.benchmark_select(measured_benchmarks(spark, sf), ["src3", "fr"])


@query("batch_score")
def _(spark, sf):
    def load_word_counter():
        """Answers with a word count and refuses texts with an address in them."""
        import json

        def score(payloads: list[str]) -> list[str]:
            answers = []
            for payload in payloads:
                text = json.loads(payload)["answer"]
                if "@" in text:
                    raise ValueError("address")
                answers.append(json.dumps({"output": f"{text.count(' ') + 1} words"}))
            return answers

        return score

    answers = evaluate.batch_score(fx.answer_samples(spark, sf), load_word_counter)
    return answers.select("id", F.expr(text_of("prediction")).alias("prediction"))


@query("custom_evaluator")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("  "), F.upper("role")).alias("prompt"),
        F.concat_ws(" ", "role", "text").alias("response"),
    )
    pages = table(spark, sf, "pages").select(
        F.col("page_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), F.lit("SPAM-farm ").alias("prompt"),
        F.col("url").alias("response"),
    )
    evaluated = evaluate.custom_evaluator(turns.unionByName(pages))
    return evaluated.select("conv_id", "turn", "contains_prompt", "response_length")


@query("compare_runs")
def _(spark, sf):
    predictions = last_prediction(fx.label_predictions(spark, sf))
    other = evaluate.score_samples(evaluate.join_predictions(fx.answer_samples(spark, sf), predictions), fx.SUITE)
    candidate = evaluate.benchmark_scorecard(other, fx.SUITE)
    return evaluate.compare_runs(answers_scorecard(spark, sf), candidate)


@query("word_error_rate")
def _(spark, sf):
    rate = word_error_rate(F.col("reference"), F.col("answer"))
    return fx.transcript_pairs(spark, sf).select("item_id", F.round(rate, 6).alias("wer"))


@query("char_error_rate")
def _(spark, sf):
    rate = char_error_rate(F.col("reference"), F.col("answer"))
    return fx.transcript_pairs(spark, sf).select("item_id", F.round(rate, 6).alias("cer"))


# --- rewards, monitors, gates, ledgers -------------------------------------------------------


@query("reward_advantage")
def _(spark, sf):
    rows = monitors.reward_advantage(fx.rollouts(spark, sf), "conv_id")
    return rows.select(
        "conv_id", "turn", F.round("reward_value", 6).alias("reward_value"), F.round("advantage", 6).alias("advantage")
    )


@query("rollout_monitor")
def _(spark, sf):
    return monitors.rollout_monitor(fx.rollouts(spark, sf), "role")


@query("token_accounting")
def _(spark, sf):
    steps = fx.step_metrics(spark, sf).select("event_id", "ts", "event_type", "tokens")
    counted = monitors.token_accounting(steps, "event_type", ["ts", "event_id"], "tokens")
    return counted.select("event_id", "event_type", "tokens", F.col("tokens_seen").cast("long").alias("tokens_seen"))


@query("loss_spike_ratio")
def _(spark, sf):
    steps = fx.step_metrics(spark, sf).select("event_id", "ts", "user_id", "value")
    judged = monitors.loss_spike_ratio(steps, ["user_id"], ["ts", "event_id"], "value")
    return judged.select("event_id", "user_id", F.round("ratio", 6).alias("ratio"), "spike")


@query("nan_incidents")
def _(spark, sf):
    return monitors.nan_incidents(fx.step_metrics(spark, sf), ["user_id"], "loss")


def daily_metrics(spark, sf):
    """A wide day of metrics, then one row per metric."""
    steps = fx.step_metrics(spark, sf)
    day = F.date_trunc("day", "ts")
    wide = steps.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(
        F.round(24 - F.max(F.hour("ts") + F.minute("ts") / 60), 6).alias("data_ingestion_lag_hours"),
        F.round(F.count_if(F.col("event_type") == "error") / F.count(F.lit(1)), 6).alias("tool_error_rate"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("nan_incidents"),
        F.round(F.avg("tokens") / 100, 6).alias("gpu_utilization"),
        F.round(F.max("value") / F.avg("value"), 6).alias("loss_spike_ratio"),
        F.max(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("eval_gate_passed"),
        F.round(F.max("value"), 6).alias("edge_power_w"),
        F.round(F.avg("value"), 6).alias("unruled_metric"),
    )
    names = [c for c in wide.columns if c != "day"]
    return wide.unpivot(["day"], names, "metric", "value")


@query("alert_rules")
def _(spark, sf):
    return monitors.alert_rules(daily_metrics(spark, sf)).select(
        "day", "rule", "metric", "value", "threshold", "severity", "firing"
    )


@query("ingestion_lag")
def _(spark, sf):
    return monitors.ingestion_lag(table(spark, sf, "events"), "user_id", "ts")


@query("slo_report")
def _(spark, sf):
    kind = F.col("event_type")
    return monitors.slo_report(
        table(spark, sf, "events"), "user_id", ["ts", "event_id"], "ts", kind == "error", kind == "purchase"
    )


@query("stage_gate_check")
def _(spark, sf):
    steps = fx.step_metrics(spark, sf)
    wide = steps.groupBy(F.col("event_type").alias("stage")).agg(
        F.round(F.max("value") / F.avg("value"), 6).alias("loss_spike_ratio"),
        F.count_if(F.col("loss").isNull() | F.isnan("loss")).cast("double").alias("nan_incidents"),
        F.round(F.avg("tokens") / 100, 6).alias("gpu_utilization"),
    )
    metrics = wide.unpivot(["stage"], ["loss_spike_ratio", "nan_incidents", "gpu_utilization"], "metric", "value")
    limits = {
        "max_loss_spike_ratio": 12.0,
        "max_nan_incidents": 0.0,
        "min_gpu_utilization": 0.48,
        "max_kl": 0.12,
        "nan_incidents": 0.0,
    }
    listed = F.array(*[F.struct(F.lit(gate).alias("gate"), F.lit(limit).alias("threshold")) for gate, limit in limits.items()])
    every_stage = wide.select("stage", F.explode(listed).alias("g")).select("stage", "g.gate", "g.threshold")
    return gates.stage_gate_check(metrics, every_stage)


@query("envelope_check")
def envelopes(spark, sf):
    measured = (
        table(spark, sf, "events")
        .withColumn(
            "target",
            F.expr("CASE event_type WHEN 'error' THEN 'edge-orin' WHEN 'purchase' THEN 'cockpit-soc' ELSE 'other' END"),
        )
        .groupBy("target")
        .agg(
            F.round(F.max("value"), 4).alias("latency_ms"),
            F.when(F.min("event_type") != "error", F.round(F.avg("value") / 2, 4)).alias("memory_gb"),
            F.round(F.avg(F.get_json_object("props", "$.k").cast("double")) / 4, 4).alias("decode_tokens_per_second"),
            F.round(F.avg("value"), 4).alias("power_w"),
        )
    )
    return gates.envelope_check(gates.targets_table(spark), measured)


CHARS_PER_TB = 1e12


@query("release_gates")
def _(spark, sf):
    """Evidence as the operators measure it; what nothing here measures is left out and blocks its gate."""
    summary = corpus.corpus_summary(fx.modality_pool(spark, sf))
    sources = corpus.license_allowlist(fx.source_ledger(spark, sf))
    steps = fx.step_metrics(spark, sf)
    incidents = monitors.nan_incidents(steps, ["event_type"], "loss")
    scores = answers_scorecard(spark, sf)
    judged = evaluate.gate_evaluate(scores, gates_table(spark, fx.SUITE))
    checked = envelopes(spark, sf)

    def passed(target: str):
        return checked.filter(F.col("target") == target).agg(F.bool_and("passed").alias("x")).scalar()

    evidence = summary.select(
        (F.col("total_size") / CHARS_PER_TB).alias("total_tb"),
        "language_count",
        "modalities",
        sources.agg(F.bool_and("license_allowlist_passed").alias("x")).scalar().alias("license_allowlist_passed"),
        incidents.agg(F.sum("nan_incidents").alias("x")).scalar().alias("nan_incidents"),
        steps.agg((F.avg("tokens") / 100).alias("x")).scalar().alias("gpu_utilization"),
        judged.agg(F.bool_and("gate_passed").alias("x")).scalar().alias("core_gates_passed"),
        scores.filter("dimension = 'vla' AND metric = 'success_rate'").agg(F.min("value").alias("x")).scalar().alias("vla_success_rate"),
        passed("server-h100-vllm").alias("server_passed"),
        passed("edge-orin").alias("edge_passed"),
    )
    return gates.release_gates(evidence)


@query("run_ledger")
def _(spark, sf):
    status = F.expr("CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END")
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        status.alias("status"),
        F.create_map("event_type", "value").alias("entries"),
        F.struct("ts", "event_id").alias("place"),
    )
    pairs = F.transform(F.map_entries("entries"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return gates.run_ledger(events).select("run_id", "status", "updates", F.array_join(pairs, ",").alias("entries"))


# --- series ----------------------------------------------------------------------------------


@query("activity_segments")
def _(spark, sf):
    found = series.activity_segments(table(spark, sf, "events"), ["user_id"], "ts", "event_id", "value", 60.0, 10_800, 3_600)
    rounded = [F.round(c, 6).alias(c) for c in ("start", "end", "total", "peak")]
    return found.select("user_id", "rows", *rounded)


@query("action_space_normalize")
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    scaled = series.normalize_by_quantiles(events, ["event_type"], "value")
    return scaled.select("event_id", "event_type", F.round("scaled", 9).alias("scaled"))


@query("series_fingerprint_dedup")
def _(spark, sf):
    return series.repeated_series(fx.played_series(spark, sf), "user_id", "ts", "event_id", "value")


def document_branches(docs):
    return snapshot.branch_digests(docs, F.col("source"), [F.col(c) for c in ("doc_id", "text", "lang")], F.length("text"))


@query("manifest_snapshot")
def _(spark, sf):
    return snapshot.manifest_snapshot(document_branches(table(spark, sf, "documents")))


@query("manifest_changes")
def _(spark, sf):
    """Branches that differ once some texts are edited, and rows whose text is empty are gone."""
    docs = table(spark, sf, "documents")
    edited = docs.where("length(text) > 20").withColumn("text", F.expr("CASE WHEN doc_id % 97 = 5 THEN concat(text, '!') ELSE text END"))
    return snapshot.changed_branches(document_branches(docs), document_branches(edited))


# --- streams ---------------------------------------------------------------------------------


def event_stream(spark, sf):
    return stream_files(spark, sf, "events.parquet", "ts")


def _window_alerts(spark, sf, window, slide):
    is_error = F.col("event_type") == "error"
    metrics = {
        "tool_error_rate": F.round(F.avg(F.when(is_error, 1.0).otherwise(0.0)), 6),
        "nan_incidents": F.count_if(is_error),
        "edge_power_w": F.max("value"),
    }
    alerts = stream_window_alerts(
        event_stream(spark, sf), "ts", metrics, shared_dir(spark, "alerts"), window, slide
    )
    return alerts.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "rule", "value", "severity", "firing"
    )


@query("stream_window_alerts")
def _(spark, sf):
    return _window_alerts(spark, sf, "1 day", None)


@query("stream_sliding_alerts")
def _(spark, sf):
    return _window_alerts(spark, sf, "2 days", "1 day")


@query("stream_spike_state")
def _(spark, sf):
    steps = event_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    judged = stream_spike_state(steps, ["user_id"], ["ts", "event_id"], "value", shared_dir(spark, "spikes"))
    return judged.select("event_id", "user_id", F.round("ratio", 6).alias("ratio"), "spike")


@query("stream_sessions")
def _(spark, sf):
    """All sessions, and whether the watermark has not yet closed them by the end of the table."""
    sessions = stream_sessions(event_stream(spark, sf), "ts", "user_id", shared_dir(spark, "sessions"))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("session_start", "session_end")]
    return sessions.select("user_id", *shown, "events", "open")


@query("stream_late_audit")
def _(spark, sf):
    """Events arrive in five lots over the whole time, so each later lot holds rows of the past."""
    arrivals, folder = shared_dir(spark, "arrivals"), shared_dir(spark, "late")
    events = table(spark, sf, "events")
    for lot in range(5):
        events.filter(F.pmod("event_id", F.lit(5)) == lot).write.mode("append").parquet(arrivals)
        timely, late = split_late_rows(stream_files(spark, arrivals, "*.parquet", "ts"), "ts", "1 HOUR", folder)
    both = timely.withColumn("route", F.lit("timely")).unionByName(late.withColumn("route", F.lit("late")))
    return both.groupBy("route", "event_type").agg(F.count(F.lit(1)).alias("rows"))

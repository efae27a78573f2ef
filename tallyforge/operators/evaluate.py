"""Scores of predictions against references, per sample and per benchmark.

Samples carry ``id, benchmark, dataset, prompt, reference, payload`` with VARIANT
``reference`` and ``payload``. All per-sample values come from one projection;
all benchmark values from one grouped pass over it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import lower_is_better, mean4, number_of, vector_of
from tallyforge.functions.text import normalized_words, words_f1
from tallyforge.functions.variant import (
    bind,
    element_text,
    entries,
    field,
    items,
    kind,
    object_of,
    references_of,
    text_of,
    truthy,
)
from tallyforge.operators.records import model_prediction, sample_prediction
from tallyforge.operators.suite import Benchmark, benchmarks_table, suite_metrics

# Families of metric names that share a rule.
EXACT_METRICS = ("accuracy", "exact_match", "pass_at_1")
F1_METRICS = ("f1", "ocr_f1")
PROXY_METRICS = (
    "consensus_pass",
    "verified_solution_rate",
    "temporal_reasoning",
    "long_range_consistency",
    "citation_precision",
)
SUCCESS_FIELDS = {"task_success": "success", "success_rate": "success", "recovery_rate": "recovered"}
SYSTEM_METRICS = {
    "steps_to_success": ("steps_to_success", "steps"),
    "cost_per_success": ("cost_per_success", "cost"),
    "prefill_ms": ("prefill_ms", "ttft_ms"),
    "decode_tok_s": ("decode_tok_s", "tokens_per_second"),
    "memory_gb": ("memory_gb", "peak_memory_gb"),
    "power_w": ("power_w", "power_watts"),
    "frame_action_latency_ms": ("frame_action_latency_ms", "latency_ms"),
}


# --- predictions -----------------------------------------------------------------------------


def join_predictions(samples: DataFrame, predictions: DataFrame | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Adds ``prediction``: the prediction table first, then the scorer, then the sample itself.

    ``predictions`` and ``scored`` hold one row per id. A scorer replaces the
    sample's own fields, so with ``scored`` given those are not read.
    """
    sources = []
    if predictions is not None:
        samples = samples.join(predictions.select("id", F.col("prediction").alias("_given")), "id", "left")
        sources.append(F.col("_given"))
    if scored is not None:
        samples = samples.join(scored.select("id", F.col("prediction").alias("_scored")), "id", "left")
        sources.append(F.col("_scored"))
    else:
        sources.append(F.expr(sample_prediction("payload")))
    return samples.withColumn("prediction", F.coalesce(*sources)).drop("_given", "_scored")


Scorer = Callable[[list[str]], list[str]]


def batch_score(samples: DataFrame, load_scorer: Callable[[], Scorer]) -> DataFrame:
    """``id, prediction`` from a Python scorer that takes payload JSON texts in batches.

    The scorer is loaded once per task. When a batch fails its rows are scored
    one by one, and a row that fails alone yields an error object.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        scorer = load_scorer()

        def one(payload: str) -> tuple[str | None, str | None]:
            try:
                return scorer([payload])[0], None
            except Exception as problem:  # a bad row must not end the job
                return None, json.dumps({"error": "scorer_failed", "message": str(problem)})

        for batch in batches:
            payloads = batch["payload"].tolist()
            try:
                outputs, errors = list(scorer(payloads)), [None] * len(payloads)
                if len(outputs) != len(payloads):
                    raise ValueError("scorer must answer every payload")
            except Exception:
                outputs, errors = map(list, zip(*[one(p) for p in payloads]))
            yield pd.DataFrame({"id": batch["id"], "output": outputs, "error": errors})

    answers = samples.select("id", F.to_json("payload").alias("payload")).mapInPandas(
        run, "id string, output string, error string"
    )
    return answers.select(
        "id",
        F.expr(f"coalesce(parse_json(error), {model_prediction('output')})").alias("prediction"),
    )


# --- values per sample ----------------------------------------------------------------------


def is_correct(references: str, prediction: str, choices: str) -> str:
    """SQL: 1.0 when the prediction equals a reference, or the choice a reference letter stands for.

    Texts are given as arrays of normalised words. Articles are dropped while
    normalising, so the letter A equals empty text; an empty prediction therefore
    counts for it.
    """
    letter = normalized_words("char(_i + 65)")
    lettered = f"transform({choices}, (_c, _i) -> struct({letter} AS letter, _c AS text))"
    by_choice = f"""exists({lettered}, _o -> array_contains({references}, _o.letter)
        AND ({prediction} = _o.letter OR {prediction} = _o.text))"""
    return f"""CAST(coalesce(array_contains({references}, {prediction}), false)
        OR coalesce({by_choice}, false) AS DOUBLE)"""


def best_f1(references: str, prediction: str) -> str:
    """SQL: the best token F1 over the references, zero without any.

    Equal texts need no counting.
    """
    counted = f"array_max(transform({references}, _ref -> {words_f1(prediction, '_ref')}))"
    return f"CASE WHEN array_contains({references}, {prediction}) THEN 1.0D ELSE coalesce({counted}, 0.0D) END"


# Steps over JSON texts, and over what is not the start of the value looked for.
_OUTSIDE_TEXTS = r'\G((?:"(?:[^"\\]|\\.)*+"|{other})*+)'


def _plain_amounts(json: str) -> str:
    """SQL: JSON with whole amounts without a fraction and booleans as 1 and 0, outside its texts."""
    whole = _OUTSIDE_TEXTS.format(other=r'[^".]|\.(?!0++(?![0-9]))') + r"\.0++(?![0-9])"
    yes, no = _OUTSIDE_TEXTS.format(other='[^"t]') + "true", _OUTSIDE_TEXTS.format(other='[^"f]') + "false"
    for pattern, shown in ((whole, "$1"), (yes, "$11"), (no, "$10")):
        json = f"regexp_replace({json}, r'{pattern}', '{shown}')"
    return json


def _comparable(value: str) -> str:
    """SQL key under which JSON values are equal in type and value: numbers and booleans by amount, at any depth."""
    amount = f"CASE WHEN {kind('_q')} <> 'STRING' THEN {number_of('_q')} END"
    held = f"concat({kind('_q')}, CASE {kind('_q')} WHEN 'STRING' THEN to_json(_q) ELSE {_plain_amounts('to_json(_q)')} END)"
    return bind(value, "_q", f"coalesce(concat('n', CAST({amount} AS STRING)), {held})")


def schema_validity(payload: str, call: str) -> str:
    """SQL: 1.0 when a parsed call names the expected tool, its arguments and the required fields."""
    given_names = [_comparable(field(call, key)) for key in ("tool", "name")]
    named = f"coalesce({_comparable('_tool')} = {given_names[0]}, false) OR coalesce({_comparable('_tool')} = {given_names[1]}, false)"
    tool_ok = bind(field(payload, "expected_tool"), "_tool", f"(NOT {truthy('_tool')} OR {named})")

    # Arguments that are absent count as an empty object; arguments that are no object fail.
    wanted = entries(field(payload, "expected_arguments"))
    given = f"coalesce({field(call, 'arguments')}, {field(call, 'args')}, parse_json('{{}}'))"
    other = "try_element_at(_have, _arg.key)"
    nothing = "({0} IS NULL OR is_variant_null({0}))"
    same = f"""({nothing.format('_arg.value')} AND {nothing.format(other)})
        OR coalesce({_comparable('_arg.value')} = {_comparable(other)}, false)"""
    all_given = f"_want IS NULL OR (_have IS NOT NULL AND forall(map_entries(_want), _arg -> {same}))"
    arguments_ok = bind(wanted, "_want", bind(entries(given), "_have", all_given))

    required = f"transform({items(field(payload, 'required_fields'))}, _e -> {element_text('_e')})"
    fields_ok = f"coalesce(size(array_except({required}, map_keys({entries(call)}))) = 0, true)"
    return f"CAST(coalesce({call} IS NOT NULL AND {tool_ok} AND {arguments_ok} AND {fields_ok}, false) AS DOUBLE)"


def action_l2(reference: str, predicted: str) -> str:
    """SQL: distance of two vectors; unequal or missing ones count as 0.0."""
    squares = f"zip_with({reference}, {predicted}, (_a, _b) -> pow(_a - _b, 2))"
    distance = f"sqrt(aggregate({squares}, 0.0D, (_sum, _x) -> _sum + _x))"
    return f"CASE WHEN {vectors_match(reference, predicted)} THEN {distance} ELSE 0.0D END"


def vectors_match(reference: str, predicted: str) -> str:
    return f"coalesce(size({reference}) > 0 AND size({reference}) = size({predicted}), false)"


def score_samples(samples: DataFrame, suite: list[Benchmark] | None = None) -> DataFrame:
    """Adds what every metric is made of.

    ``correct``, ``f1``, ``schema_validity``, ``action_l2``, ``action_valid`` and the
    parsed prediction ``call``. Unused ones are pruned by the optimiser; with a suite
    the costly ones are only computed for benchmarks with a metric that needs them.
    """

    def for_users(sql: str, *metrics: str) -> str:
        if suite is None:
            return sql
        users = [b.name.replace("'", "\\'") for b in suite if set(b.metrics) & set(metrics)]
        listed = ", ".join(f"'{name}'" for name in users)
        return f"CASE WHEN benchmark IN ({listed}) THEN {sql} END" if users else "CAST(NULL AS DOUBLE)"

    read = {
        "call": object_of("prediction"),
        "_words": normalized_words(text_of("prediction")),
        "_references": f"transform({references_of('reference')}, _ref -> {normalized_words('_ref')})",
        "_choices": f"transform({items(field('payload', 'choices'))}, _e -> {normalized_words(element_text('_e'))})",
        "_expected": vector_of(f"coalesce({field('payload', 'reference_action')}, reference)"),
        "_predicted": vector_of(f"coalesce({field('payload', 'predicted_action')}, prediction)"),
    }
    scores = {
        "correct": is_correct("_references", "_words", "_choices"),
        "f1": for_users(best_f1("_references", "_words"), *F1_METRICS, *PROXY_METRICS),
        "schema_validity": for_users(schema_validity("payload", "call"), "schema_validity", "tool_error_rate"),
        "action_l2": for_users(action_l2("_expected", "_predicted"), "action_l2"),
        "action_valid": vectors_match("_expected", "_predicted"),
    }
    return (
        samples.withColumns({name: F.expr(sql) for name, sql in read.items()})
        .withColumns({name: F.expr(sql) for name, sql in scores.items()})
        .drop(*[name for name in read if name != "call"])
    )


def numeric_lookup(metric: str) -> str:
    """SQL for a value the sample or the prediction supplies for ``metric``.

    The first place that holds the key decides, even when what it holds is no number.
    """
    scores = f"coalesce({field('payload', 'scores')}, {field('payload', 'metrics')})"
    places = [field(scores, metric), field("call", metric)]
    places += [field("payload", key) for key in SYSTEM_METRICS.get(metric, (metric,))]
    return number_of(f"coalesce({', '.join(places)})")


def metric_sql(metric: str) -> str:
    """SQL for the per-sample value of a metric over the columns of ``score_samples``."""
    if metric in EXACT_METRICS:
        return "correct"
    if metric in F1_METRICS:
        return "f1"
    if metric in ("schema_validity", "action_l2"):
        return metric

    def flag(key: str) -> str:
        return number_of(field("payload", key))

    if metric == "calibration_error":
        return f"abs(coalesce({numeric_lookup('confidence')}, {flag('confidence')}, correct) - correct)"
    supplied = numeric_lookup(metric)
    if metric in PROXY_METRICS:
        return f"coalesce({supplied}, greatest(correct, f1))"
    if metric in SUCCESS_FIELDS:
        return f"coalesce({supplied}, {flag(SUCCESS_FIELDS[metric])}, correct)"
    if metric == "tool_error_rate":
        return f"coalesce({supplied}, {flag('tool_error')}, 1.0D - schema_validity)"
    if metric == "unsafe_action_rate":
        return f"coalesce({supplied}, {flag('unsafe_action')}, 0.0D)"
    if metric == "collision_free_rate":
        return f"coalesce({supplied}, {flag('collision_free')}, correct)"
    if metric in SYSTEM_METRICS:
        return supplied
    return f"coalesce({supplied}, correct)"


def metric_value(metric: str) -> Column:
    return F.expr(metric_sql(metric))


def sample_metric(scored: DataFrame, metric: str, decimals: int = 6) -> DataFrame:
    """``id, value`` of one metric."""
    return scored.select("id", F.round(metric_value(metric), decimals).alias("value"))


# --- values per benchmark -------------------------------------------------------------------


def macro_average(scored: DataFrame) -> DataFrame:
    """Mean over datasets of the dataset mean, each rounded."""
    per_dataset = scored.groupBy("benchmark", "dataset").agg(
        mean4(F.sum("correct"), F.count("correct")).alias("dataset_mean"), F.count(F.lit(1)).alias("samples")
    )
    return per_dataset.groupBy("benchmark").agg(
        mean4(F.sum("dataset_mean"), F.count("dataset_mean")).alias("macro_average"),
        F.count(F.lit(1)).alias("datasets"),
        F.sum("samples").alias("samples"),
    )


def benchmark_scorecard(scored: DataFrame, suite: list[Benchmark]) -> DataFrame:
    """``benchmark, dimension, metric, value, sample_count`` in long form.

    One scan: sums and counts per benchmark and dataset first, which spreads a
    benchmark that holds most samples and gives the macro average its datasets;
    then the few partial rows per benchmark.
    """
    table = benchmarks_table(scored.sparkSession, suite)
    plain = [m for m in suite_metrics(suite) if m != "macro_average"]
    places = range(len(plain))  # columns go by place: a metric's name may hold any character
    wanted = [[b.name for b in suite if m in b.metrics] for m in plain]
    values = scored.select(
        "benchmark",
        "dataset",
        "correct",
        *[F.when(F.col("benchmark").isin(wanted[i]), metric_value(plain[i])).alias(f"v{i}") for i in places],
    )
    per_dataset = values.groupBy("benchmark", "dataset").agg(
        F.count(F.lit(1)).alias("n"),
        mean4(F.sum("correct"), F.count("correct")).alias("dataset_mean"),
        *[F.sum(f"v{i}").alias(f"s{i}") for i in places],
        *[F.count(f"v{i}").alias(f"c{i}") for i in places],
    )
    means = {m: mean4(F.sum(f"s{i}"), F.sum(f"c{i}")) for i, m in enumerate(plain)}
    means["macro_average"] = mean4(F.sum("dataset_mean"), F.count("dataset_mean"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), mean.alias("value")) for m, mean in means.items()])
    per_benchmark = per_dataset.groupBy("benchmark").agg(F.sum("n").alias("sample_count"), pairs.alias("pairs"))
    scored_here = F.filter("pairs", lambda p: F.array_contains("metrics", p["metric"]))
    return (
        per_benchmark.join(F.broadcast(table), "benchmark")  # bounded by the suite
        .select(
            "benchmark",
            "dimension",
            "sample_count",
            F.explode(scored_here).alias("entry"),
        )
        .select("benchmark", "dimension", F.col("entry.metric").alias("metric"), F.col("entry.value").alias("value"), "sample_count")
    )


def scorecard_maps(scorecard: DataFrame) -> DataFrame:
    """One row per benchmark with its metrics as a map; a benchmark has a handful of metrics."""
    metrics = F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value"))))
    return scorecard.groupBy("benchmark", "dimension").agg(
        F.max("sample_count").alias("sample_count"), metrics.alias("metrics")
    )


def _gate_passes(metric: Column, value: Column, threshold: Column) -> Column:
    held = F.when(lower_is_better(metric), value <= threshold).otherwise(value >= threshold)
    return F.coalesce(held, F.lit(False))


def gate_evaluate(scorecard: DataFrame, gates: DataFrame) -> DataFrame:
    """``benchmark, metric, threshold, value, gate_passed, benchmark_passed``.

    A gate names a metric literally, prefix included; one that was not scored fails.
    The window runs over the few gates of a benchmark.
    """
    joined = gates.join(scorecard.select("benchmark", "metric", "value"), ["benchmark", "metric"], "left")
    judged = joined.withColumn("gate_passed", _gate_passes(F.col("metric"), F.col("value"), F.col("threshold")))
    return judged.withColumn(
        "benchmark_passed", F.bool_and("gate_passed").over(Window.partitionBy("benchmark"))
    ).select("benchmark", "metric", "threshold", "value", "gate_passed", "benchmark_passed")


def evaluation_results(scorecard: DataFrame, gates: DataFrame, benchmarks: DataFrame | None = None) -> DataFrame:
    """``benchmark, dimension, sample_count, passed``; a benchmark without gates passes.

    With the suite's ``benchmarks`` given, those without samples or metrics are
    listed too, with no samples and their gates failed.
    """
    per_benchmark = gates.groupBy("benchmark").agg(F.collect_list(F.struct("metric", "threshold")).alias("gates"))

    def holds(gate: Column) -> Column:
        return _gate_passes(gate["metric"], F.try_element_at("metrics", gate["metric"]), gate["threshold"])

    maps = scorecard_maps(scorecard)
    if benchmarks is not None:
        none = F.create_map().cast("map<string,double>")
        listed = benchmarks.select("benchmark", F.col("dimension").alias("_dimension"))
        maps = listed.join(maps, "benchmark", "left").select(
            "benchmark",
            F.coalesce("dimension", "_dimension").alias("dimension"),
            F.coalesce("sample_count", F.lit(0).cast("long")).alias("sample_count"),
            F.coalesce("metrics", none).alias("metrics"),
        )
    joined = maps.join(per_benchmark, "benchmark", "left")
    return joined.select(
        "benchmark", "dimension", "sample_count", F.coalesce(F.forall("gates", holds), F.lit(True)).alias("passed")
    )


def eval_report(results: DataFrame) -> DataFrame:
    """Totals per dimension, and for the whole run under the dimension ``*``."""
    flag = F.col("passed").cast("int")
    return (
        results.withColumn("scope", F.explode(F.array(F.col("dimension"), F.lit("*"))))
        .groupBy(F.col("scope").alias("dimension"))
        .agg(
            F.count(F.lit(1)).alias("benchmarks"),
            F.sum("sample_count").alias("samples"),
            F.sum(flag).alias("passed"),
            F.sum(1 - flag).alias("failed"),
            mean4(F.sum(flag), F.count(flag)).alias("pass_share"),
        )
    )


def dimension_weights(benchmarks: DataFrame) -> DataFrame:
    """Weight share per dimension; raw weights when they add up to nothing."""
    per_dimension = benchmarks.groupBy("dimension").agg(F.sum("weight").alias("weight"))
    total = per_dimension.agg(F.sum("weight").alias("total")).scalar()
    share = F.round(F.try_divide(F.col("weight"), total), 4)
    return per_dimension.select("dimension", F.coalesce(share, F.col("weight")).alias("weight"))


def benchmark_select(benchmarks: DataFrame, selector: list[str] | None) -> DataFrame:
    """Benchmarks whose name or dimension is selected; no selector keeps all."""
    if not selector:
        return benchmarks
    return benchmarks.filter(F.col("benchmark").isin(selector) | F.col("dimension").isin(selector))


def compare_runs(base: DataFrame, candidate: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Change of each metric that both runs scored; a loss beyond ``tolerance`` is a regression."""
    keys = ["benchmark", "metric"]
    joined = base.select(*keys, F.col("value").alias("base_value")).join(
        candidate.select(*keys, F.col("value").alias("candidate_value")), keys
    )
    delta = F.round(F.col("candidate_value") - F.col("base_value"), 4)
    loss = F.when(lower_is_better(F.col("metric")), delta).otherwise(-delta)
    return joined.withColumn("delta", delta).withColumn("regressed", loss > tolerance)


# --- evaluators ------------------------------------------------------------------------------


def custom_evaluator(df: DataFrame, evaluators: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Adds one column per evaluator of ``(prompt, response)``; the built-in pair when none is given."""
    evaluators = evaluators or {"contains_prompt": contains_prompt, "response_length": response_length}
    return df.withColumns(
        {name: evaluate(F.col("prompt"), F.col("response")) for name, evaluate in evaluators.items()}
    )


def contains_prompt(prompt: Column, response: Column) -> Column:
    tidy = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.contains(tidy(response), tidy(prompt)).cast("double")


def response_length(prompt: Column, response: Column) -> Column:
    return F.length(response).cast("double")


def python_evaluator(evaluate: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """An evaluator in Python, sent Arrow batches."""

    @F.pandas_udf("double")
    def scored(prompts: pd.Series, responses: pd.Series) -> pd.Series:
        return pd.Series([evaluate(p, r) for p, r in zip(prompts, responses)], dtype="float64")

    return scored

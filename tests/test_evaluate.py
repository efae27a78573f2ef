"""Scores on hand-made samples, with the rules that surprise."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.variant import text_of
from tallyforge.operators import evaluate as ev
from tallyforge.operators.suite import Benchmark, benchmarks_table, gates_table
from tallyforge.session import config_table
from tallyforge.sources import sample_from_payload


def samples(spark, payloads, fallback="bench"):
    rows = [(i, json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "i long, j string").withColumn("payload", F.parse_json("j")).drop("j")
    return sample_from_payload(df, F.lit(fallback), F.col("i"))


def score(spark, payloads, predictions=None):
    return ev.score_samples(ev.join_predictions(samples(spark, payloads), predictions))


def values(spark, metric, payloads):
    out = score(spark, payloads).select("i", ev.metric_value(metric).alias("v")).orderBy("i").collect()
    return [r.v for r in out]


def test_exact_match_rules(spark):
    choices = ["Berlin", "Paris", "The A"]
    cases = [
        ({"answer": "Paris.", "prediction": "  the PARIS"}, 1.0),
        ({"answer": "B", "choices": choices, "prediction": "paris"}, 1.0),
        ({"answer": "B", "choices": choices, "prediction": "b)"}, 1.0),
        ({"answer": "B", "choices": choices, "prediction": "berlin"}, 0.0),
        ({"answer": "Paris", "choices": choices, "prediction": "B"}, 0.0),
        ({"answer": "A", "prediction": ""}, 1.0),
        ({"answer": "C", "choices": choices, "prediction": ""}, 1.0),
        ({"answer": ["x", "42"], "prediction": 42}, 1.0),
        ({"answer": True, "prediction": "true"}, 1.0),
        ({"answer": None, "prediction": ""}, 0.0),
        ({"prediction": "x"}, 0.0),
        ({"answer": "x", "choices": "no list", "prediction": "x"}, 1.0),
    ]
    assert values(spark, "accuracy", [c for c, _ in cases]) == [v for _, v in cases]


def test_token_f1_takes_the_best_reference(spark):
    payloads = [
        {"answer": ["red red car", "red car"], "prediction": "red car red blue"},
        {"answer": "", "prediction": "the"},
        {"answer": "x", "prediction": ""},
        {"prediction": "x"},
    ]
    assert values(spark, "ocr_f1", payloads) == pytest.approx([6 / 7, 1.0, 0.0, 0.0])


def test_schema_validity(spark):
    base = {"expected_tool": "weather", "expected_arguments": {"city": "Oslo", "n": 1}}
    call = {"tool": "weather", "arguments": {"city": "Oslo", "n": 1.0, "more": 2}}
    cases = [
        ({**base, "prediction": json.dumps(call)}, 1.0),
        ({**base, "prediction": call}, 1.0),
        ({**base, "prediction": {"name": "weather", "args": call["arguments"]}}, 1.0),
        ({**base, "prediction": {**call, "tool": "other"}}, 0.0),
        ({**base, "prediction": {**call, "arguments": {"city": "Oslo"}}}, 0.0),
        ({**base, "prediction": {**call, "arguments": {"city": "Oslo", "n": "1"}}}, 0.0),
        ({**base, "prediction": {**call, "arguments": "Oslo"}}, 0.0),
        ({**base, "prediction": "not json"}, 0.0),
        ({"prediction": "[1]"}, 0.0),
        ({"prediction": {"x": 1}}, 1.0),
        ({"expected_tool": "", "prediction": {"x": 1}}, 1.0),
        ({"required_fields": ["x", 1], "prediction": {"x": 1, "1": 2}}, 1.0),
        ({"required_fields": ["y"], "prediction": {"x": 1}}, 0.0),
        ({"expected_arguments": {"k": None}, "prediction": {"arguments": {}}}, 1.0),
        ({"expected_arguments": {"k": None}, "prediction": {"arguments": {"k": 1}}}, 0.0),
        ({"expected_arguments": {"k": [1, {"a": 2}]}, "prediction": {"arguments": {"k": [1, {"a": 2}]}}}, 1.0),
        ({"expected_arguments": {"k": [1, {"a": 20.5}]}, "prediction": '{"arguments": {"k": [1e0, {"a": 20.50}]}}'}, 1.0),
        ({"expected_arguments": {"k": [True]}, "prediction": {"arguments": {"k": [1]}}}, 1.0),
        ({"expected_arguments": {"k": ["1.0", "true"]}, "prediction": {"arguments": {"k": ["1", "true"]}}}, 0.0),
        ({"expected_arguments": {"k": ["1"]}, "prediction": {"arguments": {"k": [1]}}}, 0.0),
        ({"expected_tool": "1", "prediction": {"tool": 1}}, 0.0),
        ({"expected_tool": 1, "prediction": {"tool": 1.0}}, 1.0),
    ]
    assert values(spark, "schema_validity", [c for c, _ in cases]) == [v for _, v in cases]
    assert values(spark, "tool_error_rate", [{"prediction": "no"}, {"tool_error": False, "prediction": "no"}]) == [1.0, 0.0]


def test_action_distance_of_unequal_vectors_is_zero(spark):
    payloads = [
        {"reference_action": [0, 3], "predicted_action": [4, 0]},
        {"answer": "[0, 3]", "prediction": {"action": ["4", 0]}},
        {"reference_action": [1, 2], "predicted_action": [1]},
        {"reference_action": [], "predicted_action": []},
        {"reference_action": [1, "x"], "predicted_action": [1, 2]},
        {"reference_action": [0, 3], "predicted_action": {"action": "[4, 0]"}},
        {"reference_action": [0, 3], "prediction": {"action": {"trajectory": '{"action": "4 and 0"}'}}},
        {"reference_action": [0, 3], "predicted_action": {"other": [4, 0]}},
    ]
    rows = score(spark, payloads).orderBy("i").collect()
    assert [r.action_l2 for r in rows] == [5.0, 5.0, 0.0, 0.0, 0.0, 5.0, 5.0, 0.0]
    assert [r.action_valid for r in rows] == [True, True, False, False, False, True, True, False]


def test_supplied_values_and_fallbacks(spark):
    right, wrong = {"answer": "x", "prediction": "x"}, {"answer": "x", "prediction": "y"}
    assert values(spark, "wer", [{**right, "scores": {"wer": 0.2}}, right, wrong]) == [0.2, 1.0, 0.0]
    assert values(spark, "temporal_reasoning", [{**wrong, "temporal_reasoning": "0.5"}, wrong]) == [0.5, 0.0]
    assert values(spark, "success_rate", [{**wrong, "success": True}, right, {**wrong, "scores": {"success_rate": 0.3}}]) == [1, 1, 0.3]
    assert values(spark, "recovery_rate", [{**wrong, "recovered": False}, right]) == [0.0, 1.0]
    assert values(spark, "unsafe_action_rate", [{"unsafe_action": True}, right]) == [1.0, 0.0]
    assert values(spark, "collision_free_rate", [{**wrong, "collision_free": True}, wrong]) == [1.0, 0.0]
    assert values(spark, "calibration_error", [{**right, "confidence": 0.9}, {**wrong, "confidence": "0.4"}, wrong]) == pytest.approx([0.1, 0.4, 0.0])
    assert values(spark, "prefill_ms", [{"ttft_ms": 12}, {"prefill_ms": 5, "ttft_ms": 9}, right]) == [12.0, 5.0, None]


def test_first_place_with_the_key_decides(spark):
    payloads = [
        {"scores": {"mos": "bad"}, "mos": 4.0},
        {"scores": {"other": 1}, "mos": 4.0},
        {"metrics": {"mos": 3}, "mos": 4.0},
        {"scores": {}, "metrics": {"mos": 3}, "mos": 4.0},
        {"prediction": {"mos": 2}, "mos": 4.0},
        {"mos": None, "scores": [1]},
    ]
    out = score(spark, payloads).select("i", F.expr(ev.numeric_lookup("mos")).alias("v")).orderBy("i").collect()
    assert [r.v for r in out] == [None, 4.0, 3.0, 4.0, 2.0, None]


SUITE = [
    Benchmark("quiz", "facts", ("rivers", "lakes"), ("accuracy", "macro_average", "calibration_error"), 1.0, {"macro_average": 0.6}),
    Benchmark("dictation", "sound", ("radio",), ("wer", "cer", "accuracy"), 0.9, {"wer": 0.3, "accuracy": 0.5}),
    Benchmark("calls", "tools", ("ledger",), ("schema_validity", "task_success", "tool_error_rate"), 0.8, {"schema_validity": 0.9}),
    Benchmark("arm", "motion", ("bench",), ("success_rate", "action_l2", "collision_free_rate"), 1.2, {"action_l2": 2.0}),
    Benchmark("errand", "agent", ("town",), ("steps_to_success", "unsafe_action_rate", "cost_per_success"), 1.1, {"steps_to_success": 9}),
    Benchmark("board", "chips", ("rack",), ("prefill_ms", "decode_tok_s", "power_w"), 0.9, {"decode_tok_s": 10}),
]
SMOKE = [
    {"id": "q1", "benchmark": "quiz", "dataset": "rivers", "question": "Longest of these?", "choices": ["Po", "Rhone"], "answer": "B", "prediction": "the rhone", "confidence": 0.75},
    {"id": "d1", "benchmark": "dictation", "dataset": "radio", "input": "clip", "answer": "seven small boats", "prediction": "Seven small boats.", "scores": {"wer": 0.25, "cer": 0.125}},
    {"id": "c1", "benchmark": "calls", "dataset": "ledger", "prompt": "Book it", "expected_tool": "book", "expected_arguments": {"sum": 12}, "prediction": '{"name": "book", "args": {"sum": 12.0}}', "success": True},
    {"id": "m1", "benchmark": "arm", "dataset": "bench", "prompt": "Lift", "reference_action": [2, 0, 1], "predicted_action": [2, 1, 1], "success": True, "collision_free": True},
    {"id": "e1", "benchmark": "errand", "dataset": "town", "prompt": "Fetch milk", "prediction": "fetched", "steps": 8, "cost": 0.5},
    {"id": "b1", "benchmark": "board", "dataset": "rack", "prompt": "Run", "prediction": "ran", "ttft_ms": 31.5, "tokens_per_second": 12.5, "power_watts": 7},
]


def test_small_suite_passes(spark):
    scored = ev.score_samples(ev.join_predictions(samples(spark, SMOKE)), SUITE)
    card = ev.benchmark_scorecard(scored, SUITE)
    found = {(r.benchmark, r.metric): r.value for r in card.collect()}
    assert found["quiz", "accuracy"] == found["quiz", "macro_average"] == 1.0
    assert found["quiz", "calibration_error"] == 0.25 and found["dictation", "cer"] == 0.125
    assert found["errand", "steps_to_success"] == 8.0 and found["arm", "action_l2"] == 1.0
    assert found["calls", "tool_error_rate"] == 0.0 and found["board", "power_w"] == 7.0
    results = ev.evaluation_results(card, gates_table(spark, SUITE))
    report = {r.dimension: r for r in ev.eval_report(results).collect()}
    assert (report["*"].benchmarks, report["*"].samples, report["*"].passed, report["*"].failed) == (6, 6, 6, 0)
    assert report["sound"].pass_share == 1.0


def test_report_lists_benchmarks_without_samples(spark):
    suite = [*SUITE, Benchmark("silent", "facts", (), ("accuracy",), 1.0, {"accuracy": 0.1}), Benchmark("bare", "facts")]
    card = ev.benchmark_scorecard(ev.score_samples(ev.join_predictions(samples(spark, SMOKE)), suite), suite)
    results = ev.evaluation_results(card, gates_table(spark, suite), benchmarks_table(spark, suite))
    rows = {r.benchmark: (r.dimension, r.sample_count, r.passed) for r in results.collect()}
    assert rows["silent"] == ("facts", 0, False) and rows["bare"] == ("facts", 0, True) and len(rows) == 8


def test_table_comes_before_the_samples_own_prediction(spark):
    given = [
        {"id": "r", "benchmark": "quiz", "dataset": "rivers", "question": "Through Cologne?", "answer": "Rhine", "prediction": "Elbe", "confidence": 0.2},
        {"id": "l", "benchmark": "quiz", "dataset": "lakes", "question": "Deepest?", "answer": "Baikal", "prediction": "Garda"},
        {"id": "l", "benchmark": "quiz", "dataset": "lakes", "question": "Deepest by far?", "answer": "Baikal", "prediction": "Como"},
        {"id": "o", "benchmark": "quiz", "dataset": "lakes", "question": "Own?", "answer": "Como", "prediction": "Garda", "confidence": 0.5},
    ]
    table = spark.createDataFrame([("r", '"the Rhine"'), ("l", '"Baikal!"'), ("none", '"x"')], "id string, j string").select(
        "id", F.parse_json("j").alias("prediction")
    )
    card = ev.benchmark_scorecard(score(spark, given, table), SUITE)
    found = {r.metric: (r.value, r.sample_count) for r in card.filter("benchmark = 'quiz'").collect()}
    assert found == {"accuracy": (0.75, 4), "macro_average": (0.8334, 4), "calibration_error": (0.325, 4)}


def test_scorer_comes_before_sample_fields_and_after_the_table(spark):
    df = samples(spark, [{"id": "a", "prediction": "own"}, {"id": "b", "prediction": "own"}])
    table = spark.createDataFrame([("a", "table")], "id string, p string").select("id", F.col("p").cast("variant").alias("prediction"))
    scorer = spark.createDataFrame([("a", "scorer"), ("b", "scorer")], "id string, p string").select(
        "id", F.col("p").cast("variant").alias("prediction")
    )
    out = ev.join_predictions(df, table, scorer).select("id", F.expr(text_of("prediction")).alias("p"))
    assert {r.id: r.p for r in out.collect()} == {"a": "table", "b": "scorer"}


def test_system_metric_without_values_is_zero_and_macro_rounds_twice(spark):
    rows = [{"id": str(i), "benchmark": "board", "dataset": "rack", "answer": "x", "prediction": "x"} for i in range(2)]
    card = {r.metric: r.value for r in ev.benchmark_scorecard(score(spark, rows), SUITE).collect()}
    assert card == {"prefill_ms": 0.0, "decode_tok_s": 0.0, "power_w": 0.0}
    thirds = [{"benchmark": "m", "dataset": d, "answer": "x", "prediction": p} for d, p in [("1", "x"), ("1", ""), ("1", ""), ("2", "x"), ("2", "x"), ("2", "")]]
    assert ev.macro_average(score(spark, thirds)).first().macro_average == 0.5
    sevenths = [{"benchmark": "m", "dataset": "1", "answer": "q", "prediction": "q" if i < 1 else ""} for i in range(7)]
    assert ev.macro_average(score(spark, sevenths)).first().macro_average == 0.1429


def test_metric_names_may_hold_any_character(spark):
    suite = [Benchmark("odd", "odd", (), ("pass@1.strict", "accuracy"))]
    rows = [{"benchmark": "odd", "answer": "x", "prediction": "x", "scores": {"pass@1.strict": 0.25}}]
    assert {r.metric: r.value for r in ev.benchmark_scorecard(score(spark, rows), suite).collect()} == {
        "pass@1.strict": 0.25,
        "accuracy": 1.0,
    }


def test_gate_directions(spark):
    card = config_table(
        spark,
        [("b", "wer", 0.1), ("b", "accuracy", 0.5), ("b", "max_x", 3.0), ("b", "min_wer", 0.1)],
        {"benchmark": "string", "metric": "string", "value": "double"},
    )
    gates = config_table(
        spark,
        [("b", "wer", 0.18), ("b", "accuracy", 0.6), ("b", "max_x", 3.0), ("b", "min_wer", 0.2), ("b", "max_wer", 1.0), ("c", "wer", 1.0)],
        {"benchmark": "string", "metric": "string", "threshold": "double"},
    )
    out = {(r.benchmark, r.metric): (r.gate_passed, r.benchmark_passed) for r in ev.gate_evaluate(card, gates).collect()}
    assert out == {
        ("b", "wer"): (True, False),
        ("b", "accuracy"): (False, False),
        ("b", "max_x"): (True, False),
        ("b", "min_wer"): (False, False),
        ("b", "max_wer"): (False, False),
        ("c", "wer"): (False, False),
    }


def test_published_dimension_weights(spark):
    # Published weights and their shares.
    weights = {
        "general": 1.0, "reasoning": 1.4, "multimodal_understanding": 1.2, "audio_speech": 0.9, "vla": 1.2,
        "long_context": 0.9, "tool_calling": 0.8, "agent": 1.1, "edge_efficiency": 0.9,
    }
    table = benchmarks_table(spark, [Benchmark(d, d, weight=w) for d, w in weights.items()])
    shares = {r.dimension: r.weight for r in ev.dimension_weights(table).collect()}
    assert shares["agent"] == 0.117 and shares["reasoning"] == 0.1489 and shares["general"] == 0.1064
    zero = benchmarks_table(spark, [Benchmark("x", "x", weight=0.0)])
    assert ev.dimension_weights(zero).first().weight == 0.0


def test_select_and_compare(spark):
    table = benchmarks_table(spark, SUITE)
    assert {r.benchmark for r in ev.benchmark_select(table, ["agent", "arm"]).collect()} == {"errand", "arm"}
    assert ev.benchmark_select(table, None).count() == len(SUITE)
    columns = {"benchmark": "string", "metric": "string", "value": "double"}
    base = config_table(spark, [("b", "accuracy", 0.9), ("b", "wer", 0.1), ("b", "f1", 0.5), ("x", "f1", 1.0)], columns)
    other = config_table(spark, [("b", "accuracy", 0.87), ("b", "wer", 0.15), ("b", "f1", 0.49)], columns)
    out = {r.metric: (r.delta, r.regressed) for r in ev.compare_runs(base, other).collect()}
    assert out == {"accuracy": (-0.03, True), "wer": (0.05, True), "f1": (-0.01, False)}


def test_batch_scorer_survives_bad_rows(spark):
    def load():
        import json

        def scorer(payloads):
            out = []
            for p in payloads:
                n = json.loads(p)["n"]
                if n == 3:
                    raise ValueError("three")
                out.append(json.dumps({"response": n}) if n % 2 else f"plain {n}")
            return out

        return scorer

    df = samples(spark, [{"id": str(n), "n": n} for n in range(6)])
    out = {r.id: r.p for r in ev.batch_score(df, load).select("id", F.expr(text_of("prediction")).alias("p")).collect()}
    assert out["0"] == "plain 0" and out["1"] == "1" and out["5"] == "5"
    assert json.loads(out["3"]) == {"error": "scorer_failed", "message": "three"}


def test_evaluators(spark):
    df = spark.createDataFrame([(" Hi ", "oh HI there"), ("é", "e")], "prompt string, response string")
    rows = ev.custom_evaluator(df).collect()
    assert [(r.contains_prompt, r.response_length) for r in rows] == [(1.0, 11.0), (0.0, 1.0)]
    length = ev.python_evaluator(lambda prompt, response: float(len(prompt) - len(response)))
    assert [r.gap for r in ev.custom_evaluator(df, {"gap": length}).collect()] == [-7.0, 0.0]


def test_scorecard_maps(spark):
    card = ev.benchmark_scorecard(score(spark, SMOKE), SUITE)
    maps = {r.benchmark: r.metrics for r in ev.scorecard_maps(card).collect()}
    assert maps["calls"] == {"schema_validity": 1.0, "task_success": 1.0, "tool_error_rate": 0.0}

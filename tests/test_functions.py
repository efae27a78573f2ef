"""Expressions on hand-made values, and against brute force."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.numbers import format_gate, lower_is_better, mean4, number_of, percent, vector_of
from tallyforge.functions.text import digest_prefix, normalized_text, normalized_words, safe_name, words_f1
from tallyforge.functions.variant import object_of, references_of, spaced_json, text_of, truthy


def evaluate_json(spark, sql, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, j string").withColumn("v", F.parse_json("j"))
    return [r.out for r in df.select("i", F.expr(sql).alias("out")).orderBy("i").collect()]


def evaluate_text(spark, sql, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.out for r in df.select("i", F.expr(sql).alias("out")).orderBy("i").collect()]


def test_normalized_text(spark):
    cases = {
        "  The  Quick, brown FOX! ": "quick brown fox",
        "A": "",
        "an apple a day": "apple day",
        "it's re-do\x1cnow": "its redo now",
        "Éa the theme": "éa theme",
        "": "",
    }
    assert evaluate_text(spark, normalized_text("t"), list(cases)) == list(cases.values())


def brute_f1(left, right):
    if not left and not right:
        return 1.0
    return 2 * sum((Counter(left) & Counter(right)).values()) / (len(left) + len(right))


def test_words_f1_against_brute_force(spark):
    random.seed(5)
    vocabulary = ["ab", "abc", "b", "c", "the", "x1", "é", "\\d", "$1", "(", "a b"]
    pairs = [
        ([random.choice(vocabulary[:-1]) for _ in range(random.randint(0, 30))],
         [random.choice(vocabulary[:-1]) for _ in range(random.randint(0, 30))])
        for _ in range(300)
    ]
    pairs += [(["the"] * 20000, ["the"] * 15000 + ["x"] * 5), ([], []), ([], ["a"])]
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(pairs)], "i int, p array<string>, r array<string>")
    found = {r.i: r.f for r in df.select("i", F.expr(words_f1("p", "r")).alias("f")).collect()}
    for i, (p, r) in enumerate(pairs):
        assert found[i] == pytest.approx(brute_f1(p, r)), pairs[i]


def test_text_of(spark):
    values = ["a", True, None, 12.0, 12.5, 7, [1, "b"], {"b": 1, "a": None}, 123456789012345678901234567890]
    shown = ["a", "True", "None", "12.0", "12.5", "7", '[1, "b"]', '{"a": null, "b": 1}', "123456789012345678901234567890"]
    assert evaluate_json(spark, text_of("v"), values) == shown


def test_spaced_json_equals_sorted_dump(spark):
    values = [{"b": [1, 2, {"x, y": "q: \\\"z\\\" , end"}], "a": {"k": True}}, {}, [], "p, q: r", {"é": "\n\t"}]
    expected = [json.dumps(v, sort_keys=True, ensure_ascii=False) for v in values]
    assert evaluate_json(spark, spaced_json("v"), values) == expected


def test_truthy(spark):
    values = ["", "0", 0, 0.0, 1, -2.5, False, True, None, [], [0], {}, {"a": 0}]
    assert evaluate_json(spark, truthy("v"), values) == [bool(v) for v in values]
    assert evaluate_json(spark, truthy("try_variant_get(v, '$.none', 'variant')"), [{}]) == [False]


def test_number_of(spark):
    values = [True, False, 3, 2.5, "4", " 5.5 ", "1e3", "1.0d", "inf", "nan", "x", "", None, [1], {"a": 1}]
    expected = [1.0, 0.0, 3.0, 2.5, 4.0, 5.5, 1000.0] + [None] * 8
    assert evaluate_json(spark, number_of("v"), values) == expected


def test_vector_of(spark):
    values = [
        [1, "2", True],
        [1, "x"],
        "[3, 4]",
        "move 1.5 then -2",
        "nothing",
        {"action": [5]},
        {"trajectory": "[6, 7]"},
        {"other": [1]},
        '{"predicted_action": [8]}',
        None,
        [],
    ]
    expected = [[1, 2, 1], None, [3, 4], [1.5, -2], None, [5], [6, 7], None, [8], None, []]
    assert evaluate_json(spark, vector_of("v"), values) == expected


def test_vector_of_deep_payloads(spark):
    """Objects and texts inside one another, 40 and more of them."""
    values, expected = [], []
    for depth in (1, 7, 15):
        nested, text = [1.5, depth], [depth]
        for i in range(depth):
            nested = {("action", "predicted_action", "trajectory")[i % 3]: nested}
            text = json.dumps({"action": text}) if i % 5 == 0 else {"action": text}
        values += [nested, text, {"action": json.dumps(nested)}, 'say "no" 7 times {']
        expected += [[1.5, depth], [depth], [1.5, depth], [7]]
    objects = [3]
    for _ in range(45):
        objects = {"action": objects}
    assert evaluate_json(spark, vector_of("v"), [*values, objects]) == [*expected, [3]]


def test_object_of_and_references(spark):
    values = [{"a": 1}, '{"b": 2}', " ", "[1]", 5, None]
    shown = evaluate_json(spark, f"to_json({object_of('v')})", values)
    assert shown == ['{"a":1}', '{"b":2}', None, None, None, None]
    assert evaluate_json(spark, references_of("v"), ["x", ["y", 2, True, None], None, []]) == [
        ["x"],
        ["y", "2", "True", "None"],
        [],
        [],
    ]
    assert evaluate_json(spark, references_of("try_variant_get(v, '$.n', 'variant')"), [{}]) == [[]]


def test_small_helpers(spark):
    row = spark.range(1).select(
        safe_name(F.lit("__My Bench: v1.0!")).alias("name"),
        digest_prefix(F.lit("x"), 12).alias("digest"),
        format_gate(F.lit("wer"), F.lit(0.18)).alias("low"),
        format_gate(F.lit("min_wer"), F.lit(0.18)).alias("high"),
        format_gate(F.lit("cost_per_success"), F.lit(2.0)).alias("listed"),
        lower_is_better(F.lit("cost_per_success")).alias("scored"),
        percent(F.lit(0.125)).alias("share"),
        mean4(F.lit(None).cast("double"), F.lit(0)).alias("empty"),
        F.size(F.expr(normalized_words("'the a'"))).alias("no_words"),
    ).first()
    assert row.name == "my_bench_v1.0"
    assert row.digest == "2d711642b726"
    assert (row.low, row.high, row.listed, row.scored) == ("wer<=0.18", "min_wer>=0.18", "cost_per_success>=2.0", True)
    assert (row.share, row.empty, row.no_words) == ("12.5%", 0.0, 0)


def test_error_rates(spark):
    from tallyforge.functions.text import char_error_rate, word_error_rate

    rows = [("a b c d", "a x c"), ("", ""), ("", "x y"), ("é b", "e b"), ("a  b", "a b"), (None, "x")]
    df = spark.createDataFrame(rows, "r string, h string")
    out = df.select(word_error_rate(df.r, df.h), char_error_rate(df.r, df.h)).collect()
    assert [tuple(r) for r in out] == [(0.5, 3 / 7), (0.0, 0.0), (2.0, 3.0), (0.5, 1 / 3), (0.0, 0.25), (None, None)]

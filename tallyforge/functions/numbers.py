"""Numbers: lenient casts, vectors, rounding and gate direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.variant import NUMBER_KINDS, bind, first_present, items, kind

# Metrics for which a smaller value is better. The first set decides gates on
# scored metrics, the second one how a gate is written out.
SCORED_LOWER_IS_BETTER = (
    "action_l2",
    "calibration_error",
    "cost_per_success",
    "cer",
    "der",
    "eer",
    "frame_action_latency_ms",
    "memory_gb",
    "power_w",
    "prefill_ms",
    "speaker_eer",
    "steps_to_success",
    "tool_error_rate",
    "unsafe_action_rate",
    "wer",
)
LISTED_LOWER_IS_BETTER = (
    "action_l2",
    "calibration_error",
    "cer",
    "der",
    "eer",
    "error_rate",
    "frame_action_latency_ms",
    "latency_ms",
    "memory_gb",
    "perplexity",
    "power_w",
    "speaker_eer",
    "steps_to_success",
    "tool_error_rate",
    "unsafe_action_rate",
    "wer",
)
# Fields under which an object holds an action.
ACTION_FIELDS = ("action", "predicted_action", "trajectory")

# Fixed value: a number in loose text.
NUMBER_IN_TEXT = r"-?\d+(?:\.\d+)?"

NUMERIC_TEXT = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number_of(value: str) -> str:
    """SQL for a JSON value as a finite double: booleans are 1 and 0, numeric text counts, the rest is NULL."""
    number = f"""CASE WHEN _k = 'BOOLEAN' THEN CAST(CAST(_n AS STRING) = 'true' AS DOUBLE)
        WHEN _k IN ({NUMBER_KINDS}) OR (_k = 'STRING' AND CAST(_n AS STRING) RLIKE r'{NUMERIC_TEXT}')
            THEN try_cast(trim(CAST(_n AS STRING)) AS DOUBLE) END"""
    finite = "CASE WHEN abs(_d) < CAST('Infinity' AS DOUBLE) THEN _d END"
    return bind(bind(value, "_n", bind(kind("_n"), "_k", number)), "_d", finite)


def _numbers(value: str) -> str:
    listed = f"transform({items(value)}, _i -> {number_of('_i')})"
    return bind(listed, "_l", "CASE WHEN NOT exists(_l, _x -> _x IS NULL) THEN _l END")


# The parser stops behind the first value; this tells texts that are one value from texts that go on.
WHOLE_JSON = r'([\]}"]\s*$)|(^\s*(-?[0-9][0-9.eE+-]*|true|false|null)\s*$)'


def _innermost(value: str) -> str:
    """What objects hold under an action field, and what JSON texts say, opened one inside the other to the end.

    Each step uses up a brace or a quote of the value's JSON, which bounds the
    steps; a list takes none, and nothing is opened behind the last one.
    """
    parsed = f"CASE WHEN CAST(_a.v AS STRING) RLIKE r'{WHOLE_JSON}' THEN try_parse_json(CAST(_a.v AS STRING)) END"
    said = "CASE WHEN _j IS NULL THEN named_struct('v', _a.v, 'open', false) ELSE named_struct('v', _j, 'open', true) END"
    step = f"""CASE WHEN NOT _a.open THEN _a ELSE CASE {kind('_a.v')}
        WHEN 'OBJECT' THEN named_struct('v', {first_present('_a.v', ACTION_FIELDS)}, 'open', true)
        WHEN 'STRING' THEN {bind(parsed, '_j', said)}
        ELSE named_struct('v', _a.v, 'open', false) END END"""
    steps = f"""CASE WHEN {kind('_u')} IN ('OBJECT', 'STRING')
        THEN sequence(1, regexp_count(to_json(_u), '[{{"]') + 1) ELSE CAST(array() AS ARRAY<INT>) END"""
    return bind(value, "_u", f"aggregate({steps}, named_struct('v', _u, 'open', true), (_a, _i) -> {step}, _a -> _a.v)")


def vector_of(value: str) -> str:
    """SQL for a numeric array from a JSON list, an object that holds one, or text of either, inside one another.

    Text that is not JSON gives the numbers found in it. One element that is no
    number voids the whole vector.
    """
    found = rf"regexp_extract_all(CAST(_v AS STRING), r'{NUMBER_IN_TEXT}', 0)"
    loose = f"CASE WHEN size({found}) > 0 THEN transform({found}, _c -> CAST(_c AS DOUBLE)) END"
    return bind(_innermost(value), "_v", f"CASE WHEN {kind('_v')} = 'STRING' THEN {loose} ELSE {_numbers('_v')} END")


def mean4(total: Column, count: Column) -> Column:
    """Mean rounded to four places; nothing to average gives zero."""
    return F.coalesce(F.round(F.try_divide(total, count), 4), F.lit(0.0))


def lower_is_better(metric: Column) -> Column:
    """Direction of a gate: the name's prefix decides first, then the fixed list."""
    return (
        F.when(F.startswith(metric, F.lit("max_")), True)
        .when(F.startswith(metric, F.lit("min_")), False)
        .otherwise(metric.isin(*SCORED_LOWER_IS_BETTER))
    )


def format_gate(metric: Column, threshold: Column) -> Column:
    below = F.startswith(metric, F.lit("max_")) | (
        ~F.startswith(metric, F.lit("min_")) & metric.isin(*LISTED_LOWER_IS_BETTER)
    )
    return F.concat(metric, F.when(below, "<=").otherwise(">="), threshold.cast("string"))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)

"""Records and samples: which field is the text, the prompt, the reference, the prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.variant import (
    bind,
    field,
    first_present,
    first_truthy,
    items,
    kind,
    object_of,
    spaced_json,
    text_of,
)

# The order in which fields are looked up.
PROMPT_FIELDS = ("prompt", "question", "instruction", "input", "context")
REFERENCE_FIELDS = ("answer", "reference", "target", "gold", "label", "expected", "reference_action")
MODEL_OUTPUT_FIELDS = ("prediction", "response", "output", "text", "answer")
SAMPLE_PREDICTION_FIELDS = ("prediction", "model_output", "response", "output")

# Byte vocabulary.
PAD, BOS, EOS, BYTE_OFFSET = 0, 1, 2, 3
IGNORED_LABEL = -100


def record_text(record: str) -> str:
    """SQL for the text of a training record."""

    def has(*keys: str) -> str:
        return " AND ".join(f"{field(record, key)} IS NOT NULL" for key in keys)

    def text(key: str, default: str | None = None) -> str:
        shown = text_of(field(record, key))
        return shown if default is None else f"coalesce({shown}, '{default}')"

    messages = items(field(record, "messages"))
    spoken = f"""concat(coalesce({text_of(field('_m', 'role'))}, 'user'), ': ',
        coalesce({text_of(field('_m', 'content'))}, ''))"""
    lines = f"transform(filter({messages}, _m -> {kind('_m')} = 'OBJECT'), _m -> {spoken})"
    return f"""CASE
        WHEN {has('text')} THEN {text('text')}
        WHEN {has('prompt', 'response')} THEN concat_ws('\n', {text('prompt')}, {text('response')})
        WHEN {has('instruction', 'output')}
            THEN concat_ws('\n', {text('instruction')}, {text('input', '')}, {text('output')})
        WHEN {messages} IS NOT NULL THEN array_join({lines}, '\n')
        WHEN {has('trajectory')} THEN {spaced_json(field(record, 'trajectory'))}
        ELSE {spaced_json(record)} END"""


def map_record_text(records: DataFrame, record_column: str = "record") -> DataFrame:
    """Adds ``text``."""
    return records.withColumn("text", F.expr(record_text(record_column)))


def map_prompt_reference(df: DataFrame, fallback: Column, index: Column) -> DataFrame:
    """Adds ``id``, ``prompt`` and ``reference`` (VARIANT) from ``payload``."""
    given_id = F.expr(first_truthy("payload", ("id", "sample_id")))
    return df.withColumns(
        {
            "id": F.coalesce(given_id, F.format_string("%s-%06d", fallback, index)),
            "prompt": F.expr(f"coalesce({first_truthy('payload', PROMPT_FIELDS)}, {spaced_json('payload')})"),
            "reference": F.expr(first_present("payload", REFERENCE_FIELDS)),
        }
    )


def sample_prediction(payload: str) -> str:
    """SQL for the prediction a sample carries itself; empty text when it has none."""
    return f"coalesce({first_present(payload, SAMPLE_PREDICTION_FIELDS)}, CAST('' AS VARIANT))"


def model_prediction(output: str) -> str:
    """SQL for the prediction inside a model's answer text; the text itself when it is no JSON object."""
    answer = f"CAST({output} AS VARIANT)"
    return bind(object_of(answer), "_a", f"coalesce({first_present('_a', MODEL_OUTPUT_FIELDS)}, _a, {answer})")


def map_prediction(df: DataFrame, payload_column: str = "payload", output_column: str = "output") -> DataFrame:
    """Adds ``sample_prediction`` and ``model_prediction`` as display text."""
    return df.withColumns(
        {
            "sample_prediction": F.expr(text_of(sample_prediction(payload_column))),
            "model_prediction": F.expr(text_of(model_prediction(output_column))),
        }
    )


def conversation_lines(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``key, turn, line``: one ``role: text`` line per turn, for conversations of any length."""
    line = F.concat(F.coalesce(F.col("role"), F.lit("user")), F.lit(": "), F.coalesce(F.col("text"), F.lit("")))
    return turns.select(key, turn, line.alias("line"))


def conversation_to_text(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation: its lines in turn order, ties in order of the lines.

    The whole text is one value; use ``conversation_lines`` where it may not fit.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), "line")))
    lines = conversation_lines(turns, key, turn).groupBy(key).agg(ordered.alias("lines"))
    return lines.select(
        key, F.size("lines").cast("long").alias("turns"), F.array_join(F.col("lines.line"), "\n").alias("text")
    )


def byte_tokens(text: Column, seq_len: int) -> Column:
    """Start mark, UTF-8 bytes, end mark, padded or cut to ``seq_len``.

    Only the bytes that fit are turned into numbers; a cut sequence loses its end mark.
    """
    raw = F.encode(text, "UTF-8")
    kept = F.substring(raw, 1, seq_len - 1)
    characters = F.when(F.octet_length(raw) > 0, F.split(F.decode(kept, "ISO-8859-1"), ""))
    bytes_ = F.transform(F.coalesce(characters, F.array().cast("array<string>")), lambda c: F.ascii(c) + BYTE_OFFSET)
    tokens = F.concat(F.array(F.lit(BOS)), bytes_, F.array(F.lit(EOS)))
    padded = F.concat(tokens, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(seq_len) - F.size(tokens))))
    return F.slice(padded, 1, seq_len)


def byte_tokenize(df: DataFrame, text_column: str = "text", seq_len: int = 512) -> DataFrame:
    """Adds ``input_ids`` and ``labels`` (padding is ignored in the loss)."""
    ids = df.withColumn("input_ids", byte_tokens(F.col(text_column), seq_len))
    return ids.withColumn(
        "labels", F.transform("input_ids", lambda t: F.when(t == PAD, IGNORED_LABEL).otherwise(t))
    )

"""Evaluation samples from JSON Lines, matched to the benchmarks of a suite."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.text import safe_name
from tallyforge.functions.variant import first_truthy, kind, text_of
from tallyforge.operators.records import map_prompt_reference
from tallyforge.operators.suite import Benchmark
from tallyforge.session import config_table, settled
from tallyforge.sources.lines import numbered_lines

# The payload that stands in for a benchmark without samples, its id and its prompt.
GENERATED_ID, GENERATED_PROMPT = "-generated-0", "Generated smoke sample for "
GENERATED_PAYLOAD = {
    "answer": "yes",
    "prediction": "yes",
    "confidence": 0.9,
    "success": True,
    "collision_free": True,
    "reference_action": [0.0, 1.0],
    "predicted_action": [0.0, 1.0],
    "steps": 1,
    "cost": 1.0,
    "prefill_ms": 20.0,
    "decode_tok_s": 40.0,
    "memory_gb": 4.0,
    "power_w": 25.0,
    "frame_action_latency_ms": 30.0,
    "scores": {
        "wer": 0.0,
        "cer": 0.0,
        "der": 0.0,
        "eer": 0.0,
        "speaker_eer": 0.0,
        "bleu": 1.0,
        "caption_cider": 1.0,
        "clap_score": 1.0,
        "mos": 4.5,
    },
}


def sample_from_payload(df: DataFrame, fallback: Column, index: Column) -> DataFrame:
    """Adds id, benchmark, dataset, prompt and reference to rows with a ``payload``."""
    return map_prompt_reference(
        df.withColumns(
            {
                "benchmark": F.coalesce(F.expr(first_truthy("payload", ("benchmark",))), fallback),
                "dataset": F.coalesce(F.expr(first_truthy("payload", ("dataset", "source"))), fallback),
            }
        ),
        fallback=fallback,
        index=index,
    )


def _generated(spark: SparkSession, suite: list[Benchmark]) -> DataFrame:
    """One row per benchmark: its generated sample as JSON."""
    rows = [(b.name, b.datasets[0] if b.datasets else b.name, json.dumps(GENERATED_PAYLOAD)) for b in suite]
    listed = config_table(spark, rows, {"suite_benchmark": "string", "dataset": "string", "json": "string"})
    name = F.col("suite_benchmark")
    own = F.to_json(
        F.struct(
            F.concat(safe_name(name), F.lit(GENERATED_ID)).alias("id"),
            name.alias("benchmark"),
            "dataset",
            F.concat(F.lit(GENERATED_PROMPT), name).alias("prompt"),
        )
    )
    # Two objects become one: the first without its closing brace, the second without its opening one.
    whole = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substring("json", 2, 1_000_000))
    return listed.select(
        "suite_benchmark", name.alias("fallback"), F.lit(0).cast("long").alias("line_index"), whole.alias("value")
    )


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    """Benchmarks listed under a key; the pairs come from the suite's configuration."""
    found: dict[str, list[str]] = {}
    for name, benchmark in pairs:
        found.setdefault(name, []).append(benchmark)
    none = F.array().cast("array<string>")
    if not found:
        return none
    table = F.create_map(
        *[x for name, listed in sorted(found.items()) for x in (F.lit(name), F.array(*map(F.lit, sorted(set(listed)))))]
    )
    return F.coalesce(F.try_element_at(table, key), none)


def _with_payload(rows: DataFrame) -> DataFrame:
    """Adds ``payload``: the object a line holds, or what else it holds as prompt and answer."""
    wrapped = f"to_variant_object(struct({text_of('_json')} AS prompt, {text_of('_json')} AS answer))"
    payload = F.expr(f"CASE WHEN {kind('_json')} = 'OBJECT' THEN _json ELSE {wrapped} END")
    return rows.withColumn("_json", F.parse_json("value")).withColumn("payload", payload).drop("_json")


def read_eval_samples(spark: SparkSession, path: str, suite: list[Benchmark]) -> DataFrame:
    """``id, benchmark, dataset, prompt, reference, payload`` for each benchmark of the suite.

    Files named after a benchmark or its dimension come first. A benchmark without
    such a file takes the samples that name it, or one of its datasets, in any file;
    one that has none either gets a generated sample. Files other than JSON Lines
    are passed over. The lines that some benchmark may take are written once below
    the shared folder, so the files are read twice: to count and to match.
    """
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    parsed = _with_payload(lines)
    by_name = [(b.name, b.name) for b in suite]
    by_dataset = [(dataset, b.name) for b in suite for dataset in b.datasets]
    own = F.coalesce(F.expr(first_truthy("payload", ("benchmark",))), F.col("stem"))
    dataset = F.coalesce(F.expr(first_truthy("payload", ("dataset", "source"))), F.col("stem"))

    def tagged(benchmarks: Column, rank: int) -> Column:
        return F.transform(
            benchmarks, lambda b: F.struct(b.alias("suite_benchmark"), F.lit(rank).alias("rank"))
        )

    stem = F.col("stem")
    named = [
        F.when(stem.isin(b.name, b.dimension) | (stem == safe_name(F.lit(b.name))) | (stem == safe_name(F.lit(b.dimension))), b.name)
        for b in suite
    ]
    direct = F.array_compact(F.array(*named)) if suite else F.array().cast("array<string>")
    scanned = F.array_union(_lookup(by_name, own), _lookup(by_dataset, dataset))
    candidates = parsed.select(
        "stem", "line_index", "value", F.explode(F.concat(tagged(direct, 0), tagged(scanned, 1))).alias("c")
    ).select("stem", "line_index", "value", "c.suite_benchmark", "c.rank")
    candidates = settled(candidates, "sample-lines")

    # One row per benchmark of the suite says whether files matched by name.
    best = candidates.groupBy("suite_benchmark").agg(F.min("rank").alias("rank"))
    found = candidates.join(F.broadcast(best), ["suite_benchmark", "rank"])
    # A file picked by name gives its samples the benchmark's name as fallback, a scanned one its own.
    fallback = F.when(F.col("rank") == 0, F.col("suite_benchmark")).otherwise(F.col("stem"))
    chosen = found.select("suite_benchmark", fallback.alias("fallback"), "line_index", "value")
    generated = _generated(spark, suite).join(best, "suite_benchmark", "left_anti")

    rows = _with_payload(chosen.unionByName(generated))
    samples = sample_from_payload(rows, F.col("fallback"), F.col("line_index"))
    return samples.select(
        "id", F.col("suite_benchmark").alias("benchmark"), "dataset", "prompt", "reference", "payload"
    )

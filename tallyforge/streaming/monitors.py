"""Structured Streaming monitors.

What a query carries between micro-batches lies in tables below a shared folder,
one folder per batch id, written with overwrite: a batch that runs again after a
failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.operators.monitors import ALERT_RULES, LOSS_SPIKE_RATIO, AlertRule, alert_rules, loss_spike_ratio
from tallyforge.operators.ordered import islands
from tallyforge.session import settled


def stream_files(
    spark: SparkSession, path: str, glob: str, ts: str, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` becomes a timestamp that can carry a watermark."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def _drain(stream: DataFrame, mode: str, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
    )
    query.awaitTermination()


def _write(rows: DataFrame, folder: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stream_window_alerts(
    events: DataFrame,
    ts: str,
    metrics: dict[str, Column],
    folder: str,
    window: str = "1 day",
    slide: str | None = None,
    watermark: str = "1 hour",
    rules: tuple[AlertRule, ...] = ALERT_RULES,
) -> DataFrame:
    """Window metrics of a stream against the alert rules; tumbling, or sliding with ``slide``.

    ``metrics`` maps metric names to aggregates. Each batch writes the windows it
    changed; the newest version of a window counts, so windows that the watermark
    has not closed yet are there too.
    """
    spark = events.sparkSession
    windows = (
        events.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window, slide))
        .agg(*[measure.alias(name) for name, measure in metrics.items()])
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *metrics)
    )
    out = f"{folder}/windows"
    _drain(windows, "update", folder, lambda rows, batch_id: _write(rows, out, batch_id))
    newest = F.max_by(F.struct(*metrics), "batch").alias("m")
    latest = spark.read.parquet(out).groupBy("window_start", "window_end").agg(newest)
    pairs = F.array(
        *[F.struct(F.lit(name).alias("metric"), F.col(f"m.{name}").cast("double").alias("value")) for name in metrics]
    )
    long = latest.select("window_start", "window_end", F.explode(pairs).alias("p")).select(
        "window_start", "window_end", "p.metric", "p.value"
    )
    return alert_rules(long, rules)


def _micros(interval: str) -> Column:
    zero = F.timestamp_micros(F.lit(0))
    return F.unix_micros(zero + F.expr(f"INTERVAL {interval}"))


def stream_sessions(
    events: DataFrame, ts: str, key: str, folder: str, gap: str = "30 minutes", watermark: str = "1 hour"
) -> DataFrame:
    """``key, session_start, session_end, events, open`` of sessions that end ``gap`` after their last event.

    Each batch joins its events to the sessions that were still open (see
    ``islands``, which splits hot keys), writes those whose end the watermark
    has passed, and carries the others on as a table. At the end of the stream
    the carried ones are there too, flagged ``open``: every event with a time
    is in one session. A late event counts as well; it joins an open session,
    or is one of its own.
    """
    spark = events.sparkSession
    closed, state, seen = f"{folder}/closed", f"{folder}/open", f"{folder}/seen"

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        at = F.unix_micros(ts)
        rows = batch.where(F.col(ts).isNotNull()).select(key, at.alias("start"), at.alias("end"), F.lit(1).cast("long").alias("events"))
        newest = rows.agg(F.max("start").alias("newest"))
        if batch_id > 0:
            rows = rows.unionByName(session.read.parquet(f"{state}/batch={batch_id - 1}"))
            before = session.read.parquet(f"{seen}/batch={batch_id - 1}")
            newest = newest.unionByName(before).agg(F.max("newest").alias("newest"))
        _write(newest, seen, batch_id)
        limit = session.read.parquet(f"{seen}/batch={batch_id}").select(F.col("newest") - _micros(watermark)).scalar()
        ordered = rows.withColumnsRenamed({"start": "_from", "end": "_to"})
        counted = {"events": (F.sum, F.col("events"))}
        # An event exactly ``gap`` later begins the next session.
        merged = islands(ordered, [key], ["_from"], F.col("_from"), F.col("_to"), _micros(gap) - 1, counted)
        merged = settled(merged.select(key, "start", "end", "events", (F.col("end") + _micros(gap) > limit).alias("open")), "sessions")
        _write(merged.where("NOT open").drop("open"), closed, batch_id)
        _write(merged.where("open").drop("open"), state, batch_id)

    _drain(events, "append", folder, handle)
    last = spark.read.parquet(state).agg(F.max("batch").alias("b")).scalar()
    carried = spark.read.parquet(state).where(F.col("batch") == last)
    both = spark.read.parquet(closed).withColumn("open", F.lit(False)).unionByName(carried.withColumn("open", F.lit(True)))
    return both.select(
        key,
        F.timestamp_micros("start").alias("session_start"),
        F.timestamp_micros(F.col("end") + _micros(gap)).alias("session_end"),
        "events",
        "open",
    )


def stream_spike_state(
    steps: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    folder: str,
    rows: int = 10,
    limit: float = LOSS_SPIKE_RATIO,
) -> DataFrame:
    """Spike ratio against the trailing mean, across micro-batches.

    The state is the last ``rows`` rows of each key, kept as a table with one
    folder per batch. A batch reads the newest state of the keys it touches, runs
    the batch operator over that and its own rows, and writes the state of those
    keys only; a hot key is split there too.
    """
    spark = steps.sparkSession
    out, tail = f"{folder}/ratios", f"{folder}/tail"

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        new = settled(batch.withColumn("_new", F.lit(True)), "spike-batch")
        touched = new.select(*keys).distinct()
        seen = new
        if batch_id > 0:
            # Only folders of earlier batches count, also when a batch runs again.
            states = session.read.parquet(tail).filter(F.col("batch") < batch_id)
            theirs = states.join(touched, _same_keys(states, touched, keys), "left_semi")
            newest = theirs.groupBy(*keys).agg(F.max("batch").alias("_newest"))
            kept = theirs.join(newest, _same_keys(theirs, newest, keys) & (theirs["batch"] == newest["_newest"]), "left_semi")
            seen = new.unionByName(kept.drop("batch").withColumn("_new", F.lit(False)))
        judged = loss_spike_ratio(seen, keys, order, value, rows, limit)
        _write(judged.filter("_new").drop("_new"), out, batch_id)
        _write(_last_rows(seen.drop("_new"), keys, order, rows), tail, batch_id)

    _drain(steps, "append", folder, handle)
    return spark.read.parquet(out).drop("batch")


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _last_rows(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """The last rows of each key: a rank limit, which tasks apply to their own rows before any move."""
    backward = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_row", F.row_number().over(backward)).filter(F.col("_row") <= rows).drop("_row")


def split_late_rows(events: DataFrame, ts: str, delay: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows, as two tables.

    Late means older than the newest time of all earlier batches less ``delay``;
    such rows are kept for audit instead of being dropped by a watermark.
    """
    spark = events.sparkSession
    rows, seen = f"{folder}/rows", f"{folder}/seen"

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        newest = batch.agg(F.max(ts).alias("newest"))
        limit = F.lit(None).cast("timestamp")
        if batch_id > 0:
            before = session.read.parquet(f"{seen}/batch={batch_id - 1}")
            newest = newest.unionByName(before).agg(F.max("newest").alias("newest"))
            limit = before.select(F.col("newest") - F.expr(f"INTERVAL {delay}")).scalar()
        routed = batch.withColumn("route", F.when(F.col(ts) < limit, "late").otherwise("timely"))
        routed.write.mode("overwrite").partitionBy("route").parquet(f"{rows}/batch={batch_id}")
        _write(newest, seen, batch_id)

    _drain(events, "append", folder, handle)
    routed = spark.read.parquet(rows).drop("batch")
    return tuple(routed.filter(F.col("route") == route).drop("route") for route in ("timely", "late"))

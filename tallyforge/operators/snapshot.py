"""Digests of tables that tell which part changed, without bringing rows together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading hex digits of a row's digest that name its branch: 256 branches a shard.
BRANCH_DIGITS = 2


def row_digest(columns: list[Column]) -> Column:
    """MD5 of a row's values as text, each behind its length; nulls differ from any text."""
    shown = [F.coalesce(F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*[F.concat(s, F.lit(",")) for s in shown]))


def branch_digests(rows: DataFrame, shard: Column, columns: list[Column], size: Column) -> DataFrame:
    """``shard``, ``branch``, ``rows``, ``size`` and ``digest`` of each branch of each shard.

    A row's branch is named by its own digest. The digest of a branch is made
    of sums over its rows' digests, in four parts, which merge in any order:
    rows shrink before the shuffle, however a table is split, and equal
    tables give equal digests. Repeated rows count each time; a null shard is
    the empty string.
    """
    digest = row_digest(columns)
    placed = rows.select(F.coalesce(shard.cast("string"), F.lit("")).alias("shard"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), digest.alias("d"))
    parts = [F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)]
    folded = placed.groupBy("shard", F.substring("d", 1, BRANCH_DIGITS).alias("branch")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size"), *sums
    )
    whole = F.md5(F.concat_ws(",", F.col("rows").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)]))
    return folded.select("shard", "branch", "rows", "size", whole.alias("digest"))


def manifest_snapshot(branches: DataFrame) -> DataFrame:
    """``shard``, ``rows``, ``size``, ``digest`` of each shard over its branches, and ``snapshot_id`` over all shards.

    A shard has a bounded number of branches; the shards' digests fold by sums
    too. An empty table gives no rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("branch", "digest")))
    text = F.array_join(F.transform(listed, lambda b: F.concat(b["branch"], F.lit(":"), b["digest"])), ",")
    shards = branches.groupBy("shard").agg(F.sum("rows").alias("rows"), F.sum("size").alias("size"), F.md5(text).alias("digest"))
    named = F.md5(F.concat("shard", F.lit(":"), "digest"))
    parts = [F.sum(F.conv(F.substring(named, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    total = shards.agg(F.md5(F.concat_ws(",", *parts)).alias("id"))
    return shards.withColumn("snapshot_id", total.scalar())


def changed_branches(before: DataFrame, after: DataFrame) -> DataFrame:
    """``shard``, ``branch``, ``rows_before``, ``rows_after`` of the branches that differ between two results of ``branch_digests``."""
    keys = ["shard", "branch"]
    old = before.select(*keys, F.col("rows").alias("rows_before"), F.col("digest").alias("_old"))
    new = after.select(*keys, F.col("rows").alias("rows_after"), F.col("digest").alias("_new"))
    met = old.join(new, keys, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return met.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows_before", "rows_after")])

"""Helpers shared by the operators: settled tables, word units and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import settled as settle

#: Code points that end a word; every other code point belongs to one.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def word_count(text):
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def own_name(columns: list[str], wish: str) -> str:
    """``wish``, or with underscores behind it where the table already has such a column."""
    taken = {c.lower() for c in columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def components(links: DataFrame, name: str, max_rounds: int = 64) -> DataFrame:
    """Distributed union-find over links ``a``, ``b`` (long): each linked ``node`` with its smallest reachable ``root``.

    Rounds of large-star and small-star. Each round replaces the links by as
    many links to smaller nodes and is settled, so no task and no driver
    holds a component. A node with very many links is a skewed join key,
    which adaptive execution splits. No links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settle(links, f"{name}-links")
    mark = _mark(links)
    for _ in range(max_rounds):
        links = settle(_small_star(_large_star(links)), f"{name}-links")
        now = _mark(links)
        if now == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b"), F.col("b")).distinct()
            )
        mark = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour, or to the node itself."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

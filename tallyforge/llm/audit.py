"""Filter interaction audit: what each filter of a chain removes in every order of the chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import WORD_PATTERN, settle


def _many(count: Column) -> Column:
    return count.cast("long")


#: Conditions of failure over the text and its words, by letter. One more letter, ``COPY``, fails later copies of a text.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * _many(F.size(F.array_distinct(words))) < 50 * _many(F.size(words)),
    "C": lambda text, words: 100 * _many(F.regexp_count(text, F.lit("[A-Z]"))) > 2 * _many(F.length(text)),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPY = "E"

#: A level appends one unused letter to each prefix. Per mask cell it tells whether the cell is kept, removed here,
#: or fails here although removed before; ``applied`` holds the bits of all letters so far.
ENUMERATE = """
WITH RECURSIVE levels(prefix, letter, step, applied, mask, kept, removed, redundant, only_here) AS (
    SELECT CAST('' AS STRING), CAST('' AS STRING), 0, 0, mask, true, false, false, false FROM {masks}
    UNION ALL
    SELECT concat(prefix, next.letter), next.letter, step + 1, applied | next.bit, mask,
        mask & (applied | next.bit) = 0,
        mask & next.bit <> 0 AND mask & applied = 0,
        mask & next.bit <> 0 AND mask & applied <> 0,
        mask = next.bit
    FROM levels LATERAL VIEW explode(filter({filters}, f -> applied & f.bit = 0)) AS next
)
SELECT * FROM levels WHERE step > 0
"""


def mask_cells(
    docs: DataFrame,
    labels: DataFrame,
    rules: dict[str, Callable[[Column, Column], Column]] = RULES,
    copy: str = COPY,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """``part``, ``mask`` and the documents (``n``), good and toxic ones among them, that fail just the filters of the mask.

    Bit i of a mask is the i-th letter of ``rules`` and then ``copy``, which
    fails a document whose text some document of smaller id has too.

    Null texts are empty, null parts are the empty string. A document without
    an id fails ``copy`` never and makes none fail; rows that repeat an id and
    its text are documents of their own and no copies of each other. A
    document is good or toxic if any of its labels says so. Texts do not move:
    their digests do, with equal rows counted before the shuffle, and only
    digests met twice are looked up again.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("words", F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0)))
    bits = [F.when(rule(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, rule in enumerate(rules.values())]
    slim = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("key"), sum(bits, F.lit(0)).alias("mask"))
    slim = slim.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    marked = slim.join(said, "id", "left").select("id", "part", "key", "mask", "n", *flags)
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    nameless = F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0))
    texts = settle(
        marked.groupBy("key", "mask", "part", "good", "toxic").agg(
            F.sum("n").alias("n"), first.alias("first"), nameless.alias("nameless")
        ),
        "audit-texts",
    )
    shared = texts.groupBy("key").agg(F.min("first.id").alias("least"), F.sum("n").alias("all")).where("all > 1")
    met = texts.join(shared.select("key", "least"), "key", "left")
    earliest = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("nameless")
    fresh = F.when(F.col("least").isNull(), F.col("n")).otherwise(earliest)
    pairs = met.withColumn("fresh", fresh).select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct("mask", F.col("fresh").alias("n")),
                F.struct(F.col("mask").bitwiseOR(1 << len(rules)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
            )
        ),
    )
    counts = [F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return pairs.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), *counts)


def order_metrics(cells: DataFrame, letters: str) -> DataFrame:
    """Per part, order of the letters and step: what is kept, removed and lost there.

    ``cells`` are those of ``mask_cells``. A recursive query extends prefixes
    of letters; its rows are prefixes times masks, of which there are at most
    2 to the number of letters, however large the table is. A step of an
    order counts what its prefix counts. ``shapley`` sums what a letter
    removes over all orders. No cells give no rows.
    """
    spark = cells.sparkSession
    structs = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << i})" for i, x in enumerate(letters))
    masks = cells.select("mask").distinct()
    levels = settle(spark.sql(ENUMERATE.format(masks="{masks}", filters=f"array({structs})"), masks=masks), "audit-levels")
    removed = F.col("removed")

    def count(condition, n="n") -> Column:
        return F.sum(F.when(condition, F.col(n)).otherwise(0))

    metrics = cells.join(F.broadcast(levels), "mask").groupBy("part", "prefix", "letter", "step")
    metrics = metrics.agg(
        count(F.col("kept")).alias("kept"),
        count(removed).alias("removed"),
        count(F.col("redundant")).alias("redundant"),
        count(F.col("only_here")).alias("unique_fails"),
        count(removed, "good").alias("good_lost"),
        count(removed, "toxic").alias("toxic_lost"),
    )
    prefixes = levels.select("prefix", "step").distinct()
    orders = prefixes.where(F.col("step") == len(letters)).select(
        F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("at")
    )
    orders = orders.select("filter_order", F.substring("filter_order", F.lit(1), F.col("at")).alias("prefix"))
    # Each part has every order of a letter, so a group has as many rows as there are orders.
    over_orders = Window.partitionBy("part", "letter")
    return metrics.join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(over_orders).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Audit of the five filters A to E over whole texts, per part; see ``mask_cells`` and ``order_metrics``."""
    cells = settle(mask_cells(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col), "audit-cells")
    return order_metrics(cells, "".join(RULES) + COPY)

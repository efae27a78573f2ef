"""Keyed series of numbers over time: active segments, scaling by quantiles, repeated series by landmarks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordered import crowded, framed, islands
from tallyforge.operators.quantiles import exact_quantiles
from tallyforge.session import settled


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def activity_segments(
    series: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    value: str,
    threshold: float,
    gap: float,
    min_length: float,
) -> DataFrame:
    """Active segments of each key: ``start`` and ``end`` (seconds), ``rows``, ``total`` and ``peak`` of their active values.

    A row is active from ``threshold`` on. Neighbouring active rows are one
    run; runs not more than ``gap`` seconds apart are one segment; segments of
    ``min_length`` seconds or more stay. Null and NaN values are not active,
    rows without a time take no part, and a null key is a key.
    """
    rows = series.where(F.col(ts).isNotNull())
    at, number = seconds(ts), F.col(value).cast("double")
    active = (number >= threshold) & ~F.isnan(number)
    found = islands(rows, keys, [ts, tie], at, at, gap, {"total": (F.sum, number), "peak": (F.max, number)}, active)
    return found.where(F.col("end") - F.col("start") >= min_length)


def normalize_by_quantiles(
    rows: DataFrame, group: list[str], value: str, low: float = 0.01, high: float = 0.99, out: str = "scaled"
) -> DataFrame:
    """Adds ``out``: the value scaled so that the group's two quantiles are -1 and 1, and clipped there.

    Quantiles are exact. A group of one value, or whose quantiles are equal,
    gives 0. Null and NaN values stay null; all rows come back.
    """
    spans = exact_quantiles(rows, group, F.col(value), {"_q_low": low, "_q_high": high}).drop("n")
    named = spans.withColumnsRenamed({g: f"_of_{g}" for g in group})
    same = reduce(lambda a, b: a & b, [rows[g].eqNullSafe(named[f"_of_{g}"]) for g in group])
    number, width = F.col(value).cast("double"), F.col("_q_high") - F.col("_q_low")
    scaled = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (number - F.col("_q_low")) / F.when(width != 0, width) - 1))
    scaled = F.when(number.isNull() | F.isnan(number), F.lit(None)).when(width == 0, 0.0).otherwise(scaled)
    return rows.join(named, same, "left").withColumn(out, scaled).drop("_q_low", "_q_high", *[f"_of_{g}" for g in group])


#: A key with more rows is cut into chunks; the others are each in one task, which takes one shuffle.
KEY_ROWS = 100_000


def landmarks(
    series: DataFrame, key: str, ts: str, tie: str, value: str, unit: float, bucket: float, fan: int = 3, key_rows: int = KEY_ROWS
) -> DataFrame:
    """Distinct landmarks of each key: ``key``, its first time ``begin``, ``at`` and the parts ``first``, ``second``, ``apart`` of the mark.

    A peak is a value above the one before and not below the one behind it.
    Each peak makes a mark with each of the next ``fan`` peaks: both heights in
    buckets of ``bucket`` and their distance in units of ``unit`` seconds.
    ``at`` is the peak's time in units. A mark does not depend on when a series
    began. The ends of a series are no peaks. Rows without a key, time or number take no
    part; equal times are in order of ``tie``.
    """
    number = F.col(value).cast("double")
    rows = series.select(F.col(key).alias("key"), ts, tie, number.alias("v")).where(
        F.col("key").isNotNull() & F.col(ts).isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")
    )
    at, height = F.floor(seconds(ts) / unit).cast("long"), F.floor(F.col("v") / bucket).cast("long")
    ahead = {f"next{i}": lambda w, i=i: F.lead(F.struct("at", "height"), i).over(w) for i in range(1, fan + 1)}

    def marked(rows, frame):
        near = frame(rows, 1, 1, {"before": lambda w: F.lag("v").over(w), "behind": lambda w: F.lead("v").over(w)})
        peaks = near.where((F.col("v") > F.col("before")) & (F.col("v") >= F.col("behind")))
        linked = frame(peaks.select("key", ts, tie, at.alias("at"), height.alias("height")), 0, fan, ahead)
        marks = linked.withColumn("next", F.explode(F.array(*ahead))).where(F.col("next").isNotNull())
        parts = [F.col("height").alias("first"), F.col("next.height").alias("second"), (F.col("next.at") - F.col("at")).alias("apart")]
        return marks.select("key", *["begin"] * ("begin" in marks.columns), "at", *parts).distinct()

    def whole(rows, before, after, outs):
        along = Window.partitionBy("key").orderBy(ts, tie)
        begin = {"begin": F.min("at").over(along.rowsBetween(Window.unboundedPreceding, 0))} if "at" in rows.columns else {}
        return rows.withColumns({name: out(along) for name, out in outs.items()} | begin)

    long = settled(crowded(rows, "key", key_rows), "series-long")
    if long.isEmpty():
        return marked(rows, whole)
    cut = marked(rows.join(long, "key", "left_semi"), lambda df, *asked: framed(df, ["key"], [ts, tie], *asked))
    cut = settled(cut, "series-cut")
    cut = cut.join(cut.groupBy("key").agg(F.min("at").alias("begin")), "key")
    return marked(rows.join(long, "key", "left_anti"), whole).unionByName(cut)


MARK = ["first", "second", "apart"]


def _copies(marks: DataFrame) -> DataFrame:
    """``key``, ``rep`` and ``shift`` from ``rep``: keys with the same marks at the same distances, and their smallest key.

    Sums over the marks, which merge, tell series apart; no list of a key's marks is made.
    """
    placed = marks.select("key", "begin", F.xxhash64(*MARK, F.col("at") - F.col("begin")).alias("h"))
    folded = placed.groupBy("key", "begin").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftright("h", 8).cast("decimal(38,0)")).alias("s")
    )
    same = ["n", "x", "s"]
    reps = folded.groupBy(*same).agg(F.min(F.struct("key", "begin")).alias("rep"))
    return folded.join(reps, same).select("key", F.col("rep.key").alias("rep"), (F.col("begin") - F.col("rep.begin")).alias("shift"), "n")


def _single(marks: DataFrame, copies: DataFrame) -> DataFrame:
    """Marks of the keys that stand for themselves; the shorter list of keys is looked up."""
    rest, reps = (copies.where(kind).select("key") for kind in ("key != rep", "key = rep"))
    if rest.isEmpty():
        return marks
    fewer, how = (rest, "left_anti") if rest.count() < reps.count() else (reps, "left_semi")
    return settled(marks.join(settled(fewer, "series-keys"), "key", how), "series-single")


PAIR = ["key_a", "key_b", "shift"]

#: Marks that occur at most so often meet by themselves; commoner ones meet in twos.
RARE = 40
#: A key with more common marks of a class meets by single marks: its twos would be too many. They are counted in 16 bits.
CLASS_MARKS = 256


def _met(a: DataFrame, b: DataFrame, on: list[str], n: str, twos: str) -> DataFrame:
    """A row for each meeting of ``a`` with a greater key of ``b``: the pair, and what it counts for (``n``, ``twos``)."""
    a, b = (x.withColumnsRenamed({"key": f"key_{side}", "at": f"at_{side}"}) for x, side in ((a, "a"), (b, "b")))
    return a.join(b, on).where("key_a < key_b").selectExpr("key_a", "key_b", "at_b - at_a AS shift", f"{n} AS n", f"{twos} AS twos")


def _twos(marks: DataFrame) -> DataFrame:
    """``key``, ``class``, ``at`` and digest ``two`` of each two marks of a key and class; ``at`` is of the first, ``two`` has their distance."""
    one = marks.select("key", "class", "at", F.xxhash64(*MARK).alias("m"))
    ordered = "at < at_2 OR at = at_2 AND m < m_2"
    found = one.join(one.withColumnsRenamed({"at": "at_2", "m": "m_2"}), ["key", "class"]).where(ordered)
    return found.select("key", "class", "at", F.xxhash64("m", "m_2", F.col("at_2") - F.col("at")).alias("two"))


def _held(pairs: DataFrame, on: list[str], marks: DataFrame) -> DataFrame:
    """``pairs`` once for each mark of a that b has too at the shift; ``on`` are the columns of ``pairs`` that choose a's marks."""
    mine = marks.withColumnsRenamed({"key": "key_a", "at": "at_a"})
    moved = pairs.join(mine, on).select(*PAIR, (F.col("at_a") + F.col("shift")).alias("at"), *MARK)
    asked = marks.join(pairs.select(F.col("key_b").alias("key")), "key", "left_semi")
    return moved.join(asked.select(F.col("key").alias("key_b"), "at", *MARK), ["key_b", "at", *MARK]).select(*PAIR)


def _likely(marks: DataFrame, votes: int, rare: int, class_marks: int) -> DataFrame:
    """``PAIR`` of all that share ``votes`` marks or more at one shift, and of few others.

    Marks that occur ``rare`` times at most meet by themselves. The commoner
    ones are dealt by what they are into classes, fewer than ``votes``, so of ``votes``
    shared ones two are of one class. Two marks of a class and the distance
    between them are far rarer than a mark, so common marks meet in twos. ``k``
    shared marks of a class make ``k (k - 1) / 2`` twos: all that is not known
    then is one mark at most for each class that did not meet, and what cannot reach
    ``votes`` with these is left out. A key with more than ``class_marks`` common marks
    of a class meets by single marks, all of which count.
    """
    marks, classes, class_marks = marks.select("key", "at", *MARK), max(1, min(3, votes - 2)), min(class_marks, CLASS_MARKS)
    counts = marks.groupBy(*MARK).agg(F.count(F.lit(1)).alias("f"))
    often = counts.where(F.col("f") > rare if votes > 1 else F.lit(False))
    often = settled(often.select(*MARK, F.pmod(F.xxhash64(*MARK), F.lit(classes)).cast("int").alias("class")), "series-often")
    seldom, common = marks.join(often, MARK, "left_anti"), settled(marks.join(often, MARK), "series-common")
    met = _met(seldom, seldom, MARK, "1L", "0L")

    sizes = common.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.expr("bit_or(shiftleft(1, class))").alias("open"), F.max("n").alias("most"))
    sizes = settled(sizes, "series-classes")
    large, short = sizes.where(F.col("most") > class_marks).select("key"), common
    if not large.isEmpty():
        short, long = common.join(large, "key", "left_anti"), common.join(large, "key", "left_semi")
        met = met.union(_met(long, common, MARK, "1L", "0L")).union(_met(short, long, MARK, "1L", "0L"))
    two = _twos(short)
    met = met.union(_met(two, two, ["two", "class"], "0L", "shiftleft(1L, 16 * class)"))
    met = settled(met.groupBy(*PAIR).agg(F.sum("n").alias("n"), F.sum("twos").alias("twos")), "series-met")

    twos = [f"(shiftright(twos, {16 * c}) & 65535)" for c in range(classes)]
    known = " + ".join(["n", *[f"IF({x} > 0, CAST((1 + sqrt(1 + 8 * {x})) / 2 AS BIGINT), 0)" for x in twos]])
    waiting = " | ".join(f"IF({x} > 0, 0, {1 << c})" for c, x in enumerate(twos))
    reach = F.col("known") + F.bit_count("waiting") >= votes
    near = met.selectExpr(*PAIR, f"{known} AS known", f"{waiting} AS waiting").where(reach)
    for side in ("key_a", "key_b"):
        has = sizes.select(F.col("key").alias(side), F.when(F.col("most") <= class_marks, F.col("open")).otherwise(0).alias("open"))
        near = near.join(has, side, "left").withColumn("waiting", F.expr("waiting & coalesce(open, 0)")).drop("open").where(reach)
    near = settled(near, "series-near")
    # A pair that needs a mark of each class that waits is asked for one of them before all its marks are counted.
    needs_all = (F.col("known") < votes) & (F.col("known") + F.bit_count("waiting") == votes)
    first = F.expr("CASE WHEN waiting & 1 > 0 THEN 0 WHEN waiting & 2 > 0 THEN 1 ELSE 2 END").alias("class")
    found = _held(near.where(needs_all).select(*PAIR, first), ["key_a", "class"], common).distinct()
    return settled(near.where(~needs_all).select(*PAIR).union(found), "series-likely")


def repeated_series(
    series: DataFrame,
    key: str,
    ts: str,
    tie: str,
    value: str,
    unit: float = 3600.0,
    bucket: float = 10.0,
    fan: int = 3,
    votes: int = 5,
    rare: int = RARE,
    class_marks: int = CLASS_MARKS,
) -> DataFrame:
    """Pairs of keys whose series repeat each other, shifted in time: ``key_a``, ``key_b``, ``shift``, ``votes``, ``copy``.

    Marks of two keys vote for the time between them (``shift``, in units,
    added to a's times); a pair with ``votes`` or more for one shift counts,
    with its best one, ties to the smaller. See ``landmarks`` for the marks.

    Keys with the same marks throughout are copies (``copy``): each is paired
    with the smallest of them only, and that one stands for them in the other
    pairs, so a group of any size gives as many rows as it has keys. Keys meet
    through rare marks and through twos of common ones (``_likely``), which loses no
    pair; votes are counted for the pairs that can have enough of them.
    Frequent marks thus neither meet all their keys nor get lost. Series with fewer than ``votes`` marks are
    never paired; an empty table gives no rows.
    """
    marks = settled(landmarks(series, key, ts, tie, value, unit, bucket, fan), "series-marks")
    copies = settled(_copies(marks), "series-copies")
    single = _single(marks, copies).select("key", "at", *MARK)
    voted = _held(_likely(single, votes, rare, class_marks), ["key_a"], single)
    histogram = voted.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("shift")).alias("back"))).alias("best")
    counted = histogram.where(F.col("votes") >= votes).groupBy("key_a", "key_b").agg(best)
    matched = counted.select("key_a", "key_b", (-F.col("best.back")).alias("shift"), F.col("best.votes").alias("votes"), F.lit(False).alias("copy"))
    repeated = copies.where((F.col("key") != F.col("rep")) & (F.col("n") >= votes)).select(
        F.col("rep").alias("key_a"), F.col("key").alias("key_b"), "shift", F.col("n").alias("votes"), F.lit(True).alias("copy")
    )
    return matched.unionByName(repeated)

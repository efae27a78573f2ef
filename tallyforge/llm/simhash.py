"""SimHash near-duplicates by ball hashing that meets in the middle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyforge.llm.common import components, own_name, settle

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2


def simhash(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint: a bit is set where over half of the shingle hashes have it.

    Words are runs without ASCII white space, A-Z lower-cased; shingles keep
    repeats. Fewer words than a shingle holds make one shingle; no word, as in
    null or empty texts, gives zero.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    if len(found) > words:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
        count = len(found) - words + 1
    else:
        shingles, count = [b" ".join(found)], 1
    totals = np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64, count=count)
    for start in range(0, count, 65_536):
        part = hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8)
        totals += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(totals * 2 > count, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.arrow_udf(LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array([simhash(t.as_py()) for t in texts], pa.int64())


def near_links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect all pairs differing in at most ``radius`` bits.

    ``fingerprints`` has one distinct, non-null long column ``fingerprint``.
    Each one goes to itself and to all variants within half the radius; two
    fingerprints within the radius share a variant. Those that meet at a
    variant lie pairwise within the radius, and there are at most as many as
    the ball has points, so a link to the smallest of them keeps all
    connections without pairing the group. Every link is verified.
    """
    if radius not in (0, 2):
        raise ValueError("the ball of half the radius is built for radius 0 and 2")
    if radius == 0:
        return fingerprints.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).where("false")
    masks = F.expr("concat(array(0L), transform(sequence(0, 63), i -> shiftleft(1L, i)))")
    variants = fingerprints.select("fingerprint", F.explode(masks).alias("mask")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant")
    )
    least = F.min("fingerprint").over(Window.partitionBy("variant"))
    return (
        variants.select(F.col("fingerprint").alias("a"), least.alias("b"))
        .where("a <> b")
        .distinct()
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most two
    differing bits, null where no reachable row has an id. Rows that repeat an
    id are rows of their own. Null, empty and wordless texts have fingerprint
    zero and are linked like any other. An empty table gives no rows. Other
    columns of ``docs`` are not touched, whatever they are called.
    """
    marked = settle(
        docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text_col)).alias("fingerprint")), "simhash"
    )
    return marked.join(_classes(marked), "fingerprint").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _classes(marked: DataFrame) -> DataFrame:
    """Each distinct ``fingerprint`` with the smallest ``id`` of its component."""
    distinct = settle(marked.groupBy("fingerprint").agg(F.min("id").alias("id")), "simhash-distinct")
    roots = components(near_links(distinct.select("fingerprint")), "simhash")
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "id", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = settle(rooted, "simhash-rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(least, "root").select("fingerprint", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each near-duplicate group, columns as they came.

    The row with the smallest id stays (nulls last, ties to the smaller text
    hash); of identical rows one stays. Texts move once, to meet the slim list
    of winners.
    """
    key, won_id, won_key = (own_name(docs.columns, n) for n in ("text_key", "winner_id", "winner_key"))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), text_col)
    marked = settle(rows.select("id", "key", fingerprint_of(F.col(text_col)).alias("fingerprint")), "simhash")
    distinct = settle(marked.select("fingerprint").distinct(), "simhash-distinct")
    roots = components(near_links(distinct), "simhash").withColumnRenamed("node", "fingerprint")
    place = F.struct(F.col("id").isNull().alias("late"), "id", "key")
    least = marked.groupBy("fingerprint").agg(F.min(place).alias("place"))
    winners = (
        least.join(roots, "fingerprint", "left")
        .groupBy(F.coalesce("root", "fingerprint"))
        .agg(F.min("place").alias("place"))
        .select(F.col("place.id").alias(won_id), F.col("place.key").alias(won_key))
    )
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    kept = keyed.join(winners, keyed[id_col].eqNullSafe(winners[won_id]) & (keyed[key] == winners[won_key]), "left_semi")
    return kept.dropDuplicates([id_col, key]).select(*docs.columns)

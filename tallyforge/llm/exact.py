"""Exact top-k inner products by a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from tallyforge.llm.common import settle

#: Pivots, and about how many vectors they are chosen from. Both bound what the driver and every executor hold.
PIVOTS = 64
SAMPLE_VECTORS = 4_096
#: Candidates and queries that meet in one task, and candidates evaluated first in order of their bounds.
PART_VECTORS = 4_000
PART_QUERIES = 1_000
STEP_VECTORS = 256
#: Queries whose bounds are computed together.
STEP_QUERIES = 32
#: What distances, kept in single precision, and products are off by at most, relative to the largest ones.
DISTANCE_SLACK = 1e-6
PRODUCT_SLACK = 1e-12


@dataclass
class Pivots:
    """Pivots in a space where larger inner products are smaller distances.

    A vector x becomes (x, sqrt(m - |x|^2)) with m the largest squared norm,
    and a query q becomes (q, 0); their squared distance is |q|^2 + m - 2 q.x.
    """

    points: np.ndarray
    largest: float

    def lift(self, vectors: np.ndarray, asking: bool) -> np.ndarray:
        rest = np.zeros(len(vectors)) if asking else np.sqrt(np.maximum(self.largest - (vectors**2).sum(axis=1), 0.0))
        return np.column_stack([vectors, rest])

    def distances(self, vectors: np.ndarray, asking: bool = False) -> np.ndarray:
        own = self.lift(vectors, asking)
        squares = (own**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None] - 2 * own @ self.points.T
        return np.sqrt(np.maximum(squares, 0.0))

    def product_bound(self, norm: float, apart) -> np.ndarray:
        """The largest inner product of a query of squared norm ``norm`` with vectors at least ``apart`` away."""
        apart = np.maximum(apart - DISTANCE_SLACK * (1.0 + self.largest**0.5), 0.0)
        return (norm + self.largest - apart**2) / 2 + PRODUCT_SLACK * (1.0 + norm + self.largest)


def choose(sample: np.ndarray, largest: float, count: int = PIVOTS) -> Pivots:
    """Pivots far from each other: each is the sampled vector farthest from those before it."""
    pivots = Pivots(np.zeros((0, sample.shape[1] + 1)), largest)
    lifted = pivots.lift(sample, False)
    chosen, away = [0], ((lifted - lifted[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
    pivots.points = lifted[chosen]
    return pivots


def bounds(pivots: Pivots, norms: np.ndarray, to_pivots: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) with candidates (columns), from both tables of distances.

    The greatest difference of distances over all pivots is the least
    distance. ``table`` has a row per pivot.
    """
    apart = np.zeros((len(to_pivots), table.shape[1]), table.dtype)
    step = np.empty_like(apart)
    for own, row in zip(to_pivots.T, table):
        np.subtract(row, own[:, None], out=step)
        np.abs(step, out=step)
        np.maximum(apart, step, out=apart)
    return pivots.product_bound(norms[:, None], apart.astype(float))


def best(bound: np.ndarray, query: np.ndarray, known: float, points: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best of ``points``, best first, ties to the smaller ``least``.

    Candidates are evaluated from the highest ``bound`` on, in steps that
    grow, until the bound is below the ``k``-th score or below ``known``, a
    score that is reached elsewhere by ``k`` of them.
    """
    rest, limit, size = np.arange(len(points)), known, STEP_VECTORS
    places, scores = np.zeros(0, np.int64), np.zeros(0, points.dtype)
    while True:
        rest = rest[bound[rest] >= limit]
        if not len(rest):
            break
        now, rest = rest, rest[:0]
        if len(now) > size:
            order = np.argpartition(-bound[now], size)
            now, rest = now[order[:size]], now[order[size:]]
        found = points[now] @ query
        places, scores = np.concatenate([places, now[found >= limit]]), np.concatenate([scores, found[found >= limit]])
        front = np.lexsort((least[places], -scores))[:k]
        places, scores = places[front], scores[front]
        limit, size = max(known, scores[-1]) if len(scores) == k else known, 4 * size
    return places, scores


def whole_numbers(embedding: Column, scale: int) -> Column:
    return F.transform(embedding, lambda x: F.floor(scale * x.cast("double")).cast("long"))


def valid(embedding: Column) -> Column:
    """Not null, not empty, without null or non-finite components. Zero vectors are valid."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(finite, F.lit(False))


def _matrix(column, dtype=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype, copy=False)


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each row that satisfies ``is_query`` the ``k`` other rows of highest score: query_id, rank, ``id_col``, score.

    A component x counts as floor(scale * x); the score is the inner product of
    these whole numbers, ties go to the smaller id. The result is exact.

    Distances of all vectors to the pivots are computed once. Vectors lie in
    the cell of their nearest pivot. A query first meets a part of its own
    cell, which yields a score it reaches at least, and then only cells whose
    bounds allow that score. Cells and their queries are dealt in parts of
    bounded size. Equal vectors are one class among candidates and queries,
    for which its ``k + 1`` smallest ids stand, so hot copies cost one vector.

    Rows without an id or with an invalid vector (see ``valid``) take no part,
    nor do vectors of another length than the most frequent one. Rows that
    repeat an id and its vector are one; an id with several vectors is a
    candidate and a query with each of them. With fewer than
    ``k`` others all are returned; an empty table gives no rows. Scores that
    need more than 64 bits wrap.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).alias("given"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & valid(F.col("given")))
    rows = settle(rows.select("id", whole_numbers(F.col("given"), scale).alias("v"), "asks"), "topk-rows")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint")
    rows = rows.where(F.size("v") == length["n"])
    classes = rows.groupBy("v").agg(F.min("id").alias("least"), F.max("asks").alias("asks"))
    # Numbers given while writing are read from then on and never drawn again.
    classes = settle(classes.select(F.monotonically_increasing_id().alias("class"), "v", "least", "asks"), "topk-classes")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    stats = classes.agg(F.max(norm).alias("largest"), F.count("*").alias("n")).first()
    # Sums of products of whole numbers are exact below 2^24 and 2^53; larger ones take slower arithmetic.
    exact_in = next((kind for kind, end in ((np.float32, 2.0**24), (np.float64, 2.0**53)) if stats["largest"] < end), np.int64)
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_VECTORS / stats["n"]))
    sample = classes.where(drawn).select("v").limit(2 * SAMPLE_VECTORS).toPandas()["v"]
    if not len(sample):
        sample = classes.select("v").limit(PIVOTS).toPandas()["v"]
    pivots = choose(np.stack(sorted(map(tuple, sample))).astype(float), stats["largest"])
    shared = spark.sparkContext.broadcast((pivots.points, pivots.largest))

    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Pivots(*shared.value)
        for batch in batches:
            away = own.distances(_matrix(batch, float)) if len(batch) else np.zeros((0, 1))
            yield pa.StructArray.from_arrays(
                [pa.array(list(away.astype(np.float32)), pa.list_(pa.float32())), pa.array(away.argmin(axis=1), pa.int32())], names=["away", "cell"]
            )

    kind = StructType().add("away", ArrayType(FloatType())).add("cell", IntegerType())
    table = classes.withColumn("to", F.arrow_udf(measure, kind)(F.col("v")))
    table = settle(table.select("class", "v", "least", "asks", "to.away", "to.cell"), "topk-table")
    many = len(pivots.points)
    spans = [f(F.get("away", F.lit(i))) for f in (F.min, F.max) for i in range(many)]
    cells = table.groupBy("cell").agg(F.count("*").alias("n"), F.array(*spans).alias("spans")).orderBy("cell").toPandas()
    parts = {int(c): -(-int(n) // PART_VECTORS) for c, n in zip(cells["cell"], cells["n"])}
    spans = np.stack(cells["spans"])
    ranges = spark.sparkContext.broadcast((cells["cell"].to_numpy(np.int32), spans[:, :many], spans[:, many:]))
    n_parts = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    placed = table.withColumn("part", F.pmod("class", n_parts[F.col("cell")]).cast("int"))

    def meet(asked: DataFrame) -> DataFrame:
        """Best candidates of each asked row (``cell``, ``part``, ``asker``, ``q``, ``known``) in that part of that cell."""
        asked = settle(asked, "topk-asked")
        load = asked.groupBy("cell", "part").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("slices"))
        held = placed.join(load, ["cell", "part"]).select(
            "cell", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "class", "v", "least", "away"
        )
        asked = asked.join(load, ["cell", "part"]).withColumn("slice", F.pmod("asker", "slices").cast("int")).drop("slices")
        keys = ["cell", "part", "slice"]

        def score(held: pa.Table, asked: pa.Table) -> pa.Table:
            own = Pivots(*shared.value)
            out: list[list] = [[], [], [], []]
            if held.num_rows and asked.num_rows:
                points, table = _matrix(held["v"].combine_chunks(), exact_in), _matrix(held["away"].combine_chunks(), np.float32)
                names, least = held["class"].to_numpy(), held["least"].to_numpy()
                queries = _matrix(asked["q"].combine_chunks(), exact_in)
                askers, known, table = asked["asker"].to_pylist(), asked["known"].to_pylist(), np.ascontiguousarray(table.T)
                for first in range(0, len(queries), STEP_QUERIES):
                    group = queries[first : first + STEP_QUERIES].astype(float)
                    away = own.distances(group, asking=True).astype(np.float32)
                    limits = bounds(own, (group**2).sum(axis=1), away, table)
                    for i, bound in enumerate(limits, start=first):
                        least_score = -np.inf if known[i] is None else known[i]
                        places, scores = best(bound, queries[i], least_score, points, least, k + 1)
                        found = [askers[i]] * len(places), names[places], least[places], scores.astype(np.int64)
                        for values, more in zip(out, found):
                            values.extend(more)
            columns = [pa.array(c, pa.int64()) for c in out]
            return pa.table(columns, names=["asker", "class", "least", "score"])

        return held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(
            score, "asker bigint, class bigint, least bigint, score bigint"
        )

    asking = placed.where("asks").select("cell", "part", F.col("class").alias("asker"), F.col("v").alias("q"))
    near = meet(asking.withColumn("known", F.lit(None).cast("long")))
    known = near.groupBy("asker").agg(F.count("*").alias("n"), F.min("score").alias("known")).where(F.col("n") > k)

    def reach(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own, (names, low, high) = Pivots(*shared.value), ranges.value
        for vectors, known in batches:
            result = []
            if len(vectors):
                queries = _matrix(vectors, float)
                for query, d, limit in zip(queries, own.distances(queries, asking=True), known.to_pylist()):
                    bound = own.product_bound(float(query @ query), np.maximum(low - d, d - high).max(axis=1))
                    result.append(names if limit is None else names[bound >= limit])
            yield pa.array(result, pa.list_(pa.int32()))

    wider = asking.select("asker", "q").join(known.select("asker", "known"), "asker", "left")
    wider = wider.withColumn("cell", F.explode(F.arrow_udf(reach, ArrayType(IntegerType()))("q", "known")))
    wider = wider.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts[F.col("cell")] - 1)))
    front = Window.partitionBy("asker").orderBy(F.desc("score"), "least")
    found = meet(wider).withColumn("at", F.row_number().over(front)).where(F.col("at") <= k + 1)
    keyed = rows.join(classes.select("v", "class"), "v").groupBy("id", "class").agg(F.max("asks").alias("asks"))
    keyed = settle(keyed, "topk-keys")
    by_id = Window.partitionBy("class").orderBy("id")
    members = keyed.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).select("class", "id")
    ranks = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    # Per asking class the k + 1 best rows; a query leaves itself out of them.
    answers = found.select("asker", "class", "score").join(members, "class")
    answers = answers.withColumn("at", F.row_number().over(ranks)).where(F.col("at") <= k + 1)
    queries = keyed.where("asks").select(F.col("id").alias("query_id"), F.col("class").alias("asker"))
    own_ranks = Window.partitionBy("query_id", "asker").orderBy(F.desc("score"), "id")
    return (
        queries.join(answers, "asker")
        .where("id <> query_id OR class <> asker")
        .withColumn("rank", F.row_number().over(own_ranks))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )

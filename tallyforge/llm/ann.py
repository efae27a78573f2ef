"""Approximate nearest neighbours over balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallyforge.llm.common import settle

#: Bounds of what the driver fits and every executor holds: sampled vectors, calibration queries, centroids.
SAMPLE_VECTORS = 20_000
SAMPLE_QUERIES = 200
MAX_CENTROIDS = 2_048
#: Vectors of a list in the sample, links of a centroid in the graph, expansions when a vector is assigned.
LIST_VECTORS = 40
GRAPH_LINKS = 24
EXPANSIONS = 24
#: A vector is in its nearest list and in up to so many, if they are at most this much farther.
REPLICAS = 4
CLOSURE = 1.2
#: Share of sampled neighbours whose lists the calibrated distance ratio has to reach.
REACH = 0.95
#: Vectors of a list that are searched in one task.
PART_VECTORS = 4_000


@dataclass
class Lists:
    """Centroids, the graph over them, and the distance ratio up to which a query's lists are searched."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray
    ratio: float

    def parts(self) -> tuple:
        return self.centroids, self.links, self.entries, self.ratio

    def search(self, points: np.ndarray, expansions: int = 0, ratio: float = 0.0) -> np.ndarray:
        """Distances to the centroids that a best-first walk of the graph meets, infinite for others.

        Every point keeps expanding its nearest centroid not yet expanded, for
        ``expansions`` steps and as long as that one is within ``ratio`` times
        the nearest distance met.
        """
        seen = np.full((len(points), len(self.centroids)), np.inf)
        open_ = np.full_like(seen, np.inf)
        every = np.arange(len(points))
        start = _distances(points, self.centroids[self.entries])
        seen[:, self.entries] = open_[:, self.entries] = start
        step = 0
        while len(every):
            node = open_[every].argmin(axis=1)
            nearest = open_[every, node]
            going = np.isfinite(nearest) & ((step < expansions) | (nearest <= ratio * seen[every].min(axis=1)))
            every, node = every[going], node[going]
            if not len(every):
                break
            open_[every, node] = np.inf
            linked = self.links[node]
            fresh = ~np.isfinite(seen[every[:, None], linked])
            row, place = np.nonzero(fresh)
            if len(row):
                found = np.sqrt(((points[every[row]] - self.centroids[linked[row, place]]) ** 2).sum(axis=1))
                seen[every[row], linked[row, place]] = open_[every[row], linked[row, place]] = found
            step += 1
        return seen

    def assign(self, points: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector: the nearest, and others within the closure, up to ``REPLICAS``."""
        result = []
        for first in range(0, len(points), self._batch()):
            found = self.search(points[first : first + self._batch()], expansions=EXPANSIONS)
            near = np.argsort(found, axis=1, kind="stable")[:, :REPLICAS]
            away = np.take_along_axis(found, near, axis=1)
            result += [n[a <= CLOSURE * a[0]] for n, a in zip(near, away)]
        return result

    def probe(self, points: np.ndarray) -> list[np.ndarray]:
        """Lists to search for each query: all that the walk meets within the ratio."""
        result = []
        for first in range(0, len(points), self._batch()):
            found = self.search(points[first : first + self._batch()], expansions=4, ratio=self.ratio)
            result += [np.nonzero(f <= self.ratio * f.min())[0] for f in found]
        return result

    def _batch(self) -> int:
        return max(1, 2_000_000 // len(self.centroids))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0.0))


def _balanced(points: np.ndarray, size: int, random: np.random.Generator) -> list[np.ndarray]:
    """Centroids of a hierarchical clustering whose leaves hold at most ``size`` points."""
    if len(points) <= size:
        return [points.mean(axis=0)]
    ways = min(8, -(-len(points) // size))
    centres = points[random.choice(len(points), ways, replace=False)]
    for _ in range(8):
        nearest = _distances(points, centres).argmin(axis=1)
        centres = np.array([points[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(ways)])
    groups = [points[nearest == k] for k in range(ways) if (nearest == k).any()]
    if len(groups) == 1:
        return [points.mean(axis=0)]
    return [c for group in groups for c in _balanced(group, size, random)]


def fit(sample: np.ndarray, k: int = 10) -> Lists:
    """Centroids, graph and ratio from a bounded sample of distinct vectors."""
    random = np.random.default_rng(42)
    size = max(LIST_VECTORS, -(-len(sample) * 2 // MAX_CENTROIDS))
    centroids = np.array(_balanced(sample, size, random))
    between = _distances(centroids, centroids)
    np.fill_diagonal(between, np.inf)
    links = np.argsort(between, axis=1, kind="stable")[:, : max(1, min(GRAPH_LINKS, len(centroids) - 1))]
    entries = np.sort(random.choice(len(centroids), max(1, int(len(centroids) ** 0.5)), replace=False))
    lists = Lists(centroids, links, entries, 1.0)
    queries = sample[:SAMPLE_QUERIES]
    away = _distances(queries, sample)
    away[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    nearest = np.argsort(away, axis=1, kind="stable")[:, : max(1, min(k, len(sample) - 1))]
    homes = dict(zip(np.unique(nearest).tolist(), lists.assign(sample[np.unique(nearest)])))
    to_lists = _distances(queries, centroids)
    needed = [to_lists[q, homes[n]].min() / max(to_lists[q].min(), 1e-12) for q, row in enumerate(nearest) for n in row.tolist()]
    lists.ratio = float(max(1.0, np.quantile(needed, REACH))) * 1.0001
    return lists


def valid(embedding) -> object:
    """Not null, not empty, not all zero, without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0)


def nearest(
    vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For each row that satisfies ``is_query`` its ``k`` nearest other rows: query_id, rank, ``id_col``, score.

    ``score`` is the Euclidean distance in double precision; ties go to the
    smaller id. Equal vectors are one class, in the lists and among the
    queries, and the ``k + 1`` smallest ids of a class stand for it, as no
    other can be among the nearest; so hot copies cost one vector. Every class
    is indexed. Lists are searched in parts of bounded size.

    Rows without an id or with an invalid vector (see ``valid``) take no part,
    nor do vectors of another length than the most frequent one. Rows that
    repeat an id are all searched, and ask as one query. With fewer than ``k``
    others all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & valid(F.col("v")))
    rows = settle(rows, "ann-rows")
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = f"query_id bigint, rank int, {id_col} bigint, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == length["n"])
    # The id of a class is the smallest in it; an id that several rows repeat may name several classes.
    classes = rows.groupBy("v").agg(F.min("id").alias("least"), F.max("asks").alias("asks"))
    classes = settle(classes.withColumn("class", F.xxhash64("v", "least")), "ann-classes")
    sample = classes.orderBy("class").limit(SAMPLE_VECTORS).select("v").toPandas()["v"]
    lists = fit(np.stack(sample.to_numpy()).astype(float), k)
    shared = spark.sparkContext.broadcast(lists.parts())

    def placed(method: str):
        def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = Lists(*shared.value)
            for vectors in batches:
                points = vectors.flatten().to_numpy().reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
                yield pa.array(getattr(index, method)(points), pa.list_(pa.int32()))

        return F.arrow_udf(place, ArrayType(IntegerType()))(F.col("v"))

    postings = settle(classes.select("class", "v", F.explode(placed("assign")).alias("list")), "ann-lists")
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / PART_VECTORS).cast("int").alias("n"))
    sizes = F.broadcast(sizes)  # a row per centroid at most
    postings = postings.join(sizes, "list").select(
        "list", F.pmod("class", "n").cast("int").alias("part"), "class", "v"
    )
    asked = classes.where("asks").select("class", "v", F.explode(placed("probe")).alias("list"))
    asked = asked.join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), "class", "v"
    )

    def score(postings: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"asker": [], "class": [], "score": []}
        if postings.num_rows and asked.num_rows:
            own = postings["class"].to_numpy()
            points = postings["v"].combine_chunks().flatten().to_numpy().reshape(len(own), -1)
            queries = asked["v"].combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1)
            for asker, query in zip(asked["class"].to_pylist(), queries):
                away = np.sqrt(((points - query) ** 2).sum(axis=1))
                limit = np.partition(away, k)[k] if len(away) > k + 1 else np.inf
                for i in np.nonzero(away <= limit)[0]:
                    out["asker"].append(asker)
                    out["class"].append(own[i])
                    out["score"].append(away[i])
        return pa.table({"asker": pa.array(out["asker"], pa.int64()), "class": pa.array(out["class"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    found = (
        postings.groupBy("list", "part")
        .cogroup(asked.groupBy("list", "part"))
        .applyInArrow(score, "asker bigint, class bigint, score double")
        .groupBy("asker", "class")
        .agg(F.min("score").alias("score"))
    )
    least = classes.select("class", "least")
    closest = Window.partitionBy("asker").orderBy("score", "least")
    found = found.join(least, "class").withColumn("at", F.row_number().over(closest)).where(F.col("at") <= k + 1)
    keyed = rows.join(classes.select("v", "class"), "v").select("id", "class", "asks")
    keyed = settle(keyed, "ann-keys")
    by_id = Window.partitionBy("class").orderBy("id")
    members = keyed.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).select("class", "id")
    reach = Window.partitionBy("asker").orderBy("score", "id")
    answers = found.select("asker", "class", "score").join(members, "class")
    # Per asking class, the k + 1 nearest rows; a query drops itself from them.
    answers = answers.withColumn("at", F.row_number().over(reach)).where(F.col("at") <= k + 1)
    queries = keyed.where("asks").select(F.col("id").alias("query_id"), F.col("class").alias("asker"))
    ranked = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        queries.join(answers, "asker")
        .where("id <> query_id")
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )

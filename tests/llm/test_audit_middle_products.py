"""The audit of filters, fill-in-middle and exact search against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import audit, exact, fim

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_audit(rows, labels):
    """Counts per part, order and step, straight from the documents. Rows are (id, text, part)."""
    docs = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
        }
        said = [(q, t) for d, q, t in labels if d is not None and d == i]
        docs.append((part or "", fails, any(q == 1 for q, _ in said), any(t == 1 for _, t in said)))
    result = {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for step, letter in enumerate(order):
            for part in {d[0] for d in docs}:
                own = [d for d in docs if d[0] == part]
                before = [d for d in own if not any(d[1][x] for x in order[:step])]
                gone = [d for d in before if d[1][letter]]
                result[part, order, step + 1] = [
                    len(before) - len(gone),
                    len(gone),
                    sum(d[1][letter] for d in own) - len(gone),
                    sum(d[1][letter] and sum(d[1].values()) == 1 for d in own),
                    sum(d[2] for d in gone),
                    sum(d[3] for d in gone),
                ]
    shares = Counter()
    for (part, order, step), counts in result.items():
        shares[part, order[step - 1]] += counts[1]
    return {key: [*counts, shares[key[0], key[1][key[2] - 1]]] for key, counts in result.items()}


def audit_rows():
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefghijklmnopq") * rng.randint(1, 9) for _ in range(400))
    texts = ["", None, "Too SHORT", "has # mark", long, long + " #", long.upper(), "same " * 300, "x\x0by z " * 100, "Ä É"]
    rows = [(i, rng.choice(texts), rng.choice(["s", "t", None, ""])) for i in range(60)]
    rows += [(7, long, "s"), (7, long, "s"), (None, long, "u"), (None, None, "u")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 60, 2)]
    return rows, labels + [(0, 1, None), (0, None, 1), (None, 1, 1), (999, 1, 1)]


def test_audit_matches_counting_every_order(spark, docs):
    rows, labels = audit_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS key", "2 AS mask", "3 AS words")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = audit.filter_audit(frame, marks).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in found} == slow_audit(rows, labels)
    assert len(found) == 120 * 5 * 4


def test_audit_of_empty_tables(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.filter_audit(docs([]), labels).collect() == []
    assert audit.filter_audit(docs([(1, "a")]), labels).where("good_lost + toxic_lost > 0").collect() == []


def test_audit_of_a_hot_text(spark):
    """A third of all rows share one text, over many parts, and one id repeats."""
    frame = spark.range(30_000).selectExpr(
        "CASE WHEN id % 7 = 0 THEN 0 ELSE id END AS doc_id", "IF(id % 3 = 0, 'hot', concat('t', id)) AS text", "concat('p', id % 50) AS source"
    )
    cells = audit.mask_cells(frame, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    copies = cells.where("(mask & 16) <> 0").agg(F.sum("n")).first()[0]
    pdf = frame.toPandas()
    least = pdf.groupby("text")["doc_id"].transform("min")
    assert copies == int((pdf["doc_id"] > least).sum())


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (range(0, 60_000, 20), fim.ArrayContainer),
        (range(5, 50_000), fim.RunContainer),
        (sorted(random.Random(1).sample(range(1 << 16), 30_000)), fim.BitmapContainer),
    ],
)
def test_containers_select_each_offset(values, kind):
    low = np.array(values, np.uint16)
    chosen = fim.BoundarySet(low.astype(np.int64)).containers
    assert [type(c) for c in chosen] == [kind]
    own = kind(low)
    assert [own.select(k) for k in range(len(low))] == low.tolist()


def test_boundary_sets_over_many_containers():
    rng = random.Random(2)
    values = sorted(set(rng.sample(range(400_000), 4_000)) | set(range(70_000, 90_000)) | set(range(200_000, 260_000, 2)) | {0, 65_535, 65_536})
    found = fim.BoundarySet(np.array(values))
    assert {type(c) for c in found.containers} == set(fim.BoundarySet.KINDS)
    assert [found.select(k) for k in range(found.size)] == values
    assert fim.BoundarySet(np.zeros(0, np.int64)).size == 0


def slow_middle(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fim.MARKS):
        return i, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return i, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return i, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def middle_rows():
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "no end\nhere", "a<P>b\nc", "<M>", "<<\n<S\n<\n", "ä€😀\n日本\r\n\x0b x y\n" * 40]
    texts += ["".join(rng.choice("ab<\n") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    texts += ["x\n" * 100_000, "\n" * 150_000, "long line " * 200_000 + "\nend", "".join(rng.choice("a\n") for _ in range(200_000))]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id\nline\n"), (3, "twice\nthe id\n"), (3, "twice\nthe id\n"), (-8, "less\nthan\nzero")]


def test_middles_match_plain_cuts_and_come_back(spark, docs):
    rows = middle_rows()
    frame = docs(rows).withColumnsRenamed({"lang": "n", "source": "cut"})
    made = fim.fill_in_middle(frame, ["doc_id", "n", "text"])
    assert made.columns == ["doc_id", "n", "text", "n_", "form", "prefix_chars", "middle_chars", "output"]
    found = made.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(repr, r))
    mine = sorted(((r["doc_id"], r["n_"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found), key=key)
    assert mine == sorted((slow_middle(*r) for r in rows), key=key)
    assert all(r["back"] == (r["text"] or "") for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs([]), ["doc_id"]).collect() == []


def test_rates_of_middles(docs):
    rows = [(i, f"a\nb\nc{i}") for i in range(400)]
    none = fim.fill_in_middle(docs(rows), ["doc_id"], rate=0)
    assert {r["form"] for r in none.collect()} == {"plain"}
    half = fim.fill_in_middle(docs(rows), ["doc_id"], rate=50, suffix_first=0).groupBy("form").count().collect()
    assert {r["form"] for r in half} == {"plain", "psm"} and all(150 < r["count"] < 250 for r in half)


def slow_products(rows, asks, k=20):
    """Answers by (query_id, its whole vector). Equal rows are one."""
    own = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own.append((i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)))
    width = Counter(len(v) for _, v in own).most_common(1)[0][0]
    own = sorted({r for r in own if len(r[1]) == width})
    result = {}
    for i, q in own:
        if asks(i):
            others = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in own if (j, v) != (i, q)]
            result.setdefault(i, []).extend((rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(others)[:k]))
    return {i: sorted(found) for i, found in result.items()}


def clustered(seed, n=600, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    points = centres[rng.integers(0, 8, n)] + 0.1 * rng.normal(size=(n, width))
    return [(i * 5, [float(x) for x in p.astype(np.float32)]) for i, p in enumerate(points)]


@pytest.mark.parametrize(("parts", "asked"), [(4_000, 1_000), (40, 7)])
def test_products_match_brute_force(spark, monkeypatch, parts, asked):
    monkeypatch.setattr(exact, "PART_VECTORS", parts)
    monkeypatch.setattr(exact, "PART_QUERIES", asked)
    inf, nan = float("inf"), float("nan")
    rows = clustered(1) + [(100_000 + i, [0.5] * 12) for i in range(90)] + [(200_000, [0.0] * 12), (200_020, [0.0] * 12)]
    rows += [(0, [1.0] * 12), (300_000, [-1.0] * 12), (300_000, [-1.0] * 12), (None, [1.0] * 12)]
    rows += [(400_000, None), (400_020, []), (400_040, [1.0] * 11 + [None]), (400_060, [nan] * 12), (400_080, [inf] * 12), (400_100, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS class", "3 AS v")
    found = {}
    for r in exact.top_products(frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = slow_products(rows, lambda i: i % 20 == 0)
    assert {i: sorted(v) for i, v in found.items()} == expected and len(expected) > 150


def test_products_of_few_large_and_no_vectors(spark):
    kind = "vec_id bigint, embedding array<double>"
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [-1.0, 0.0])]
    found = exact.top_products(spark.createDataFrame(rows, kind), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 5 * 4096), (0, 2, 2, -4096)]
    assert exact.top_products(spark.createDataFrame(rows[:1], kind), F.col("vec_id") == 0).collect() == []
    empty = exact.top_products(spark.createDataFrame([], kind), F.col("vec_id") == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
    large = [(0, [2.0**23 + 1, 3.0]), (1, [2.0**23 + 2, 1.0]), (2, [2.0**23 + 2, 2.0])]
    found = exact.top_products(spark.createDataFrame(large, kind), F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [
        (j, 4096 * int((2**23 + 1) * (2**23 + 2) + 3 * x)) for j, x in ((2, 2), (1, 1))
    ]


def test_pivots_leave_most_vectors_of_clusters_out():
    """Exact stopping: in clustered data few candidates are evaluated, and none of the best is lost."""
    points = np.floor(64 * np.array([v for _, v in clustered(4, n=4_000)]))
    largest = float((points**2).sum(axis=1).max())
    pivots = exact.choose(points[:500], largest)
    table, least = pivots.distances(points), np.arange(len(points))
    evaluated = 0

    class Counted(np.ndarray):
        def __getitem__(self, item):
            nonlocal evaluated
            evaluated += len(item)
            return np.asarray(self)[item]

    to, norms = pivots.distances(points[:50], asking=True), (points[:50] ** 2).sum(axis=1)
    for query, bound in zip(points, exact.bounds(pivots, norms, to, table.T)):
        places, scores = exact.best(bound, query, -np.inf, points.view(Counted), least, 21)
        assert scores.tolist() == sorted(points @ query, reverse=True)[:21]
    assert evaluated < 0.5 * 50 * len(points)

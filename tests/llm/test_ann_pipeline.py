"""Nearest vectors against brute force, and the pipeline's stages on their own inputs."""

import base64
import hashlib
import re

import numpy as np
import pytest
from conftest import plain
from pyspark.sql import functions as F
from test_dedup import slow_fingerprint, union_find
from test_mixing_tokens_chat import slow_targets

import corpus_pipeline
from tallyforge.llm import ann, lines, quality, simhash
from tallyforge.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def slow_nearest(ids, vectors, query, k=10):
    away = np.sqrt(((vectors - vectors[query]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, away)) if ids[i] != ids[query]]
    return [(int(ids[i]), float(away[i])) for i in order[:k]]


def test_recall_and_scores(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(frame, F.col("vec_id") % 100 == 0).toPandas()
    table = frame.toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    hits = total = 0
    for query in np.nonzero(ids % 100 == 0)[0]:
        expected = slow_nearest(ids, vectors, query)
        mine = found[found["query_id"] == ids[query]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11)) and mine["score"].is_monotonic_increasing
        hits += len({i for i, _ in expected} & set(mine["vec_id"]))
        total += len(expected)
        assert all(
            s == pytest.approx(np.sqrt(((vectors[ids == i] - vectors[query]) ** 2).sum())) for i, s in zip(mine["vec_id"], mine["score"])
        )
    assert hits / total >= 0.9


def test_copies_ties_and_invalid_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(i, [0.0, float(i)]) for i in range(60, 70)]
    odd = [(100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, None]), (500, [nan, 1.0]), (600, [inf, 1.0]), (None, [1.0, 1.0]), (700, [1.0] * 3)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS class")
    found = ann.nearest(frame, F.col("vec_id") % 50 == 0).collect()
    by = {q: sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q) for q in (0, 50)}
    assert [v for _, v, _ in by[0]] == list(range(1, 11)) and [v for _, v, _ in by[50]] == list(range(10))
    assert {s for _, _, s in by[0]} == {0.0} and {r["query_id"] for r in found} == {0, 50}


def test_few_and_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0]), (2, [4.0, 2.0])], "vec_id bigint, embedding array<float>")
    found = ann.nearest(frame, F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 1.0), (2, 2, 3.0)]
    assert ann.nearest(frame.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []
    empty = ann.nearest(frame.where("false"), F.col("vec_id") == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.settle(stage(spark, kept[-1], SF), name))
    return kept


def test_stages_keep_the_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_stage_of_rules_keeps_what_the_verdict_keeps(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdicts = quality.quality_rules(stages[0], quality.train(stages[0], labels)).where("kept")
    assert plain(stages[1].select("doc_id").collect()) == plain(verdicts.select("doc_id").collect())


def test_stage_of_lines_leaves_no_equal_lines(stages):
    left = [x for r in stages[2].collect() for x in (r["text"] or "").split("\n") if x.strip(lines.WHITE)]
    assert len(left) == len(set(left)) and stages[2].count() == stages[1].count()
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_stage_of_near_duplicates_leaves_one_of_each(stages):
    groups = {r["component_id"] for r in simhash.near_duplicates(stages[2]).collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == groups


def test_stage_of_mixing_takes_copies(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    after = stages[4].collect()
    assert all(before[r["doc_id"]] == r for r in after)
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert 0.8 < words(after) / words(before.values()) < 1.2


def test_near_duplicate_stage_matches_all_pairs(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    prints = {i: slow_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {r["doc_id"] for r in stages[3].collect()} == set(union_find(ids, pairs).values())


def test_mixing_stage_comes_near_plain_targets(stages):
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes, largest, taken = {}, {}, {}
    for r in stages[3].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r["text"])
        largest[r["source"]] = max(largest.get(r["source"], 0), words(r["text"]))
    for r in stages[4].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r["text"])
    for source, target in slow_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= largest[source] + 1, source


def test_token_stage_gives_the_ids_of_the_library(stages):
    import tiktoken

    ranks, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    expected = []
    for r in stages[4].collect():
        ids = np.array(own.encode_ordinary(r["text"] or ""), "<u4")
        expected.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest()))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in stages[5].collect()) == sorted(expected)


def test_last_stage_decodes_to_the_texts(spark, stages):
    texts = stages[4].select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))
    assert plain(stages[5].select("doc_id", "decoded_sha256").collect()) == plain(texts.collect())
    assert plain(corpus_pipeline.run(spark, SF).collect()) == plain(stages[5].collect())


def test_stages_take_empty_tables(spark, stages):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].where("false"), SF).collect() == [], name


def test_every_operator_has_its_query():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))

"""Catalogue checks, corpus tables and ranking, with published numbers where there are any."""

import hashlib
import json

from pyspark.sql import functions as F

from tallyforge.operators import catalog, corpus, ranking
from tallyforge.operators.catalog import Rule

# Published sources as (name, modalities, number of languages, size, quality, duplicates, licence).
SOURCES = [
    ("openweb_multilingual_text", ["pure_text"], 25, 720.0, 0.81, 0.06, "mixed-permissive-with-provenance"),
    ("code_math_science_text", ["pure_text"], 6, 180.0, 0.86, 0.04, "permissive-code-and-open-access"),
    ("licensed_books_academic_text", ["pure_text"], 16, 140.0, 0.89, 0.03, "licensed"),
    ("image_text_web_pairs", ["multimodal"], 20, 430.0, 0.80, 0.065, "mixed-permissive-with-provenance"),
    ("new_ocr_document_multimodal", ["multimodal"], 22, 260.0, 0.83, 0.05, "licensed-and-consented"),
    ("video_caption_web_corpus", ["video_pretraining"], 20, 410.0, 0.78, 0.07, "mixed-permissive-with-provenance"),
    ("audio_speech_multilingual_corpus", ["audio_speech"], 22, 125.0, 0.82, 0.045, "mixed-permissive-with-provenance"),
    ("autonomous_driving_video_actions", ["video_pretraining", "vla"], 2, 210.0, 0.84, 0.03, "internal-approved"),
    ("robot_trajectory_vla", ["vla"], 4, 110.0, 0.87, 0.025, "licensed-and-consented"),
    ("simulated_vla_rollouts", ["vla"], 2, 115.0, 0.82, 0.02, "generated-internal"),
    ("business_dialog_instruction_data", ["pure_text"], 10, 65.0, 0.90, 0.03, "internal-approved"),
    ("customer_support_multilingual_logs", ["pure_text"], 20, 70.0, 0.88, 0.035, "internal-approved-redacted"),
]
# Published candidates as (name, loss, throughput, reasoning, memory, stability, utility to 3 places).
CANDIDATES = [
    ("mla-gqa-kv-compressed", 1.940, 2960.0, 66.4, 58.0, 0.87, 0.733),
    ("mamba-selective-scan", 2.010, 3380.0, 62.1, 51.0, 0.84, 0.648),
    ("moe-top2-64e", 1.910, 2320.0, 66.8, 72.0, 0.88, 0.642),
    ("hybrid-mamba-transformer", 1.960, 2740.0, 65.2, 65.0, 0.87, 0.641),
    ("mtp-4head-decoder", 1.930, 2470.0, 66.1, 70.0, 0.86, 0.615),
    ("linear-sparse-attn-32k", 1.980, 2860.0, 63.5, 62.0, 0.84, 0.587),
    ("mixture-of-depths-token-routing", 1.970, 2720.0, 66.9, 64.0, 0.81, 0.583),
    ("retnet-retention-decoder", 2.030, 3240.0, 61.4, 53.0, 0.83, 0.581),
    ("reasoning-native-verifier-policy", 1.940, 2130.0, 72.4, 79.0, 0.82, 0.570),
    ("latent-reasoning-scratchpad", 1.950, 2210.0, 69.6, 74.0, 0.83, 0.562),
    ("hyena-long-conv", 2.050, 3310.0, 60.8, 50.0, 0.82, 0.562),
    ("rwkv-style-rnn-backbone", 2.060, 3150.0, 59.4, 54.0, 0.82, 0.495),
    ("test-time-memory-adapter", 1.980, 2240.0, 67.5, 73.0, 0.80, 0.473),
    ("latent-world-model-jepa", 2.020, 2360.0, 64.6, 70.0, 0.83, 0.458),
    ("omni-modal-unified-tokens", 1.970, 2060.0, 68.9, 80.0, 0.80, 0.453),
    ("memory-augmented-retrieval-state", 1.990, 2180.0, 67.7, 78.0, 0.81, 0.452),
    ("byte-level-token-free-decoder", 2.080, 2580.0, 62.7, 68.0, 0.84, 0.422),
    ("robotics-transformer-vla-policy", 1.990, 2060.0, 65.8, 78.0, 0.79, 0.383),
    ("spiking-event-backbone", 2.180, 3540.0, 55.6, 42.0, 0.76, 0.350),
    ("diffusion-llm-dllm", 2.110, 1980.0, 61.2, 76.0, 0.79, 0.201),
]


def sources(spark):
    rows = [(i, *s) for i, s in enumerate(SOURCES)]
    return spark.createDataFrame(
        rows,
        "position long, source string, modalities array<string>, languages int, size double, "
        "quality_score double, duplicate_rate double, license string",
    )


def test_published_sizes(spark):
    out = {r.modality: r["size"] for r in corpus.size_by_modality(sources(spark)).collect()}
    assert out == {"audio_speech": 125.0, "multimodal": 690.0, "pure_text": 1175.0, "video_pretraining": 515.0, "vla": 330.0}


def test_published_summary_and_gates(spark):
    # Each source's first n languages of one list stand for its languages.
    docs = sources(spark).select(
        "source",
        "modalities",
        (F.col("size") / F.size("modalities") / F.col("languages")).alias("size"),
        F.explode(F.sequence(F.lit(1), "languages").cast("array<string>")).alias("lang"),
    ).select("source", "lang", F.explode("modalities").alias("modality"), "size")
    summary = corpus.corpus_summary(docs)
    row = corpus.scale_gates(summary, 2500, 20).first()
    assert (row.total_size, row.language_count) == (2835.0, 25)
    assert row.scale_passed and row.language_passed and row.modalities_passed and row.missing_modalities == ""
    text_only = corpus.scale_gates(corpus.corpus_summary(docs.filter("modality = 'vla'")), 2500, 20).first()
    assert not text_only.scale_passed and not text_only.modalities_passed
    assert text_only.missing_modalities == "audio_speech,multimodal,pure_text,video_pretraining"


def test_quality_gate_text(spark):
    measures = sources(spark).withColumn("documents", F.lit(1)).withColumn("distinct_texts", F.lit(1))
    assert corpus.source_quality_gate(measures).filter("issues <> ''").count() == 0
    strict = {r.source: r.issues for r in corpus.source_quality_gate(measures, 0.8, 0.065).collect()}
    assert strict["video_caption_web_corpus"] == (
        "quality_score 0.780 is below gate 0.800; duplicate_rate 0.070 exceeds gate 0.065"
    )
    assert strict["image_text_web_pairs"] == ""


def test_duplicate_rate_with_a_hot_text(spark):
    rows = [(i, "s", "Same  text" if i % 3 == 0 else f"text {i}") for i in range(300)] + [(999, "t", "same TEXT ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r.source: r for r in corpus.duplicate_rate_by_source(corpus.source_measures(docs)).collect()}
    assert (out["s"].documents, out["s"].duplicates, out["s"].duplicate_rate) == (300, 99, 0.33)
    assert out["t"].dedup_passed and not out["s"].dedup_passed


def test_licenses(spark):
    df = spark.createDataFrame([("a", "mit"), ("b", "restricted"), ("c", None)], "source string, license string")
    out = {r.source: (r.license_allowlist_passed, r.all_passed) for r in corpus.license_allowlist(df).collect()}
    assert out == {"a": (True, False), "b": (False, False), "c": (False, False)}


def test_mixture_plan(spark):
    df = spark.createDataFrame(
        [("warmup", 150.0, {"pure_text": 0.69, "vla": 0.31}, {"en": 0.3333333})],
        "name string, total double, modality_targets map<string,double>, language_targets map<string,double>",
    )
    out = {(r.axis, r.target): r.amount for r in corpus.mixture_plan(df).collect()}
    assert out == {("modality", "pure_text"): 103.5, ("modality", "vla"): 46.5, ("language", "en"): 50.0}


def test_lineage_digest(spark):
    stages = [corpus.Stage("clean", ("filter", "repair"), "pool", "quality")]
    pool = spark.createDataFrame([("b",), ("a",), ("b",)], "source string")
    row = corpus.lineage_ledger(pool, stages).first()
    body = json.dumps({"stage": "clean", "operations": ["filter", "repair"], "sources": ["a", "b"]}, sort_keys=True)
    assert row.output_uri == "artifact://data/pool/" + hashlib.sha256(body.encode()).hexdigest()[:12]
    assert (row.operation_count, row.source_count, row.owner, row.status) == (2, 2, "quality", "planned")


def test_published_ranking(spark):
    names = [c.metric for c in ranking.ARCHITECTURE_CRITERIA]
    df = spark.createDataFrame(
        [(i, c[0], *map(float, c[1:6])) for i, c in enumerate(CANDIDATES)],
        ["position", "name", *names],
    )
    out = ranking.minmax_utility_rank(df, ranking.ARCHITECTURE_CRITERIA, "position", block_rows=3).collect()
    found = {r.name: (r["rank"], r.utility_score) for r in out}
    for place, candidate in enumerate(CANDIDATES, start=1):
        rank, score = found[candidate[0]]
        assert rank == place and abs(score - candidate[6]) <= 0.0005 + 1e-9, candidate
    best = ranking.top_k(df, ranking.ARCHITECTURE_CRITERIA, "position", 3).collect()
    assert [r.name for r in best] == [c[0] for c in CANDIDATES[:3]]


def test_rank_of_ties_and_constant_metric(spark):
    df = spark.range(50).select(F.col("id").alias("position"), (F.col("id") % 2).cast("double").alias("x"), F.lit(3.0).alias("y"))
    criteria = (ranking.Criterion("x", 0.5), ranking.Criterion("y", 0.5, higher_is_better=False))
    out = ranking.minmax_utility_rank(df, criteria, "position", block_rows=4).orderBy("rank").collect()
    assert [r.position for r in out] == [i for i in range(50) if i % 2] + [i for i in range(50) if i % 2 == 0]
    assert out[0].utility_score == 1.0 and out[-1].utility_score == 0.5
    assert [r["rank"] for r in out] == list(range(1, 51))


def entries(spark):
    return spark.createDataFrame(
        [
            (0, "a", "text", ["t", "u"], "P0", "https://x", 1.0),
            (1, "a", "text", ["t"], "P9", "ftp://x", 0.0),
            (2, "b", "audio", [], "P1", "s3://x", -1.0),
            (3, None, "audio", None, "P0", None, None),
        ],
        "i long, name string, family string, modalities array<string>, priority string, url string, size double",
    )


def test_rules(spark):
    rules = [
        Rule("name", "required"),
        Rule("size", "minimum", 0),
        Rule("size", "above", 0),
        Rule("priority", "allowed", ("P0", "P1")),
        Rule("url", "prefix", ("https://", "s3://")),
        Rule("url", "not_empty"),
        Rule("priority", "type", "int"),
        Rule("modalities", "not_empty"),
        Rule("name", "listed_in", "modalities"),
    ]
    out = {(r.i, r.column, r.rule) for r in catalog.validate_rules(entries(spark), "i", rules).collect()}
    assert {k for k in out if k[2] != "type"} == {
        (1, "size", "above"),
        (1, "priority", "allowed"),
        (1, "url", "prefix"),
        (2, "size", "minimum"),
        (2, "size", "above"),
        (3, "name", "required"),
        (3, "url", "not_empty"),
        (3, "url", "prefix"),
        (2, "modalities", "not_empty"),
        (3, "modalities", "not_empty"),
        (0, "name", "listed_in"),
        (1, "name", "listed_in"),
        (2, "name", "listed_in"),
    }
    assert {k[0] for k in out if k[2] == "type"} == {0, 1, 2, 3}


def test_coverage_duplicates_filter_facets(spark):
    df = entries(spark)
    assert [r.missing for r in catalog.required_coverage(df, "family", ["text", "video"]).collect()] == ["video"]
    assert [r.i for r in catalog.duplicate_keys(df, ["name", "family"], "i").collect()] == [1]
    hot = spark.range(3000).select("id", F.lit("k").alias("k"), F.lit(None).cast("string").alias("n"))
    assert catalog.duplicate_keys(hot, ["k", "n"], "id").count() == 2999
    assert [r.i for r in catalog.catalog_filter(df, family="text", modalities="u", priority=None).collect()] == [0]
    facets = {(r.facet, r.value): r.entries for r in catalog.catalog_facets(df, ["family", "modalities"]).collect()}
    assert facets == {("family", "text"): 2, ("family", "audio"): 2, ("modalities", "t"): 2, ("modalities", "u"): 1}
    listing = catalog.catalog_listing(df.filter("name IS NOT NULL"), ["priority", "family", "name"]).collect()
    assert [r.i for r in listing] == [0, 2, 1] and listing[0].modalities == "t, u"


def test_probability_maps(spark):
    df = spark.createDataFrame(
        [("ok", {"a": 0.5, "b": 0.5000001}), ("off", {"a": 0.5, "b": 0.4}), ("neg", {"a": 1.5, "b": -0.5})],
        "k string, w map<string,double>",
    )
    out = {(r.k, r.entry, r.message) for r in catalog.probability_map_check(df, "k", "w").collect()}
    assert out == {
        ("off", "*", "probabilities must sum to 1.0, got 0.900000"),
        ("neg", "b", "probability must be non-negative"),
    }


def test_keywords_and_risks(spark):
    df = spark.createDataFrame([(1, "Exact_Hash_DEDUP"), (2, "pii_redaction score"), (3, None)], "i long, text string")
    assert {(r.i, r.tag) for r in catalog.keyword_tag(df, "i", "text").collect()} == {
        (1, "deduplicate"),
        (2, "clean"),
        (2, "quality"),
    }
    missing = {r.tag for r in catalog.keyword_coverage(df, "text").filter("missing").collect()}
    assert missing == {"cluster"}
    risks = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "risks array<string>")
    assert {r.risk: r.entries for r in corpus.risk_counts(risks).collect()} == {"a": 2, "b": 1}


def test_left_join_keeps_unknown_sources(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "z")], "doc_id long, source string")
    ledger = spark.createDataFrame([("a", "mit")], "source string, license string")
    assert {r.doc_id: r.license for r in corpus.source_join_license(docs, ledger).collect()} == {1: "mit", 2: None}

"""SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

from tallyforge.functions.numbers import SCORED_LOWER_IS_BETTER
from tallyforge.plans.fixtures import SAMPLE_FIELDS, SCORE_FIELDS

ORACLES: dict[str, str] = {}

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: str) -> str:
    bare = r"regexp_replace(lower(" + text + r"), '[!-/:-@\[-`{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({bare}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"


def normal(text: str) -> str:
    return f"array_to_string({words(text)}, ' ')"


# --- samples, one per document ---------------------------------------------------------------

SAMPLES = f"""
s AS (
  SELECT doc_id, 'doc-' || doc_id AS id, 'core_' || lang AS benchmark, source AS dataset, text, n_chars,
    CASE doc_id % 4 WHEN 0 THEN translate(text, '{LOWER}', '{UPPER}') || '.'
      WHEN 1 THEN regexp_replace(text, '(\\S+\\s+\\S+\\s+)\\S+\\s*', '\\1', 'g')
      WHEN 2 THEN replace(text, ' the ', ' a ') ELSE '' END AS prediction,
    {", ".join(f"{sql} AS {name}" for name, sql in SAMPLE_FIELDS.items())},
    {", ".join(f"CASE WHEN doc_id % 2 = 0 THEN {sql} END AS s_{name}" for name, sql in SCORE_FIELDS.items())}
  FROM documents)"""


def scores(samples: str = "s") -> str:
    """Exact match and token F1 of every sample."""
    return f"""
w AS (
  SELECT id, side, word, count(*) AS n FROM (
    SELECT id, 'p' AS side, unnest({words('prediction')}) AS word FROM {samples}
    UNION ALL SELECT id, 'r', unnest({words('text')}) FROM {samples}) GROUP BY ALL),
overlap AS (
  SELECT p.id, sum(least(p.n, r.n)) AS o FROM w p JOIN w r ON p.id = r.id AND p.word = r.word
  WHERE p.side = 'p' AND r.side = 'r' GROUP BY p.id),
total AS (SELECT id, sum(n) AS n FROM w GROUP BY id),
f AS (
  SELECT {samples}.*, CAST({normal('prediction')} = {normal('text')} AS INT)::DOUBLE AS correct,
    CASE WHEN total.n IS NULL THEN 1.0 ELSE 2.0 * coalesce(o, 0) / total.n END::DOUBLE AS f1
  FROM {samples} LEFT JOIN total USING (id) LEFT JOIN overlap USING (id))"""


def number(text: str) -> str:
    return f"TRY_CAST({text} AS DOUBLE)"


def flag(name: str) -> str:
    return f"CAST(CAST({name} AS INT) AS DOUBLE)"


# Value of each metric over the columns of ``f``.
METRICS = {
    "accuracy": "correct",
    "pass_at_1": "correct",
    "f1": "f1",
    "calibration_error": "abs(coalesce(confidence, correct) - correct)",
    "consensus_pass": "coalesce(s_consensus_pass, greatest(correct, f1))",
    "success_rate": f"coalesce({flag('success')}, correct)",
    "task_success": f"coalesce({flag('success')}, correct)",
    "recovery_rate": f"coalesce({flag('recovered')}, correct)",
    "unsafe_action_rate": f"coalesce({flag('unsafe_action')}, 0.0)",
    "collision_free_rate": f"coalesce({flag('collision_free')}, correct)",
    "steps_to_success": "CAST(steps AS DOUBLE)",
    "cost_per_success": "cost",
    "frame_action_latency_ms": "latency_ms",
    "prefill_ms": "CAST(NULL AS DOUBLE)",
    "memory_gb": f"CASE WHEN doc_id % 2 = 0 THEN {number('s_memory_gb')} ELSE peak_memory_gb END",
    "wer": "coalesce(s_wer, correct)",
    "mos": "coalesce(s_mos, correct)",
    "bleu": "correct",
}


def per_sample(metric: str) -> str:
    return f"WITH {SAMPLES}, {scores()} SELECT id, round({METRICS[metric]}, 6) AS value FROM f"


def long_samples(metrics: dict[str, str]) -> str:
    parts = [f"SELECT id, '{name}' AS metric, round({sql}, 6) AS value FROM f" for name, sql in metrics.items()]
    return f"WITH {SAMPLES}, {scores()} " + " UNION ALL ".join(parts)


CARD = {
    "core_en": ("general", ("accuracy", "macro_average", "calibration_error")),
    "core_fr": ("reasoning", ("pass_at_1", "consensus_pass", "f1")),
    "core_de": ("general", ("accuracy", "wer", "mos")),
    "core_es": (
        "vla",
        (
            "success_rate",
            "collision_free_rate",
            "recovery_rate",
            "unsafe_action_rate",
            "steps_to_success",
            "memory_gb",
        ),
    ),
}
GATES = [
    ("core_en", "macro_average", 0.72),
    ("core_fr", "pass_at_1", 0.48),
    ("core_fr", "f1", 0.5),
    ("core_de", "accuracy", 0.3),
    ("core_de", "wer", 0.6),
    ("core_de", "max_wer", 0.9),
    ("core_es", "success_rate", 0.3),
    ("core_es", "unsafe_action_rate", 0.5),
]


def mean4(sql: str) -> str:
    return f"coalesce(round(avg({sql}), 4), 0.0)"


def macro(source: str) -> str:
    return f"""SELECT benchmark, {mean4('dataset_mean')} AS macro_average, count(*) AS datasets,
      CAST(sum(samples) AS BIGINT) AS samples
      FROM (SELECT benchmark, dataset, {mean4('correct')} AS dataset_mean, count(*) AS samples FROM {source} GROUP BY ALL)
      GROUP BY benchmark"""


def card(name: str = "card", source: str = "f") -> str:
    parts = []
    for benchmark, (dimension, metrics) in CARD.items():
        for metric in metrics:
            value = (
                f"(SELECT macro_average FROM ({macro(source)}) m WHERE m.benchmark = '{benchmark}')"
                if metric == "macro_average"
                else mean4(METRICS[metric])
            )
            parts.append(
                f"SELECT benchmark, '{dimension}' AS dimension, '{metric}' AS metric, {value} AS value, "
                f"count(*) AS sample_count FROM {source} WHERE benchmark = '{benchmark}' GROUP BY benchmark"
            )
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def judged() -> str:
    rows = ", ".join(f"('{b}', '{m}', CAST({t} AS DOUBLE))" for b, m, t in GATES)
    lower = ", ".join(f"'{m}'" for m in SCORED_LOWER_IS_BETTER)
    return f"""
gates(benchmark, metric, threshold) AS (VALUES {rows}),
judged AS (
  SELECT g.benchmark, g.metric, g.threshold, c.value,
    coalesce(CASE WHEN g.metric LIKE 'max\\_%' ESCAPE '\\' OR g.metric IN ({lower}) THEN c.value <= g.threshold
      ELSE c.value >= g.threshold END, false) AS gate_passed
  FROM gates g LEFT JOIN card c ON g.benchmark = c.benchmark AND g.metric = c.metric)"""


def digest(keep: tuple[str, ...], texts: tuple[str, ...], sql: str) -> str:
    """Long texts are compared as a whole by digest."""
    columns = [*keep, *(f"md5({text}) AS {text}" for text in texts)]
    return f"SELECT {', '.join(columns)} FROM ({sql}) t"


# --- records, samples, predictions ---------------------------------------------------------------

ORACLES["ingest_jsonl_records"] = digest(
    ('doc_id', 'kind'),
    ('text',),
    """
SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'scalar' WHEN 3 THEN 'invalid' WHEN 4 THEN 'scalar' ELSE 'object' END AS kind,
  CASE doc_id % 5 WHEN 3 THEN trim('{"text": ' || replace(text, chr(10), ' ')) WHEN 4 THEN CAST(n_chars AS VARCHAR)
    ELSE text END AS text
FROM documents WHERE doc_id % 5 <> 4 OR lang <> 'en'""",
)

ORACLES["map_record_text"] = digest(
    ('key',),
    ('text',),
    """
SELECT 'doc-' || doc_id AS key, text FROM documents
UNION ALL SELECT 'item-' || item_id, text || chr(10) || item_id FROM benchmark
UNION ALL SELECT 'page-' || page_id, url || chr(10) || chr(10) || html FROM pages
UNION ALL SELECT 'turn-' || conv_id || '-' || turn, role || ': ' || text || chr(10) || 'user: ' || text FROM conversations
UNION ALL SELECT 'event-' || event_id,
  '{"event_type": "' || event_type || '", "steps": ["' || event_type || '", "a, b: c"], "user_id": ' || user_id || '}' FROM events
UNION ALL SELECT 'label-' || doc_id, '{"doc_id": ' || doc_id || ', "quality": ' || quality || ', "toxic": ' || toxic || '}'
  FROM labels""",
)

ORACLES["map_prompt_reference"] = digest(
    ('line_index', 'id', 'reference'),
    ('prompt',),
    """
SELECT conv_id * 1000 + turn AS line_index,
  CASE role WHEN 'user' THEN 'turn-' || conv_id || '-' || turn ELSE printf('bench-%06d', conv_id * 1000 + turn) END AS id,
  CASE role WHEN 'system' THEN '{"role": "system", "turn": ' || turn || '}' ELSE text END AS prompt,
  CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN CAST(conv_id AS VARCHAR) END AS reference
FROM conversations""",
)

ORACLES["map_prediction"] = digest(
    ('conv_id', 'turn'),
    ('sample_prediction', 'model_prediction'),
    """
SELECT conv_id, turn,
  CASE role WHEN 'user' THEN text WHEN 'assistant' THEN role ELSE '' END AS sample_prediction,
  CASE role WHEN 'system' THEN '{"role": "system", "turn": ' || turn || '}' ELSE text END AS model_prediction
FROM conversations""",
)

ORACLES["read_eval_samples"] = digest(
    ('id', 'benchmark', 'dataset', 'reference'),
    ('prompt',),
    """
SELECT 'doc-' || doc_id AS id, 'core_en' AS benchmark, source AS dataset, text AS prompt, lang AS reference
  FROM documents WHERE lang = 'en'
UNION ALL SELECT 'doc-' || doc_id, 'core_fr', source, text, lang FROM documents WHERE lang = 'fr'
UNION ALL SELECT 'doc-' || doc_id, 'Core, German +1', source, text, lang FROM documents WHERE lang = 'de'
UNION ALL SELECT 'doc-' || doc_id, 'by_dataset', source, text, lang FROM documents WHERE source IN ('src1', 'src2')
UNION ALL SELECT 'empty_one-generated-0', 'Empty One', 'nowhere', 'Generated smoke sample for Empty One', 'yes'""",
)

ORACLES["read_predictions"] = digest(
    ('id',),
    ('prediction',),
    """
SELECT 'doc-' || doc_id AS id, CASE WHEN quality = 1 THEN text ELSE 'rejected' END AS prediction
FROM labels JOIN documents USING (doc_id)""",
)

ORACLES["conversation_to_text"] = digest(
    ('conv_id', 'turns'),
    ('text',),
    """
SELECT conv_id, count(*) AS turns,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY ALL""",
)

ORACLES["write_transcripts"] = "SELECT 'core_' || lang AS benchmark, count(*) AS samples FROM documents GROUP BY ALL"

ORACLES["byte_tokenize"] = """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
t AS (SELECT doc_id, n, unnest(range(0, least(n, 511))) AS i, h FROM b),
v AS (SELECT doc_id, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) + 3 AS tok FROM t)
SELECT b.doc_id, CAST(512 AS BIGINT) AS length, CAST(least(b.n + 2, 512) AS BIGINT) AS tokens,
  CAST(1 + coalesce(sum(tok * (i + 2)), 0) + CASE WHEN b.n + 2 <= 512 THEN 2 * (b.n + 2) ELSE 0 END AS BIGINT) AS checksum,
  CAST(CASE WHEN b.n + 2 < 512 THEN 0 WHEN b.n + 2 = 512 THEN 2 ELSE max(CASE WHEN i = 510 THEN tok END) END AS BIGINT) AS last_id
FROM b LEFT JOIN v USING (doc_id) GROUP BY b.doc_id, b.n"""

# --- sources ---------------------------------------------------------------------------------

ORACLES["lineage_ledger"] = """
WITH names AS (SELECT list_sort(list(DISTINCT source)) AS l FROM documents),
stages(position, stage, operations, output, operation_count, owner) AS (VALUES
  (CAST(0 AS BIGINT), 'ingest', '["schema_mapping", "hash_indexing"]', 'raw_shards', CAST(2 AS BIGINT), 'data-platform'),
  (CAST(1 AS BIGINT), 'assess', '["quality_score"]', 'ranked_pool', CAST(1 AS BIGINT), 'model-quality'))
SELECT position, stage, 'planned' AS status,
  'artifact://data/' || output || '/' || substr(sha256('{"operations": ' || operations || ', "sources": ["'
    || array_to_string(l, '", "') || '"], "stage": "' || stage || '"}'), 1, 12) AS output_uri,
  operation_count, owner, CAST(len(l) AS BIGINT) AS source_count
FROM stages, names"""

LEDGER = """ledger AS (
  SELECT source, CAST(sum(n_chars) AS DOUBLE) AS size, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k
  FROM documents GROUP BY source),
attrs AS (
  SELECT source, size, k, ['web', 'collected', 'business'][k % 3 + 1] AS source_type,
    ['cc-by', 'unknown', 'mit', 'restricted', 'apache-2.0'][k % 5 + 1] AS license FROM ledger)"""

ORACLES["source_join_license"] = f"""
WITH {LEDGER}, known AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT d.doc_id, d.source, d.lang, a.source_type, a.license FROM documents d
LEFT JOIN (SELECT * FROM attrs JOIN known USING (source)) a USING (source)"""

ORACLES["license_allowlist"] = f"""
WITH {LEDGER}
SELECT source, license, license NOT IN ('unknown', 'restricted') AS license_allowlist_passed,
  bool_and(license NOT IN ('unknown', 'restricted')) OVER () AS all_passed FROM attrs"""

MEASURES = r"""measures AS (
  SELECT source, count(*) AS documents,
    count(DISTINCT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))) AS distinct_texts,
    coalesce(avg(quality), 0.0) AS quality_score
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source),
rated AS (SELECT *, 1 - CAST(distinct_texts AS DOUBLE) / documents AS duplicate_rate FROM measures)"""

ORACLES["duplicate_rate_by_source"] = f"""
WITH {MEASURES}
SELECT source, documents, documents - distinct_texts AS duplicates, round(duplicate_rate, 6) AS duplicate_rate,
  duplicate_rate <= 0.08 AS dedup_passed FROM rated"""

ORACLES["source_quality_gate"] = f"""
WITH {MEASURES}
SELECT source, documents, round(quality_score, 6) AS quality_score, round(duplicate_rate, 6) AS duplicate_rate,
  quality_score >= 0.72 AS quality_passed, duplicate_rate <= 0.08 AS dedup_passed,
  concat_ws('; ', CASE WHEN quality_score < 0.72 THEN printf('quality_score %.3f is below gate 0.720', quality_score) END,
    CASE WHEN duplicate_rate > 0.08 THEN printf('duplicate_rate %.3f exceeds gate 0.080', duplicate_rate) END) AS issues
FROM rated"""

ORACLES["size_by_modality"] = f"""
WITH {LEDGER}, parts AS (
  SELECT 'pure_text' AS modality, CASE WHEN k % 2 = 0 THEN size / 2 ELSE size END AS share FROM ledger
  UNION ALL SELECT 'multimodal', size / 2 FROM ledger WHERE k % 2 = 0)
SELECT modality, round(sum(share), 3) AS size FROM parts GROUP BY modality"""

ORACLES["mixture_plan"] = f"""
WITH {LEDGER}, targets(axis, target, ratio) AS (VALUES
  ('modality', 'pure_text', 0.69::DOUBLE), ('modality', 'multimodal', 0.16), ('modality', 'video_pretraining', 0.08),
  ('modality', 'audio_speech', 0.03), ('modality', 'vla', 0.04),
  ('language', 'en', 0.38), ('language', 'zh', 0.24), ('language', 'other', 0.38))
SELECT source AS stage, axis, target, round(size * ratio, 3) AS amount FROM ledger, targets"""

ORACLES["risk_counts"] = """
SELECT risk, count(*) AS entries FROM (
  SELECT 'pii' AS risk FROM documents WHERE contains(text, '@')
  UNION ALL SELECT 'secrets' FROM documents WHERE contains(text, 'token = ')
  UNION ALL SELECT 'mixed-license' FROM documents WHERE contains(text, 'icense')) GROUP BY risk"""

POOL = """pool AS (
  SELECT source, lang, 'pure_text' AS modality, CAST(n_chars AS DOUBLE) AS size FROM documents
  UNION ALL SELECT 'web', 'und', 'multimodal', length(html) FROM pages
  UNION ALL SELECT 'chat', 'und', 'audio_speech', length(text) FROM conversations
  UNION ALL SELECT 'frames' || label, 'none', 'video_pretraining', len(embedding) FROM embeddings
  UNION ALL SELECT event_type, 'none', 'vla', length(props) FROM events),
summary AS (
  SELECT round(sum(size), 3) AS total_size, count(DISTINCT lang) AS language_count,
    array_to_string(list_sort(list(DISTINCT modality)), ',') AS modalities, count(DISTINCT source) AS source_count FROM pool)"""

ORACLES["corpus_summary"] = f"WITH {POOL} SELECT * FROM summary"

ORACLES["scale_gates"] = f"""
WITH {POOL}
SELECT total_size, language_count, modalities, total_size >= 1000000 AS scale_passed, language_count >= 20 AS language_passed,
  modalities = 'audio_speech,multimodal,pure_text,video_pretraining,vla' AS modalities_passed, '' AS missing_modalities
FROM summary"""

# --- catalogue -------------------------------------------------------------------------------

CATALOG = """catalog AS (
  SELECT p_partkey AS position, 'part-' || p_partkey AS name, p_brand AS family, string_split(p_name, ' ') AS modalities,
    p_type AS license, 'P' || (p_size % 4) AS priority,
    ['https://', 's3://', 'ftp://'][p_size % 3 + 1] || replace(p_name, ' ', '/') AS download_url, p_retailprice AS price
  FROM part)"""

ORACLES["validate_rules"] = f"""
WITH {CATALOG}
SELECT position, 'license' AS "column", 'type' AS rule, 'expected int' AS message FROM catalog
  WHERE TRY_CAST(license AS INT) IS NULL
UNION ALL SELECT position, 'price', 'minimum', 'expected >= 950, got ' || price FROM catalog WHERE price < 950
UNION ALL SELECT position, 'price', 'above', 'must be above 1000' FROM catalog WHERE NOT price > 1000
UNION ALL SELECT position, 'priority', 'allowed', 'expected one of P0, P1, P2, got ' || priority FROM catalog
  WHERE priority NOT IN ('P0', 'P1', 'P2')
UNION ALL SELECT position, 'download_url', 'prefix', 'must start with https://, http://, s3://, gs://' FROM catalog
  WHERE NOT regexp_matches(download_url, '^(https|http|s3|gs)://')
UNION ALL SELECT position, 'family', 'not_empty', 'must not be empty' FROM catalog WHERE coalesce(family, '') = ''"""

ORACLES["required_coverage"] = """
SELECT missing FROM (VALUES ('en'), ('fr'), ('zh'), ('ja'), ('de')) v(missing)
WHERE missing NOT IN (SELECT lang FROM documents WHERE lang IS NOT NULL)"""

ORACLES["duplicate_keys"] = """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1"""

ORACLES["probability_map_check"] = """
WITH c AS (SELECT user_id, event_type AS entry, count(*) AS n FROM events GROUP BY ALL),
m AS (SELECT user_id, entry, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) - 0.15, 2) AS weight FROM c)
SELECT user_id, entry, 'probability must be non-negative' AS message FROM m WHERE weight < 0
UNION ALL SELECT user_id, '*', printf('probabilities must sum to 1.0, got %.6f', sum(weight)) FROM m GROUP BY user_id
  HAVING abs(sum(weight) - 1) > 1e-6"""

ORACLES["catalog_filter"] = f"""
WITH {CATALOG}
SELECT position, name, family, price FROM catalog
WHERE license = 'ECONOMY' AND list_contains(modalities, 'ring') AND priority = 'P1'"""

ORACLES["catalog_facets"] = f"""
WITH {CATALOG}, pairs AS (
  SELECT 'family' AS facet, family AS value FROM catalog UNION ALL SELECT 'license', license FROM catalog
  UNION ALL SELECT 'priority', priority FROM catalog UNION ALL SELECT 'modalities', unnest(modalities) FROM catalog)
SELECT facet, value, count(*) AS entries FROM pairs GROUP BY ALL"""

ORACLES["catalog_listing"] = f"""
WITH {CATALOG}
SELECT position, name, family, array_to_string(modalities, ', ') AS modalities, license, priority, download_url, price
FROM catalog ORDER BY priority, family, name"""

TAGS = """tags AS (
  SELECT doc_id, 'contact' AS tag FROM documents WHERE contains(lower(text), '@') OR contains(lower(text), '+1 (')
  UNION ALL SELECT doc_id, 'license' FROM documents
    WHERE contains(lower(text), 'license') OR contains(lower(text), 'licence') OR contains(lower(text), 'copyright')
  UNION ALL SELECT doc_id, 'secret' FROM documents
    WHERE contains(lower(text), 'token =') OR contains(lower(text), 'password')
  UNION ALL SELECT doc_id, 'never' FROM documents WHERE contains(lower(text), 'zq-never-zq'))"""

ORACLES["keyword_tag"] = f"WITH {TAGS} SELECT doc_id, tag FROM tags"

ORACLES["keyword_coverage"] = f"""
WITH {TAGS}
SELECT v.tag, count(doc_id) AS records, count(doc_id) = 0 AS missing
FROM (VALUES ('contact'), ('license'), ('secret'), ('never')) v(tag) LEFT JOIN tags USING (tag) GROUP BY v.tag"""

def share(m: str) -> str:
    """A metric scaled to its range; the weight multiplies the scaled value."""
    return f"(({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()))"


RANK = f"""m AS (
  SELECT l_partkey, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) AS m1, round(sum(l_quantity), 6) AS m2, round(sum(l_extendedprice), 2) AS m3,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) AS m4, CAST(count(*) AS DOUBLE) AS m5 FROM lineitem GROUP BY l_partkey),
e AS (SELECT p_partkey, p_brand AS family, m.* REPLACE (CASE WHEN p_partkey % 50 <> 7 THEN m3 END AS m3)
  FROM part JOIN m ON p_partkey = l_partkey),
u AS (
  SELECT p_partkey, family, round(
    0.25::DOUBLE * (1 - {share('m1')}) + 0.20::DOUBLE * {share('m2')} + 0.25::DOUBLE * {share('m3')}
    + 0.15::DOUBLE * (1 - {share('m4')}) + 0.15::DOUBLE * {share('m5')}, 4) AS utility_score FROM e)"""

ORACLES["minmax_utility_rank"] = f"""
WITH {RANK}
SELECT p_partkey, family, utility_score, row_number() OVER (ORDER BY utility_score DESC NULLS LAST, p_partkey) AS rank FROM u"""

ORACLES["top_k"] = f"WITH {RANK} SELECT p_partkey, family, utility_score FROM u ORDER BY utility_score DESC NULLS LAST, p_partkey LIMIT 10"

# --- evaluation ------------------------------------------------------------------------------

LAST = """last AS (
  SELECT doc_id, CASE WHEN quality = 1 THEN text ELSE 'rejected' END AS given FROM labels JOIN documents USING (doc_id))"""

ORACLES["join_predictions"] = digest(
    ('id',),
    ('prediction',),
    f"""
WITH {SAMPLES}, {LAST} SELECT id, coalesce(given, prediction) AS prediction FROM s LEFT JOIN last USING (doc_id)""",
)

ORACLES["exact_match"] = f"""
WITH {SAMPLES}, {scores()}
SELECT id, correct AS value FROM f
UNION ALL SELECT 'label-' || doc_id, CAST(CASE
  WHEN quality = 1 THEN doc_id % 5 IN (0, 1)
  ELSE doc_id % 5 IN (2, 3, 4) END AS INT)::DOUBLE FROM labels"""

ORACLES["token_f1"] = per_sample("f1")
ORACLES["proxy_metric"] = per_sample("consensus_pass")
ORACLES["calibration_error"] = per_sample("calibration_error")
ORACLES["unsafe_action_rate"] = per_sample("unsafe_action_rate")
ORACLES["collision_free_rate"] = per_sample("collision_free_rate")
ORACLES["success_rate"] = long_samples({m: METRICS[m] for m in ("success_rate", "recovery_rate", "task_success")})
ORACLES["generic_metric"] = long_samples({m: METRICS[m] for m in ("wer", "mos", "bleu")})
ORACLES["numeric_lookup"] = long_samples(
    {"memory_gb": METRICS["memory_gb"], "power_w": number("power_w"), "success": flag("success")}
)

VALID = "CAST(CAST(doc_id % 4 = 0 AND doc_id % 3 <> 0 AND doc_id % 7 <> 2 AS INT) AS DOUBLE)"
ORACLES["schema_validity"] = f"SELECT 'call-' || doc_id AS id, {VALID} AS value FROM documents"
ORACLES["tool_error_rate"] = f"""
SELECT 'call-' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN CAST(doc_id % 8 AS DOUBLE) / 8
  WHEN doc_id % 5 = 1 THEN CAST(doc_id % 2 AS DOUBLE) ELSE 1 - {VALID} END AS value FROM documents"""

ORACLES["action_l2"] = """
SELECT 'vec-' || vec_id AS id, vec_id % 10 NOT IN (0, 9) AS valid,
  CASE WHEN vec_id % 10 IN (0, 9) THEN 0.0 ELSE round(sqrt(list_sum(list_transform(range(1, 33), lambda i:
    pow(CAST(embedding[i] AS DOUBLE) - CAST(embedding[i + 32] AS DOUBLE), 2)))), 6) END AS value
FROM embeddings"""

_SYSTEM = ("steps_to_success", "cost_per_success", "frame_action_latency_ms", "prefill_ms")
ORACLES["system_metrics"] = f"""
WITH {SAMPLES}, {scores()}, v AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, {METRICS[m]} AS value FROM f" for m in _SYSTEM)})
SELECT metric, count(value) AS measured, round(sum(value), 3) AS total, {mean4('value')} AS mean FROM v GROUP BY metric"""

ORACLES["macro_average"] = f"WITH {SAMPLES}, {scores()} {macro('f')}"
ORACLES["benchmark_scorecard"] = f"WITH {SAMPLES}, {scores()}, {card()} SELECT * FROM card"
ORACLES["gate_evaluate"] = f"""
WITH {SAMPLES}, {scores()}, {card()}, {judged()}
SELECT *, bool_and(gate_passed) OVER (PARTITION BY benchmark) AS benchmark_passed FROM judged"""
ORACLES["eval_report"] = f"""
WITH {SAMPLES}, {scores()}, {card()}, {judged()},
results AS (
  SELECT c.benchmark, c.dimension, max(c.sample_count) AS sample_count,
    coalesce((SELECT bool_and(gate_passed) FROM judged j WHERE j.benchmark = c.benchmark), true) AS passed
  FROM card c GROUP BY c.benchmark, c.dimension
  UNION ALL VALUES ('core_it', 'general', 0, false), ('core_pt', 'reasoning', 0, true)),
scoped AS (SELECT dimension, sample_count, passed FROM results UNION ALL SELECT '*', sample_count, passed FROM results)
SELECT dimension, count(*) AS benchmarks, CAST(sum(sample_count) AS BIGINT) AS samples,
  CAST(sum(CAST(passed AS INT)) AS BIGINT) AS passed, CAST(sum(CAST(NOT passed AS INT)) AS BIGINT) AS failed,
  round(avg(CAST(passed AS INT)), 4) AS pass_share FROM scoped GROUP BY dimension"""

ORACLES["dimension_weights"] = """
SELECT lang AS dimension, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS weight FROM documents GROUP BY lang"""

ORACLES["benchmark_select"] = """
SELECT source AS benchmark, lang AS dimension, CAST(count(*) AS DOUBLE) AS weight FROM documents
WHERE source IN ('src3', 'fr') OR lang IN ('src3', 'fr') GROUP BY ALL"""

ORACLES["batch_score"] = """
SELECT 'doc-' || doc_id AS id, CASE WHEN contains(text, '@') THEN '{"error": "scorer_failed", "message": "address"}'
  ELSE len(string_split(text, ' ')) || ' words' END AS prediction FROM documents"""

ORACLES["custom_evaluator"] = """
SELECT conv_id, turn, 1.0::DOUBLE AS contains_prompt, CAST(length(role || ' ' || text) AS DOUBLE) AS response_length
  FROM conversations
UNION ALL SELECT page_id, CAST(-1 AS BIGINT), CAST(CAST(contains(lower(url), 'spam-farm') AS INT) AS DOUBLE),
  CAST(length(url) AS DOUBLE) FROM pages"""

_LOWER = ", ".join(f"'{m}'" for m in SCORED_LOWER_IS_BETTER)
ORACLES["compare_runs"] = f"""
WITH {SAMPLES}, {scores()}, {card()}, {LAST},
s2 AS (SELECT s.* REPLACE (coalesce(given, prediction) AS prediction) FROM s LEFT JOIN last USING (doc_id)),
{scores('s2').replace('w AS', 'w2 AS', 1).replace('FROM w ', 'FROM w2 ').replace('JOIN w ', 'JOIN w2 ')
 .replace('overlap AS', 'overlap2 AS').replace('JOIN overlap ', 'JOIN overlap2 ').replace('total AS', 'total2 AS')
 .replace('JOIN total ', 'JOIN total2 ').replace('total.n', 'total2.n').replace('f AS', 'g AS')},
{card('card2', 'g')}
SELECT a.benchmark, a.metric, a.value AS base_value, b.value AS candidate_value, round(b.value - a.value, 4) AS delta,
  CASE WHEN a.metric IN ({_LOWER}) THEN round(b.value - a.value, 4) ELSE -round(b.value - a.value, 4) END > 0.02 AS regressed
FROM card a JOIN card2 b ON a.benchmark = b.benchmark AND a.metric = b.metric"""

# --- rewards, monitors, gates, ledgers -------------------------------------------------------

REWARDS = """r AS (
  SELECT conv_id, turn, role, length(text) AS n, coalesce(CASE WHEN (conv_id + turn) % 3 <> 0 THEN CAST(length(text) AS DOUBLE) / 1000 END,
    CASE WHEN coalesce(CASE WHEN role <> 'system' THEN length(text) > 200 END, true) THEN 1.0 ELSE 0.0 END) AS reward_value
  FROM conversations)"""

ORACLES["reward_advantage"] = f"""
WITH {REWARDS}
SELECT conv_id, turn, round(reward_value, 6) AS reward_value,
  round(reward_value - avg(reward_value) OVER (PARTITION BY conv_id), 6) AS advantage FROM r"""

ORACLES["rollout_monitor"] = f"""
WITH {REWARDS} SELECT role, count(*) AS rollouts, round(avg(reward_value), 6) AS mean_reward,
  round(avg(n), 6) AS mean_length, round(CAST(quantile_cont(n, 0.5) AS DOUBLE), 6) AS median_length,
  round(CAST(quantile_cont(n, 0.95) AS DOUBLE), 6) AS p95_length FROM r GROUP BY role"""

ORACLES["token_accounting"] = """
SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) AS tokens,
  CAST(sum(CAST(props->>'$.k' AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens_seen FROM events"""

ORACLES["loss_spike_ratio"] = """
WITH t AS (SELECT event_id, user_id, value / nullif(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS ratio FROM events)
SELECT event_id, user_id, round(ratio, 6) AS ratio, coalesce(ratio > 1.35, false) AS spike FROM t"""
ORACLES["stream_spike_state"] = ORACLES["loss_spike_ratio"]

ORACLES["nan_incidents"] = """
SELECT user_id, count(*) AS steps, count(*) FILTER (event_type IN ('error', 'signup')) AS nan_incidents
FROM events GROUP BY user_id"""

RULES = """rules(rule, metric, op, threshold, severity) AS (VALUES
  ('data_ingestion_lag', 'data_ingestion_lag_hours', '>', 6.0::DOUBLE, 'warning'),
  ('training_loss_spike', 'loss_spike_ratio', '>', 1.35, 'critical'),
  ('training_nan_detected', 'nan_incidents', '>', 0.0, 'critical'),
  ('gpu_utilization_low', 'gpu_utilization', '<', 0.88, 'warning'),
  ('tool_error_rate_high', 'tool_error_rate', '>', 0.08, 'warning'),
  ('eval_gate_failed', 'eval_gate_passed', '==', 0.0, 'critical'),
  ('edge_power_high', 'edge_power_w', '>', 60.0, 'critical'))"""
FIRING = "CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold ELSE value = threshold END AS firing"

ORACLES["alert_rules"] = f"""
WITH {RULES}, wide AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day,
    round(24 - max(hour(ts) + CAST(minute(ts) AS DOUBLE) / 60), 6) AS data_ingestion_lag_hours,
    round(CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*), 6) AS tool_error_rate,
    CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS nan_incidents,
    round(avg(CAST(props->>'$.k' AS BIGINT)) / 100, 6) AS gpu_utilization,
    round(max(value) / avg(value), 6) AS loss_spike_ratio,
    max(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)::DOUBLE AS eval_gate_passed,
    round(max(value), 6) AS edge_power_w FROM events GROUP BY ALL),
long AS (UNPIVOT wide ON COLUMNS(* EXCLUDE (day)) INTO NAME metric VALUE value)
SELECT day, rule, metric, value, threshold, severity, {FIRING} FROM long JOIN rules USING (metric)"""

ORACLES["ingestion_lag"] = """
WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id),
h AS (SELECT user_id, CAST(epoch_us(max(last_seen) OVER ()) - epoch_us(last_seen) AS DOUBLE) / 3.6e9 AS hours FROM l)
SELECT user_id, round(hours, 6) AS lag_hours, hours > 6 AS firing FROM h"""

ORACLES["slo_report"] = """
WITH n AS (
  SELECT user_id, epoch_us(ts) AS moment, event_type, min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) END) OVER (
    PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events),
g AS (
  SELECT user_id, count(*) AS events, 1 - CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS share,
    max(CASE WHEN event_type = 'purchase' THEN moment END) AS good,
    max(CASE WHEN event_type = 'error' THEN CAST(nxt - moment AS DOUBLE) / 6e7 END) AS wait,
    count(*) FILTER (event_type = 'error' AND nxt IS NULL) AS unrecovered FROM n GROUP BY user_id),
a AS (SELECT *, CAST((SELECT max(moment) FROM n) - good AS DOUBLE) / 3.6e9 AS age FROM g)
SELECT user_id, events, round(share, 6) AS success_share, round(age, 6) AS freshness_hours, round(wait, 6) AS recovery_minutes,
  unrecovered, share >= 0.995 AS success_met, coalesce(age <= 24, false) AS freshness_met,
  unrecovered = 0 AND coalesce(wait, 0) <= 30 AS recovery_met FROM a"""

ORACLES["stage_gate_check"] = """
WITH w AS (
  SELECT event_type AS stage, round(max(value) / avg(value), 6) AS loss_spike_ratio,
    CAST(count(*) FILTER (event_type IN ('error', 'signup')) AS DOUBLE) AS nan_incidents,
    round(avg(CAST(props->>'$.k' AS BIGINT)) / 100, 6) AS gpu_utilization FROM events GROUP BY ALL)
SELECT stage, 'max_loss_spike_ratio' AS gate, 12.0::DOUBLE AS threshold, loss_spike_ratio AS value, loss_spike_ratio <= 12 AS passed FROM w
UNION ALL SELECT stage, 'max_nan_incidents', 0.0, nan_incidents, nan_incidents <= 0 FROM w
UNION ALL SELECT stage, 'min_gpu_utilization', 0.48, gpu_utilization, gpu_utilization >= 0.48 FROM w
UNION ALL SELECT stage, 'max_kl', 0.12, NULL, false FROM w
UNION ALL SELECT stage, 'nan_incidents', 0.0, nan_incidents, nan_incidents = 0 FROM w"""

ORACLES["envelope_check"] = """
WITH targets(target, ml, mm, md, mp) AS (VALUES
  ('server-h100-vllm', 180.0::DOUBLE, 80.0::DOUBLE, 80.0::DOUBLE, NULL::DOUBLE),
  ('edge-orin', 450.0, 24.0, 18.0, 60.0), ('cockpit-soc', 700.0, 16.0, 12.0, 35.0)),
m AS (
  SELECT CASE event_type WHEN 'error' THEN 'edge-orin' WHEN 'purchase' THEN 'cockpit-soc' END AS target,
    round(max(value), 4) AS l, CASE WHEN min(event_type) <> 'error' THEN round(avg(value) / 2, 4) END AS g,
    round(avg(CAST(props->>'$.k' AS DOUBLE)) / 4, 4) AS d,
    round(avg(value), 4) AS p FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL),
j AS (
  SELECT t.*, CASE WHEN m.target IS NULL THEN ml * 0.9::DOUBLE ELSE l END AS latency_ms,
    CASE WHEN m.target IS NULL THEN mm * 0.85::DOUBLE ELSE g END AS memory_gb,
    CASE WHEN m.target IS NULL THEN md * 1.1::DOUBLE ELSE d END AS decode_tokens_per_second,
    CASE WHEN m.target IS NULL THEN coalesce(mp, 100) * 0.8::DOUBLE ELSE p END AS power_w
  FROM targets t LEFT JOIN m USING (target)),
i AS (
  SELECT target, latency_ms, memory_gb, decode_tokens_per_second, power_w, concat_ws('; ',
    CASE WHEN latency_ms > ml THEN 'latency_ms ' || latency_ms || ' exceeds ' || ml END,
    CASE WHEN memory_gb IS NULL THEN 'memory_gb was not measured'
      WHEN memory_gb > mm THEN 'memory_gb ' || memory_gb || ' exceeds ' || mm END,
    CASE WHEN decode_tokens_per_second < md THEN 'decode_tokens_per_second ' || decode_tokens_per_second || ' below ' || md END,
    CASE WHEN power_w > mp THEN 'power_w ' || power_w || ' exceeds ' || mp END) AS issues FROM j)
SELECT *, issues = '' AS passed FROM i"""

def envelope(target: str) -> str:
    return f"(SELECT bool_and(passed) FROM ({ORACLES['envelope_check']}) WHERE target = '{target}')"


ORACLES["release_gates"] = f"""
WITH {SAMPLES}, {scores()}, {card()}, {judged()}, {POOL}, {LEDGER},
ev AS (
  SELECT summary.*, (SELECT bool_and(license NOT IN ('unknown', 'restricted')) FROM attrs) AS lic,
    (SELECT count(*) FROM events WHERE event_type IN ('error', 'signup')) AS nans,
    (SELECT avg(CAST(props->>'$.k' AS BIGINT)) / 100 FROM events) AS gpu,
    (SELECT bool_and(gate_passed) FROM judged) AS core,
    (SELECT min(value) FROM card WHERE dimension = 'vla' AND metric = 'success_rate') AS vla,
    {envelope('server-h100-vllm')} AS server, {envelope('edge-orin')} AS edge FROM summary),
-- No operator measures redaction, conversion, agent tasks, audio scores or sign-off.
absent AS (SELECT CAST(NULL AS BOOLEAN) AS flag, CAST(NULL AS DOUBLE) AS amount),
held AS (
  SELECT 'data_license_and_privacy_approved' AS gate, 'data-governance' AS owner, lic AND flag AS holds,
    lic IS NOT NULL AND flag IS NOT NULL AS evidence_present FROM ev, absent
  UNION ALL SELECT 'data_scale_and_modalities_met', 'data-platform', total_size / 1e12 >= 2500 AND language_count >= 20
    AND len(list_filter(['pure_text', 'multimodal', 'video_pretraining', 'audio_speech', 'vla'],
      lambda m: NOT list_contains(string_split(modalities, ','), m))) = 0,
    total_size IS NOT NULL AND language_count IS NOT NULL AND modalities IS NOT NULL FROM ev
  UNION ALL SELECT 'training_stability_met', 'training-platform', nans = 0 AND gpu >= 0.88, nans IS NOT NULL AND gpu IS NOT NULL FROM ev
  UNION ALL SELECT 'checkpoint_conversion_verified', 'model-platform', flag, flag IS NOT NULL FROM absent
  UNION ALL SELECT 'core_evaluation_passed', 'evaluation-platform', core, core IS NOT NULL FROM ev
  UNION ALL SELECT 'multimodal_vla_evaluation_passed', 'evaluation-platform', vla >= 0.58 AND amount >= 0.5,
    vla IS NOT NULL AND amount IS NOT NULL FROM ev, absent
  UNION ALL SELECT 'audio_speech_evaluation_passed', 'evaluation-platform', flag, flag IS NOT NULL FROM absent
  UNION ALL SELECT 'deployment_envelope_passed', 'serving-platform', server AND edge, server IS NOT NULL AND edge IS NOT NULL FROM ev
  UNION ALL SELECT 'safety_and_governance_signoff', 'release', flag, flag IS NOT NULL FROM absent),
v AS (SELECT gate, owner, evidence_present, evidence_present AND coalesce(holds, false) AS passed FROM held)
SELECT *, NOT passed AS blocked FROM v"""

ORACLES["run_ledger"] = """
WITH k AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL),
e AS (SELECT user_id, string_agg(event_type || '=' || value, ',' ORDER BY event_type) AS entries FROM k GROUP BY ALL),
l AS (
  SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'started' END,
    (ts, event_id)) AS status, count(*) AS updates FROM events GROUP BY ALL)
SELECT user_id AS run_id, status, updates, entries FROM l JOIN e USING (user_id)"""


# --- series ----------------------------------------------------------------------------------

ORACLES["activity_segments"] = """
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, value, value >= 60 AS active, lag(value >= 60) OVER w AS before,
  max(CASE WHEN value >= 60 THEN epoch_us(ts) / 1e6 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CAST(NOT coalesce(before, false) AND coalesce(sec - seen > 10800, true) AS INT))
  OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM e WHERE active)
SELECT user_id, count(*) AS rows, round(min(sec), 6) AS "start", round(max(sec), 6) AS "end", round(sum(value), 6) AS total, max(value) AS peak
FROM n GROUP BY user_id, segment HAVING max(sec) - min(sec) >= 3600"""

ORACLES["action_space_normalize"] = """
WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM events GROUP BY ALL)
SELECT event_id, event_type, round(CASE WHEN value IS NULL THEN NULL WHEN low = high THEN 0.0
  ELSE greatest(-1.0, least(1.0, 2 * (value - low) / (high - low) - 1)) END, 9) AS scaled
FROM events JOIN q USING (event_type)"""

ORACLES["series_fingerprint_dedup"] = """
WITH s AS (SELECT user_id, ts, event_id, value FROM events
  UNION ALL SELECT user_id + 1000000, ts + INTERVAL 3 DAY, event_id, value FROM events WHERE user_id % 10 = 0
  UNION ALL SELECT user_id + 2000000, ts + INTERVAL 5 HOUR, event_id, value FROM events WHERE user_id % 10 IN (0, 5) AND event_id % 23 <> 0),
n AS (SELECT *, lag(value) OVER w AS before, lead(value) OVER w AS behind FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id AS key, ts, event_id, CAST(floor(epoch_us(ts) / 1e6 / 3600.0) AS BIGINT) AS pos, CAST(floor(value / 10.0) AS BIGINT) AS height
  FROM n WHERE value > before AND value >= behind),
l AS (SELECT key, pos, height, unnest([lead({'t': pos, 'h': height}, 1) OVER w, lead({'t': pos, 'h': height}, 2) OVER w,
  lead({'t': pos, 'h': height}, 3) OVER w]) AS next FROM p WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)),
m AS (SELECT DISTINCT key, pos, height AS first, next.h AS second, next.t - pos AS apart FROM l WHERE next IS NOT NULL),
b AS (SELECT key, min(pos) AS begin, count(*) AS n FROM m GROUP BY key),
f AS (SELECT key, begin, n, list((pos - begin, first, second, apart) ORDER BY pos, first, second, apart) AS whole FROM m JOIN b USING (key) GROUP BY ALL),
c AS (SELECT key, n, begin, min(key) OVER (PARTITION BY whole) AS rep, arg_min(begin, key) OVER (PARTITION BY whole) AS rep_begin FROM f),
r AS (SELECT m.* FROM m JOIN c USING (key) WHERE c.key = c.rep),
h AS (SELECT x.key AS key_a, y.key AS key_b, y.pos - x.pos AS shift, count(*) AS votes FROM r x JOIN r y USING (first, second, apart)
  WHERE x.key < y.key GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT *, row_number() OVER (PARTITION BY key_a, key_b ORDER BY votes DESC, shift) AS place FROM h)
SELECT key_a, key_b, shift, votes, false AS copy FROM t WHERE place = 1
UNION ALL SELECT rep, key, begin - rep_begin, n, true FROM c WHERE key <> rep AND n >= 5"""


def _branches(name: str, rows: str) -> str:
    shown = " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-') || ','" for c in ("doc_id", "text", "lang"))
    sums = ", ".join(f"sum(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)) AS s{i}" for i in range(4))
    return f"""{name}_rows AS (SELECT coalesce(source, '') AS shard, coalesce(length(text), 0) AS size, md5({shown}) AS d FROM {rows}),
{name}_folded AS (SELECT shard, substr(d, 1, 2) AS branch, count(*) AS rows, CAST(sum(size) AS BIGINT) AS size, {sums} FROM {name}_rows GROUP BY ALL),
{name} AS (SELECT shard, branch, rows, size, md5(concat_ws(',', rows, s0, s1, s2, s3)) AS digest FROM {name}_folded)"""


_NAMED_SUMS = ", ".join(f"sum(CAST('0x' || substr(md5(shard || ':' || digest), {8 * i + 1}, 8) AS BIGINT))" for i in range(4))
ORACLES["manifest_snapshot"] = f"""
WITH {_branches("b", "documents")},
s AS (SELECT shard, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(size) AS BIGINT) AS size,
  md5(string_agg(branch || ':' || digest, ',' ORDER BY branch)) AS digest FROM b GROUP BY shard)
SELECT *, (SELECT md5(concat_ws(',', {_NAMED_SUMS})) FROM s) AS snapshot_id FROM s"""

ORACLES["manifest_changes"] = f"""
WITH edited AS (SELECT * REPLACE (CASE WHEN doc_id % 97 = 5 THEN text || '!' ELSE text END AS text) FROM documents WHERE length(text) > 20),
{_branches("o", "documents")},
{_branches("n", "edited")}
SELECT shard, branch, coalesce(o.rows, 0) AS rows_before, coalesce(n.rows, 0) AS rows_after
FROM o FULL JOIN n USING (shard, branch) WHERE o.digest IS DISTINCT FROM n.digest"""


# --- streams ---------------------------------------------------------------------------------


def windows(days: int) -> str:
    starts = ", ".join(f"date_trunc('day', ts) - INTERVAL {d} DAY" for d in range(days))
    return f"""
WITH {RULES}, spread AS (SELECT unnest([{starts}]) AS start, event_type, value FROM events),
wide AS (
  SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start,
    round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS tool_error_rate,
    CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS nan_incidents, max(value) AS edge_power_w
  FROM spread GROUP BY ALL),
long AS (UNPIVOT wide ON tool_error_rate, nan_incidents, edge_power_w INTO NAME metric VALUE value)
SELECT window_start, rule, value, severity, {FIRING} FROM long JOIN rules USING (metric)"""


ORACLES["stream_window_alerts"] = windows(1)
ORACLES["stream_sliding_alerts"] = windows(2)

ORACLES["stream_late_audit"] = """
WITH a AS (SELECT *, event_id % 5 AS arrival FROM events),
top AS (SELECT arrival, max(ts) AS newest FROM a GROUP BY arrival),
b AS (SELECT arrival, max(newest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM top),
r AS (SELECT event_type, CASE WHEN coalesce(ts < seen - INTERVAL 1 HOUR, false) THEN 'late' ELSE 'timely' END AS route
  FROM a JOIN b USING (arrival))
SELECT route, event_type, count(*) AS rows FROM r GROUP BY ALL"""

ORACLES["stream_sessions"] = """
WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS opens FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT user_id, ts, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS number FROM e),
s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS events FROM n GROUP BY user_id, number)
SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(b, '%Y-%m-%d %H:%M:%S') AS session_end, events,
  b > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS open FROM s"""

# The twin's edit distance counts bytes, so every distinct unit of a pair is written as one byte.
HEARD = r"""pairs AS (SELECT item_id, string_split(text, ' ') AS words, text FROM benchmark),
heard AS (SELECT item_id, text, array_to_string(list_filter(list_transform(words, lambda w, i:
  CASE WHEN i % 5 = 0 THEN '' WHEN i % 7 = 0 THEN w || ' ' || w ELSE w END), lambda w: w <> ''), ' ') AS answer FROM pairs)"""


def error_rate(name: str, units: str) -> str:
    def written(column: str) -> str:
        return f"array_to_string(list_transform({column}, lambda u: chr(CAST(list_position(k, u) AS INT))), '')"

    return f"""
WITH {HEARD}, u AS (SELECT item_id, {units.format('text')} AS a, {units.format('answer')} AS b FROM heard),
n AS (SELECT item_id, a, b, list_distinct(list_concat(a, b)) AS k FROM u)
SELECT item_id, round(CAST(levenshtein({written('a')}, {written('b')}) AS DOUBLE) / greatest(len(a), 1), 6) AS {name} FROM n"""


ORACLES["word_error_rate"] = error_rate("wer", r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')")
ORACLES["char_error_rate"] = error_rate("cer", "string_split({0}, '')")

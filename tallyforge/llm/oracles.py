"""SQL twins of the registered queries that SQL can express."""

ORACLES: dict[str, str] = {}

_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"

ORACLES["op5_chat_format"] = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), digested AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        CAST(sum(14 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
    FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
    sha256(loss) AS loss_sha256, formatted_chars, CAST(0 AS BIGINT) AS n_attachments
FROM digested
"""

ORACLES["op11_filter_audit"] = r"""
WITH RECURSIVE letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, applied, step, bits) AS (
    SELECT '', 0, 0, CAST([] AS INTEGER[])
    UNION ALL
    SELECT filter_order || letter, applied | bit, step + 1, list_append(bits, bit)
    FROM orders JOIN letters ON applied & bit = 0
),
texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
marked AS (
    SELECT part,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask,
        doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good,
        doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
    FROM texts
),
cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL
),
steps AS (
    SELECT filter_order, s.step, bits[s.step] AS bit, CAST(list_sum(bits[1:s.step - 1]) AS INTEGER) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step) AS s WHERE orders.step = 5
),
metrics AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0) | bit) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0), 0) AS removed,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) <> 0), 0) AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & coalesce(earlier, 0) = 0), 0) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
    CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM metrics
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
    FROM documents
),
drawn AS (
    SELECT *, len(units) AS n, [CAST('0x' || substr(digest, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM cut
),
parts AS (
    SELECT doc_id, text, n, array_to_string(units[1:least(h[1] % (n + 1), h[2] % (n + 1))], '') AS prefix,
        array_to_string(units[least(h[1] % (n + 1), h[2] % (n + 1)) + 1:greatest(h[1] % (n + 1), h[2] % (n + 1))], '') AS middle,
        array_to_string(units[greatest(h[1] % (n + 1), h[2] % (n + 1)) + 1:], '') AS suffix,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 100 THEN 'plain'
             WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""

ORACLES["op13_top_products"] = """
WITH points AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
    FROM points q, points p WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
),
ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

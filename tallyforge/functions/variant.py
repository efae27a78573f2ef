"""Open JSON payloads as VARIANT.

These helpers take and return SQL expression text: a nested payload expression
then reaches Spark as one string to parse, instead of thousands of calls.
"""

from __future__ import annotations

# Values that Spark keeps as numbers inside a VARIANT.
NUMBER_KINDS = "'BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT'"


def bind(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once however often it is named."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def field(payload: str, key: str) -> str:
    """The value under ``key``; SQL NULL only when the key is absent."""
    return f"""try_variant_get({payload}, '$["{key}"]', 'variant')"""


def items(value: str) -> str:
    """Elements of a JSON list; NULL for anything else."""
    return f"try_variant_get({value}, '$', 'array<variant>')"


def entries(value: str) -> str:
    """Fields of a JSON object as a map; NULL for anything else."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def kind(value: str) -> str:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, OBJECT or ARRAY."""
    return f"regexp_extract(schema_of_variant({value}), '^[A-Z]+', 0)"


def text_of(value: str) -> str:
    """Display text of a JSON value: ``True``, ``None``, ``12.0``, else as written."""
    shown = f"""CASE WHEN _s = 'STRING' THEN CAST(_t AS STRING)
        WHEN _s = 'BOOLEAN' THEN initcap(CAST(_t AS STRING))
        WHEN _s = 'VOID' THEN 'None'
        WHEN _s RLIKE r'^DECIMAL\\(([1-9]|1[0-8]),0\\)$' THEN concat(CAST(_t AS STRING), '.0')
        WHEN _s RLIKE '^(OBJECT|ARRAY)' THEN {spaced_json('_t')}
        ELSE CAST(_t AS STRING) END"""
    return bind(value, "_t", bind("schema_of_variant(_t)", "_s", shown))


def spaced_json(value: str) -> str:
    """JSON with sorted keys and a blank after each structural comma and colon.

    VARIANT keeps object keys sorted; one possessive expression, tied to the end of
    its last match, steps over string literals, so the pass is linear in the text.
    """
    structural = r"""\G((?:"(?:[^"\\]|\\.)*+"|[^",:])*+)([,:])"""
    return f"regexp_replace(to_json({value}), r'{structural}', '$1$2 ')"


def object_of(value: str) -> str:
    """A VARIANT that is an object, or text holding one; else NULL."""
    candidate = f"""CASE {kind('_p')} WHEN 'OBJECT' THEN _p
        WHEN 'STRING' THEN try_parse_json(CAST(_p AS STRING)) END"""
    checked = f"CASE WHEN {kind('_o')} = 'OBJECT' THEN _o END"
    return bind(bind(value, "_p", candidate), "_o", checked)


def first_present(payload: str, keys: tuple[str, ...]) -> str:
    """Value of the first key that exists, even when its value is JSON null."""
    return "coalesce(" + ", ".join(field(payload, key) for key in keys) + ")"


def truthy(value: str) -> str:
    """Whether a JSON value is given: not absent, null, false, zero or empty."""
    given = f"""CASE {kind('_g')}
        WHEN 'STRING' THEN CAST(_g AS STRING) <> ''
        WHEN 'BOOLEAN' THEN CAST(_g AS STRING) = 'true'
        WHEN 'OBJECT' THEN to_json(_g) <> '{{}}'
        WHEN 'ARRAY' THEN to_json(_g) <> '[]'
        WHEN 'VOID' THEN false
        ELSE try_cast(CAST(_g AS STRING) AS DOUBLE) <> 0 END"""
    return f"coalesce({bind(value, '_g', given)}, false)"


def first_truthy(payload: str, keys: tuple[str, ...]) -> str:
    """Display text of the first key whose value is given; NULL when there is none."""
    given = [bind(field(payload, key), "_f", f"CASE WHEN {truthy('_f')} THEN {text_of('_f')} END") for key in keys]
    return "coalesce(" + ", ".join(given) + ")"


def element_text(element: str) -> str:
    """Display text of a list element; Spark hands a JSON null in a list over as SQL NULL."""
    return f"coalesce({text_of(element)}, 'None')"


def references_of(value: str) -> str:
    """Array of display texts: a JSON list element-wise, a scalar as one, absent or null as none."""
    listed = f"""CASE {kind('_r')}
        WHEN 'ARRAY' THEN transform({items('_r')}, _e -> {element_text('_e')})
        WHEN 'VOID' THEN NULL
        ELSE array({text_of('_r')}) END"""
    return f"coalesce({bind(value, '_r', f'CASE WHEN _r IS NOT NULL THEN {listed} END')}, CAST(array() AS ARRAY<STRING>))"

import json

import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents from (doc_id, text) or (doc_id, text, source) tuples."""

    def build(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


def plain(rows):
    """Rows as sorted JSON texts, to compare as bags."""
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in rows)

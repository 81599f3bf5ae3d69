from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """docs([(doc_id, text)], **extra): documents with columns whose names the operators use too."""

    def build(rows, *extra):
        ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {c} string" for c in extra)
        full = [(i, t, "en", "s", None if t is None else len(t), *("x" for _ in extra)) for i, t in rows]
        return spark.createDataFrame(full, ddl)

    return build

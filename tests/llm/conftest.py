import os

import pytest

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _slot int, base string, hash string, key long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) with extra columns whose names clash with inner ones."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", "y", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def words():
    """Deterministic words, all different."""
    return lambda n, tag="w": [f"{tag}{i:04d}" for i in range(n)]



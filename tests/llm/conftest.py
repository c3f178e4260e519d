from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, h1 string, pos string"


@pytest.fixture(scope="session")
def spark():
    from colloquy.session import build_session, checkpoint_dir

    s = build_session("local[*]", app="colloquy-llm-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    return s


@pytest.fixture()
def make(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def build(rows):
        full = [(i, t, "en", s, len(t or ""), "w", "h", "p") for i, t, s in ((*r, "src0")[:3] for r in rows)]
        return spark.createDataFrame(full, DOCS)

    return build

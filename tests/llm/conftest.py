import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wattledger.llm.common import ship_package  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds a documents table with extra columns whose names operators use themselves; nulls wherever they may be."""
    ship_package(spark)

    def build(rows):
        full = [(i, t, None if k % 3 else "en", None, len(t) if t else None, 0.5, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def labelled(spark):
    def build(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return build

"""Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, score double, key string"


@pytest.fixture(scope="session")
def odd(spark):
    long = " ".join(f"word{i % 977} Other{i % 13}" for i in range(20_000))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "  \t\n", "one", "one two", passage, f"before {passage} after", f"{passage} {passage}", long, "Of " * 300, "café Ünïcode ÀB 你好 مرحبا", "x" * 5000, "MIT", None, "one two", "12 34 !! ??"]
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None, len(t or ""), -1, -1, -1.0, "k") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, passage, None, None, 0, 0, 0, 0.0, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

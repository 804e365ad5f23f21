from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from mailstrata.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "mailstrata-tests",
                            **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """``table({path: raw bytes})`` -> raw messages."""
    from mailstrata.sources.mail import from_table

    def make(messages: dict[str, bytes]):
        rows = [(path, bytearray(raw)) for path, raw in messages.items()]
        return from_table(spark.createDataFrame(rows, "source_path string, raw binary"))

    return make


def grouped(df, *columns: str) -> dict[str, list]:
    """{source_path: sorted rows of the chosen columns}."""
    out: dict[str, list] = {}
    for row in df.select("source_path", *columns).collect():
        value = row[1] if len(columns) == 1 else tuple(row[1:])
        out.setdefault(row[0], []).append(value)
    return {k: sorted(v, key=repr) for k, v in out.items()}

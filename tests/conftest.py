import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from readloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture
def reads_of(spark):
    def make(*rows):
        """(acc, seq, qual) triples, or only sequences, in order."""
        full = [
            (i, *(r if isinstance(r, tuple) else (f"@r{i}", r, None if r is None else "I" * len(r)))) for i, r in enumerate(rows)
        ]
        return spark.createDataFrame([(o, a, s, "+", q) for o, a, s, q in full], "ordinal bigint, acc string, seq string, sep string, qual string")

    return make

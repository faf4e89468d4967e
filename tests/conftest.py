import os

# Before NumPy is loaded: one thread for its linear algebra, which else may wait for its own threads beside the JVM.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sunloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def rows(df):
    """Rows as sorted tuples, columns by name."""
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)

import os
import sys
from types import SimpleNamespace

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lastmile.session import checkpoint_dir, get_session

    s = get_session(master="local[*]", partitions=8, app="lastmile-tests")
    checkpoint_dir(s, local_fallback=True)
    yield s
    s.stop()


@pytest.fixture()
def tables(spark):
    """Build a stand-in for ``Tables`` from ``{name: (ddl_schema, rows)}``."""

    def make(**specs):
        return SimpleNamespace(**{name: spark.createDataFrame(rows, schema) for name, (schema, rows) in specs.items()})

    return make


def rows_of(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from harborlight import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.local_session(
        "tests", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as a list of dicts, ordered by the given columns."""

    def collect(df, *order):
        found = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(found, key=lambda r: tuple(str(r[c]) for c in order)) if order else found

    return collect

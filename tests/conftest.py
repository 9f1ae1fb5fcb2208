import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from waymark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted plain tuples of a frame; floats rounded."""

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        found = [tuple(plain(v) for v in r) for r in picked.collect()]
        return sorted(found, key=lambda t: tuple((v is not None, str(v)) for v in t))

    return collect

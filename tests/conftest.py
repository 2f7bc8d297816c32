import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SESSION = []


def pytest_sessionstart(session):
    """Before collection: columns can only be made while there is a session."""
    from quillspan.session import local_session

    folder = tempfile.mkdtemp(prefix="quillspan-tests-")
    SESSION.append(local_session(4, 4, "4g", **{"spark.checkpoint.dir": f"file://{folder}/shared", "spark.sql.warehouse.dir": f"{folder}/warehouse"}))


@pytest.fixture(scope="session")
def spark():
    yield SESSION[0]
    SESSION[0].stop()

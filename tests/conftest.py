import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from resalelens.session import get_session
    ckpt = tempfile.mkdtemp(prefix="resalelens-test-ckpt-")
    s = get_session("local[4]", 8, app_name="resalelens-tests",
                    extra={"spark.checkpoint.dir": ckpt, "spark.driver.memory": "4g"})
    s.sparkContext.setCheckpointDir(ckpt)
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (optionally of the given columns)."""
    if cols:
        df = df.select(*cols)
    return [tuple(r) for r in df.collect()]

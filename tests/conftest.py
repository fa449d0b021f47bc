import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corpusweave.session import local_session
    s = local_session("*", shuffle_partitions=8, app="corpusweave-tests")
    yield s
    s.stop()


def sources_df(spark, files: dict[str, bytes]):
    """sources(path, modificationTime, length, content) from literal files."""
    import datetime as dt
    rows = [(p, dt.datetime(2024, 1, 1), len(b), bytearray(b)) for p, b in files.items()]
    return spark.createDataFrame(rows, "path string, modificationTime timestamp, length bigint, content binary")

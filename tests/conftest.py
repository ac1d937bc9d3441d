import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


def core_queries():
    """The queries of the library proper: without the optional operators and
    their pipeline."""
    import __spark_entry__ as E
    return {n: f for n, f in E.queries().items() if not n.startswith(("op", "pipeline"))}


@pytest.fixture(scope="session")
def spark():
    from quizlens.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="quizlens-tests")
    yield s

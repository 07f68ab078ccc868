import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from boutique.session import build_session

    import tempfile

    # The session's catalog lives in a fresh scratch folder, not in the working tree.
    warehouse = tempfile.mkdtemp(prefix="run-warehouse-", dir="/tmp")
    s = build_session("local[4]", shuffle_partitions=4, extra={"spark.sql.warehouse.dir": warehouse})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_small():
    if not os.path.exists(f"{SF_SMALL}/orders.parquet"):
        pytest.skip("test data not available")
    return SF_SMALL

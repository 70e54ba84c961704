import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline import schemas  # noqa: E402
from sightline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def hdrs(d):
    return [(k, v) for k, v in (d.items() if isinstance(d, dict) else d)]


def row(seq=1, method="GET", url="https://h.example/", req=(), params=(), req_body="", status=200, resp=(), ct="text/html", body=""):
    host = url.split("/")[2].split(":")[0] if "://" in url else ""
    path = "/" + url.split("://", 1)[-1].split("/", 1)[-1].split("?")[0] if "/" in url.split("://", 1)[-1] else "/"
    return (seq, None, "proxy", method, url, host, path, hdrs(req), [tuple(p) for p in params], req_body, status, hdrs(resp), ct, body)


@pytest.fixture
def exchanges(spark):
    return lambda *rows: spark.createDataFrame(list(rows), schemas.EXCHANGES)

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from candlewick.schema import BAR_SCHEMA  # noqa: E402
from candlewick.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="candlewick-tests")
    yield s
    s.stop()


def days(n, start=dt.date(2024, 1, 1), weekdays_only=False):
    out, d = [], start
    while len(out) < n:
        if not weekdays_only or d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


@pytest.fixture
def make_bars(spark):
    def build(closes, symbol="S", volumes=None, start=dt.date(2024, 1, 1), weekdays_only=False):
        ds = days(len(closes), start, weekdays_only)
        vols = volumes if volumes is not None else [1000.0] * len(closes)
        def f(x):
            return None if x is None else float(x)

        rows = [(symbol, d, f(c), f(c), f(c), f(c), f(v), "test") for d, c, v in zip(ds, closes, vols)]
        return spark.createDataFrame(rows, BAR_SCHEMA)

    return build

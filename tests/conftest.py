import datetime as dt

import pytest

from larder.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", "tests", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def history(spark):
    """Build a (series, date, qty_sold) table from {series: (first day, quantities)}."""

    def build(series):
        rows = [
            (name, first + dt.timedelta(days=i), float(q))
            for name, (first, quantities) in series.items()
            for i, q in enumerate(quantities)
        ]
        return spark.createDataFrame(rows, "series string, date date, qty_sold double")

    return build


def rows_of(frame, *order):
    return [tuple(r) for r in frame.orderBy(*order).collect()]

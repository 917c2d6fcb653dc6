import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sightline.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    made = session(
        "sightline-tests", "local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"},
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def pages_of(spark):
    """A page table of the given markup."""

    def make(*sources, site="http://a.test"):
        rows = [(n, f"{site}/{n}", html) for n, html in enumerate(sources)]
        return spark.createDataFrame(rows, "page_id long, url string, html string")

    return make

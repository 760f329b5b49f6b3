import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from check_queries import session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def star(spark):
    from cohortia.sources.tables import table_star
    return table_star(spark, FOLDER)


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def rows_of(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)

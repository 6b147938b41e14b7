import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 2)
    session.sparkContext.setLogLevel("ERROR")
    # Fixtures are tiny: compiling their plans costs more than interpreting them.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture()
def ids():
    def listed(df, column="id"):
        return [row[column] for row in df.collect()]

    return listed

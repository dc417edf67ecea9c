import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """Run a pipeline over a few rows and give the records back as JSON objects."""
    import json

    import millrace as m

    def run(rows, schema, pipeline, **options):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        out = m.apply_flow(df, pipeline, "json", **options)
        return [json.loads(r.event) for r in out.collect()]

    return run

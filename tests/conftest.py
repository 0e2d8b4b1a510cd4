import pytest

from claimspark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark_ui_enabled="false", spark_sql_shuffle_partitions="4",
        spark_driver_memory="4g", spark_checkpoint_dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a DataFrame as dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]

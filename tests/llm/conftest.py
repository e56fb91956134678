import pytest

from tests.llm import data


@pytest.fixture(scope="session")
def docs():
    return data.documents()


@pytest.fixture(scope="session")
def folder(spark, docs, tmp_path_factory):
    labels = [(d[0], int(d[0] % 3 > 0), 0) for d in docs[:100]] + [(5, None, 0), (6, 7, 0), (None, 1, 0)]
    return data.write(spark, tmp_path_factory.mktemp("docs"), docs, labels)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    return data.write(spark, tmp_path_factory.mktemp("none"), [])

import pytest

from themeloom.runtime import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    return local_session(
        8, 4, **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": folder}
    )


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"

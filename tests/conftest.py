import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from panelcast.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="panelcast-tests",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def survey(spark):
    from fixtures import survey_tables

    return survey_tables(spark)

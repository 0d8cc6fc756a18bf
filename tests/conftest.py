import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.oracle_check import duck, session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def con():
    return duck(TESTDATA)


@pytest.fixture(scope="session")
def sf_dir():
    return TESTDATA


@pytest.fixture(scope="session")
def analyse(spark):
    """Analyse (filename, code) pairs; documents by file name."""
    from srcgauge import analyze

    def run(*files, **options):
        rows = [(name, name, code) for name, code in files]
        df = spark.createDataFrame(rows, "file_id string, filename string, code string")
        return {r.file_id: r for r in analyze(df, **options).collect()}

    return run

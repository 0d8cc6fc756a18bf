import pyarrow.dataset as ds
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    return ds.dataset(f"{SMALL}/documents.parquet").to_table().to_pylist()


@pytest.fixture(scope="session")
def frame(spark):
    """A documents-like frame: (doc_id, text) with a clashing extra column."""

    def make(rows, schema="doc_id long, text string, shard string, score string"):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], schema)

    return make

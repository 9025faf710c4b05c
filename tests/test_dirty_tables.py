import pytest
from dirty import rows, write_dirty, write_empty

from mesoflow.plans import problems

TABLES = ["detections", "tracks", "job_meta", "chunk_files"]
FOUND = [n for n in problems.QUERIES if n != "p2_consolidated"]


@pytest.fixture(scope="module")
def dirty(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("dirty"))
    write_dirty(spark, sf_dir, d, TABLES)
    return d


@pytest.fixture(scope="module")
def empty(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    write_empty(spark, sf_dir, d, TABLES)
    return d


@pytest.mark.parametrize("name", FOUND)
def test_extra_columns_and_null_rows_change_nothing(spark, sf_dir, dirty, name):
    assert rows(problems.QUERIES[name](spark, dirty)) == rows(problems.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", list(problems.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert problems.QUERIES[name](spark, empty).count() == 0


def test_consolidation_of_dirty_files(spark, sf_dir, dirty):
    a, b = (problems.p2_consolidated(spark, d).agg({"n_rows": "sum"}).first()[0] for d in (sf_dir, dirty))
    assert a == b

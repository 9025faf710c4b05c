import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from dirty import rows, write_dirty, write_empty  # noqa: E402

from mesoflow.llm.queries import QUERIES  # noqa: E402

TABLES = ["documents", "eval_items", "mix_targets"]


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


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "p7_shares"])
def test_extra_columns_and_null_rows_change_nothing(spark, sf_dir, dirty, name):
    assert rows(QUERIES[name](spark, dirty)) == rows(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0

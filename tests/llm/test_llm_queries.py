"""Every query of the subpackage runs over the driver's tables, and equals its SQL where it has one."""

import os

import pytest

import __spark_entry__ as contract
from compare import FOLDER, compare, open_oracle
from tideline.llm.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")

ROWS = {"op2": "pages", "op4": "pages", "op10": "pages"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    if name in ORACLE:
        assert compare(df, open_oracle(FOLDER), contract.oracle_sql()[name]) is None
    elif name.startswith("op5"):
        assert df.groupBy("query_id").count().where("count <> 5").isEmpty() and not df.isEmpty()
    elif name.startswith("op11"):
        assert df.where("n_near = 0 AND form IS NOT NULL OR (form IS NULL) <> (root = word)").isEmpty() and not df.isEmpty()
    else:
        table = ROWS.get(name.split("_")[0], "documents")
        assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and "pipeline" in contract.queries()

"""Every registered query runs, and equals its check where it has one."""

import os
import re

import pytest

import __spark_entry__ as contract
from compare import FOLDER, compare, open_oracle
from tideline.queries.registry import DERIVED, QUERIES, table_names

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")

NAMES = sorted(QUERIES)
CHECKS = contract.oracle_sql()
RUNS = contract.queries()


@pytest.fixture(scope="module")
def oracle():
    connection = open_oracle(FOLDER)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, oracle, name):
    df = RUNS[name](spark, FOLDER)
    if name in CHECKS:
        assert compare(df, oracle, CHECKS[name]) is None
    else:
        assert df.count() > 0


# Columns whose every listed value must occur, so that no branch is checked against nothing.
VALUES = {
    "policy_counts": None,
    "ui_policy_map": None,
    "group_policy_join": None,
    "candidate_integrity": ("intact", {True, False}),
    "new_table_flag": ("is_new", {True, False}),
    "growth_average": ("spike_days", {1}),
    "evidence_equal": ("same", {True, False}),
    "policy_validation": ("policy", {"ARCHIVE", "DO_NOT_ARCHIVE", "REVIEW_REQUIRED"}),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_checks_are_not_hollow(spark, name):
    rows = RUNS[name](spark, FOLDER).collect()
    assert rows
    if VALUES[name]:
        column, wanted = VALUES[name]
        assert wanted <= {r[column] for r in rows}


def test_entry(spark):
    assert contract.entry(spark).count() == 1


def test_all_queries_have_a_check():
    assert set(NAMES) == set(CHECKS)


def test_derived_tables_come_from_the_driver():
    for name, sql in DERIVED.items():
        assert table_names(sql), name


def test_folder_names():
    names = [d for _, folders, _ in os.walk(os.path.dirname(contract.__file__)) for d in folders]
    assert not [d for d in names if re.match(r"op\d", d)]

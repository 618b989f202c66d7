"""Queries over every name and every kind of row, against their SQL on the smallest tables."""

import os

import pytest

from tests.test_queries import SF, test_query_matches_sql as matches


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["series_owned_whole_all", "scoped_tombstone_all", "add_members_all"])
def test_every_name_is_compared(spark, name):
    matches(spark, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_flattening_keeps_every_kind_of_row(spark):
    matches(spark, "flatten_directory_whole")

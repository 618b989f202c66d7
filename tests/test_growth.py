"""What keeps work in proportion to the input: rows are not spread before they are folded, and nothing is folded or joined twice."""

import os

import pytest
from pyspark.sql import functions as F

import lamina.plans.stored  # noqa: F401 - adds its queries to the catalogue
from lamina.operators.edit import Directory, WorkingRecord
from lamina.operators.record import DirectoryRecord, LayeredRecord
from lamina.operators.resolve import Resolver
from lamina.plans.data import SCHEMA, Tables, layers, pairs, stack
from lamina.sources.store import Store
from tests.test_queries import SF, test_query_matches_sql as matches

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_counted_once_a_session(spark):
    pairs(Tables(spark, SF)).unpersist()
    ends = layers(spark, SF)[0]
    for f in (ends.components["Link"], ends.connections["Link"], ends.inputs["efficiency"]):
        assert "InMemoryRelation" in plan(f)


def test_flags_are_folded_before_labels_are_spread(spark):
    got = plan(stack(spark, SF, 3).inputs_map(["demand"]))
    assert "Aggregate" in got[got.index("Generate explode") :].split("Union")[0].replace("collect_set", "")


def test_a_single_layer_is_read_without_a_join_of_its_keys(spark):
    rows = stack(spark, SF, 0).attribute("demand")
    assert "bit_or" not in plan(rows)
    assert rows.count() == stack(spark, SF, 0).attribute("demand", rows.select("name")).count()


def test_a_removal_below_is_not_passed_over(spark):
    """The attribute is of one layer, but a later one removes some of its names."""
    every = layers(spark, SF)
    rows = Resolver(spark, SCHEMA, [every[0], every[2]]).attribute("demand")
    dead = rows.filter("CAST(substr(name, 2) AS INT) % 97 = 0 OR (CAST(substr(name, 2) AS INT) % 89 = 0 AND scenario = 'low')")
    assert dead.isEmpty() and not rows.isEmpty()


def test_settled_rows_are_columns_on_disk(spark):
    w = WorkingRecord(LayeredRecord(stack(spark, SF, 0)))
    w.set("demand", F.col("value") * 2)
    w._resolver.layers[-1].inputs["demand"].count()
    assert "Relation" in plan(w._values[0][3]) and "parquet" in plan(w._values[0][3])


def test_a_directory_is_written_from_maps_folded_once(spark, tmp_path, monkeypatch):
    folds, real = [], Resolver._entity_map
    monkeypatch.setattr(Resolver, "_entity_map", lambda self, kind: folds.append(kind) or real(self, kind))
    root = f"file://{tmp_path}"
    WorkingRecord(LayeredRecord(stack(spark, SF, 3)), Store(spark, root)).commit(Directory(f"{root}/flat"))
    assert sorted(folds) == ["components", "connections"]


def test_flags_of_a_directory_are_read_once(spark, monkeypatch):
    d = lamina.plans.stored._directory(spark, SF)
    first = d.flags("Customer")
    monkeypatch.setattr(DirectoryRecord, "attributes", property(lambda self: pytest.fail("read again")))
    assert first["demand"].varies == {"snapshot"} and d.flags("Part")["price"].breakpoints and d.flags("none") == {}


@pytest.mark.parametrize("name", ["store_connections", "store_overlay", "store_materialised", "store_owner_map", "edits_rolled_back", "flatten_directory", "directory_flags", "repeated_coordinates", "commit_new_child", "derived_edit", "staged_tombstone_wins", "values_normalised", "add_members", "read_with_pending"])
def test_results_stay_those_of_the_sql(spark, name):
    matches(spark, name)

"""Edits, commits, stores and writes."""

import pytest
from pyspark.sql import functions as F

from lamina.operators.edit import Directory, NewChild, WorkingRecord, normalise_value
from lamina.operators.record import DirectoryRecord, LayeredRecord
from lamina.operators.resolve import Resolver
from lamina.operators.write import RecordError, write_record
from lamina.schema import AttributeSpec, Dimension, Schema, SchemaError
from lamina.sources.layers import Layer
from lamina.sources.store import Store, ingest, try_read
from tests.test_records import LONG, SCHEMA, got, members, rows, scenarios


class Source:
    def __init__(self, schema, **parts):
        self.schema = schema
        for k in ("dims", "components", "connections", "attributes", "outputs"):
            setattr(self, k, parts.get(k, {}))


def base(spark):
    gens = members(spark, ("x", None, False, 0), ("y", None, False, 1))
    series = rows(spark, *[dict(name="x", hour=h, value=float(h)) for h in range(3)], dict(name="y", value=5.0))
    hours = spark.createDataFrame([(h, h) for h in range(3)], "hour bigint, _row bigint")
    return Layer("a", scenarios(spark, "low", "high") | {"hour": hours}, components=gens, inputs={"p": series}, outputs={"res": rows(spark, dict(name="x", value=1.0), attribute="res")})


def working(spark):
    return WorkingRecord(LayeredRecord(Resolver(spark, SCHEMA, [base(spark)])))


def values(w, scenario="high"):
    return got(w.attributes["p"].filter(F.col("scenario") == scenario), "name", "hour", "value")


def test_values_of_every_form():
    assert normalise_value(1.0, ["a"], None) == [(None, None, 1.0)]
    assert normalise_value([1, 2], ["a", "b"], [0, 1, 2]) == [("a", None, 1), ("b", None, 2)]
    assert normalise_value([1, 2, 3], ["a"], [0, 1, 2]) == [(None, 0, 1), (None, 1, 2), (None, 2, 3)]
    assert normalise_value({"a": 1}, ["a", "b"], [0]) == [("a", None, 1)]
    assert normalise_value({0: 1}, ["a"], [0]) == [(None, 0, 1)]
    for bad in ([1, 2, 3], {"q": 1}):
        with pytest.raises(ValueError):
            normalise_value(bad, ["a", "b"], None)
    with pytest.raises(ValueError):
        normalise_value([1, 2], ["a", "b"], [0, 1])


def test_set_reads_back_and_rolls_back(spark):
    w = working(spark)
    w.set("p", 7.0, names="y")
    assert values(w)[-1] == ("y", None, 7.0)
    w.set("p", 8.0, names="y", scenario="high")
    assert values(w)[-1] == ("y", None, 8.0) and values(w, "low")[-1] == ("y", None, 7.0)
    assert w.pending.inputs == {"p": 2}
    w.rollback()
    assert not w.pending and values(w)[-1] == ("y", None, 5.0)


def test_one_hour_restates_the_series(spark):
    w = working(spark)
    w.set("p", 0.123, names="x", hour=1)
    assert values(w)[:3] == [("x", 0, 0.0), ("x", 1, 0.123), ("x", 2, 2.0)]
    assert {r.name for r in w.staged_layer().inputs["p"].collect()} == {"x"}
    w.set("p", 4.0, names="x")
    assert ("x", None, 4.0) in values(w)
    w.rollback()
    w.set("p", 4.0, names="x")
    assert [v for v in values(w) if v[0] == "x"] == [("x", None, 4.0)]


def test_series_mapping_frame_and_expression(spark):
    w = working(spark)
    w.set("p", [1.0, 2.0, 3.0], names=["y"])
    assert values(w)[3:] == [("y", 0, 1.0), ("y", 1, 2.0), ("y", 2, 3.0)]
    w.set("p", F.col("value") * 10)
    assert values(w)[-1] == ("y", 2, 30.0) and values(w)[1] == ("x", 1, 10.0)
    w.rollback()
    w.set("p", ingest(spark, [{"name": "y", "value": 6.0}], {"name": "VARCHAR", "value": "DOUBLE"}))
    assert values(w)[-1] == ("y", None, 6.0)
    w.set("p", F.col("value") + 1, names=["y"], scenario="low")
    assert values(w, "low")[-1] == ("y", None, 7.0) and values(w)[-1] == ("y", None, 6.0)


def test_refusals(spark):
    w = working(spark)
    with pytest.raises(RecordError):
        w.set("p", 1.0, names="x", vintage=3)
    with pytest.raises(KeyError):
        w.set("p", 1.0, names="nobody")
    with pytest.raises(KeyError):
        w.set("unknown", 1.0)
    with pytest.raises(KeyError):
        w.set("cost", F.col("value") * 2, names=["x"])
    with pytest.raises(RecordError):
        w.set("p", ingest(spark, [{"name": "x", "value": 1.0, "component_type": "Gen"}]))
    with pytest.raises(RecordError):
        w.set("cost", 1.0, names="x", hour=1)
    with pytest.raises(RecordError):
        w.remove("Gen", "x", hour=1)
    w.set("cost", F.col("value") * 2)
    assert not w.pending


def test_add_remove_connect_disconnect(spark):
    w = working(spark)
    w.add("Gen", [{"name": "n", "note": "new", "p": 3.0}])
    assert values(w)[0] == ("n", None, 3.0)
    assert [r.name for r in w.components["Gen"].select("name").distinct().orderBy("name").collect()] == ["n", "x", "y"]
    w.set("p", 9.0, names="n")
    w.remove("Gen", "n")
    assert "n" not in {v[0] for v in values(w)}
    w.add("Gen", [{"name": "n", "note": "again", "p": 4.0}])
    assert values(w)[0] == ("n", None, 4.0)
    with pytest.raises(RecordError):
        w.add("Link", [{"name": "x"}])
    w.connect("Gen", [{"name": "x", "bus": "b1", "role": "attached"}, {"name": "y", "bus": "b1", "role": "attached"}])
    w.disconnect("Gen", [("y", "b1")])
    assert {r.name for r in w.connections["Gen"].collect()} == {"x"}


def test_outputs_are_staged_freely_and_never_inherited(spark):
    w = working(spark)
    assert len(w.outputs) == 0
    w.set("res", ingest(spark, [{"name": "q", "value": 1.5}]), kind="outputs")
    assert list(w.outputs) == ["res"] and w.outputs["res"].first().value == 1.5


def test_store_commit_child_flatten_and_materialise(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert not store.schema
    root = store.create()
    b = base(spark)
    write_record(store, Source(SCHEMA, dims=b.dims, components=b.components, attributes=b.inputs, outputs=b.outputs), revision=root.id)
    assert list(root.record.outputs) == ["res"] and root.record.dims["scenario"].count() == 2
    w = WorkingRecord(root.record)
    w.set("p", 0.5, names="x", hour=2, scenario="high")
    w.remove("Gen", "y", scenario="low")
    before = got(w.attributes["p"], "name", "hour", "scenario", "value")
    child = w.commit(NewChild())
    assert not w.pending and child.ancestry() == [root.id, child.id]
    after = lambda: got(child.record.attributes["p"], "name", "hour", "scenario", "value")
    assert after() == before
    assert len(child.record.outputs) == 0
    root.materialise()
    assert store.materialised(root.id) and after() == before
    child.materialise()
    assert after() == before
    flat = WorkingRecord(child.record).commit(Directory(f"file://{tmp_path}/flat"))
    assert got(flat.attributes["p"], "name", "hour", "scenario", "value") == before
    assert "order_key" not in flat.components["Gen"].columns
    assert isinstance(flat, DirectoryRecord) and flat.flags("Gen")["p"].varies >= {"hour"}
    again = Store(spark, f"file://{tmp_path}/s")
    assert again.get(child.id).parent == root.id and again.schema == SCHEMA
    with pytest.raises(KeyError):
        again.get("nobody")


def test_new_labels_set_a_cache_aside(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    root = store.create()
    write_record(store, Source(SCHEMA, dims=scenarios(spark, "low"), attributes={"p": rows(spark, dict(name="x", value=1.0))}), revision=root.id)
    child = root.child()
    write_record(store, Source(SCHEMA, dims=scenarios(spark, "high")), revision=child.id)
    before = got(child.record.attributes["p"], "scenario", "value")
    root.materialise()
    assert got(child.record.attributes["p"], "scenario", "value") == before == [("high", 1.0), ("low", 1.0)]


def test_writes_are_all_or_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    root = store.create()
    good = {"p": rows(spark, dict(name="x", value=1.0))}
    with pytest.raises(RecordError):
        write_record(store, Source(SCHEMA, attributes=good | {"q": good["p"].drop("hour")}), revision=root.id)
    assert not store.files.exists(store.layer_uri(root.id)) and not store.schema
    two = {"Gen": spark.createDataFrame([("x", None)], "name string, scenario string"), "Link": spark.createDataFrame([("x", None)], "name string, scenario string")}
    with pytest.raises(RecordError):
        write_record(store, Source(SCHEMA, components=two), revision=root.id)
    with pytest.raises(RecordError):
        write_record(store, Source(SCHEMA, components={"Gen": spark.createDataFrame([("x",)], "name string")}), revision=root.id)
    with pytest.raises(RecordError):
        write_record(store, Source(SCHEMA, attributes={"p": rows(spark, dict(name="x", breakpoint=1.0, value=1.0))}), revision=root.id, strict=True)
    write_record(store, Source(SCHEMA, attributes=good), revision=root.id)
    with pytest.raises(FileExistsError):
        write_record(store, Source(SCHEMA, attributes=good), revision=root.id)
    with pytest.raises(SchemaError):
        write_record(store, Source(Schema({"hour": Dimension("BIGINT")}), attributes={}), revision=store.create(root).id)


def test_nothing_to_read_is_none_and_mixed_value_types_resolve(spark, tmp_path):
    assert try_read(spark, f"file://{tmp_path}/none/*.parquet") is None
    schema = Schema({"hour": Dimension("BIGINT")}, {"Gen": {"n": AttributeSpec("VARCHAR", dims={"hour"}), "p": AttributeSpec(dims={"hour"})}}, frozenset())
    text = spark.createDataFrame([("x", "red")], "name string, value string").withColumn("attribute", F.lit("n"))
    r = Resolver(spark, schema, [Layer("a", inputs={"n": text, "p": spark.createDataFrame([], LONG)})])
    assert r.attribute("n").first().value == "red" and r.attribute_names() == ("n",)
    assert r.attribute("absent").count() == 0

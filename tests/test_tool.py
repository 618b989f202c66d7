import pytest
from pyspark.sql import functions as F

from lamina.operators.record import LayeredRecord
from lamina.operators.reshape import drop_defaults, numbered_ports, port_attribute_rows, ports_pivot, ports_unpivot, series_pivot, static_assign
from lamina.operators.resolve import Resolver
from lamina.plans.tool import Attr, Given, NetworkTool, Requirements, ToolSchema, UnsupportedRecordError
from lamina.sources.layers import Layer
from tests.test_edit import base
from tests.test_records import SCHEMA, got, rows

REGISTRY = {"Gen": {"p": Given(varying=True, default=0.0), "cost": Given(), "out": Given(output=True, default=0.0, varying=True)}}


def record(spark, **more):
    return LayeredRecord(Resolver(spark, SCHEMA, [base(spark), Layer("b", **more)]))


def tool(**kw):
    return NetworkTool(REGISTRY, snapshot="hour", **kw)


def test_attr_rename_and_compute(spark):
    a = spark.createDataFrame([("x", 2.0)], "name string, value double")
    assert Attr(("other",)).resolve({"other": a}, "mine").first().attribute == "mine"
    twice = Attr(("a", "b"), lambda x, y: x.join(y.withColumnRenamed("value", "v"), "name").select("name", (F.col("value") * F.col("v")).alias("value")))
    assert twice.resolve({"a": a, "b": a}, "sq").first().value == 4.0
    assert twice.resolve({"a": a}, "sq") is None
    with pytest.raises(ValueError):
        Attr(("a", "b"))
    assert ToolSchema().sources("p") == ("p",)


def test_verify_names_what_is_in_the_way(spark):
    assert not tool().verify(record(spark))
    curve = {"cost": rows(spark, dict(name="x", breakpoint=0.0, value=1.0), attribute="cost")}
    why = tool().verify(record(spark, inputs=curve))
    assert why.curves == {("Gen", "cost")} and "curves" in why.describe()
    with pytest.raises(UnsupportedRecordError):
        tool().build(record(spark, inputs=curve))
    assert tool(honoured=frozenset()).verify(record(spark)).unsupported_keys == {("member_key", "scenario"), ("link_key", "scenario")}
    odd = {"Odd": spark.createDataFrame([("o", None, 0)], "name string, scenario string, _row bigint")}
    assert tool().verify(record(spark, components=odd)).unknown_types == {"Odd"}
    needs = NetworkTool({"Gen": {"cap": Given(required=True)}}, snapshot="hour")
    assert needs.verify(record(spark)).missing_attributes == {("Gen", "cap")}
    assert not Requirements()


def test_build_and_results(spark):
    net = tool().build(record(spark))
    static = got(net.static["Gen"], "name", "scenario", "p")
    assert ("y", "high", 5.0) in static and ("x", "low", None) in static
    wide = net.series["Gen"]["p"]
    assert net.stochastic and not net.multiperiod and [r.hour for r in wide.collect()] == [0, 1, 2]
    net.outputs["Gen"] = {"out": spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 3.0)], "hour bigint, x double, y double")}
    assert got(tool().results(net)["out"], "name", "hour", "value") == [("x", 0, 1.0), ("x", 1, 2.0), ("y", 1, 3.0)]


def test_ports_there_and_back(spark):
    kind = "name string, bus string, role string, order_key bigint"
    c = spark.createDataFrame([("l", "b1", "output", 0), ("l", "b0", "input", 1), ("g", "b2", "attached", 2)], kind)
    assert got(numbered_ports(c), "name", "port", "bus") == [("g", 0, "b2"), ("l", 0, "b0"), ("l", 1, "b1")]
    wide = ports_pivot(c)
    assert got(wide, "name", "bus", "bus0", "bus1") == [("g", "b2", None, None), ("l", None, "b0", "b1")]
    assert got(ports_unpivot(wide, {"bus0": "input", "bus1": "output"}), "name", "bus", "role") == [("l", "b0", "input"), ("l", "b1", "output")]
    m = spark.createDataFrame([("l", "b1", "b2", 0.9, 0.5)], "name string, bus1 string, bus2 string, efficiency double, efficiency2 double")
    assert got(port_attribute_rows(m, "efficiency", {1: "bus1", 2: "bus2"}), "bus", "value") == [("b1", 0.9), ("b2", 0.5)]


def test_static_series_and_defaults(spark):
    m = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, p double")
    assert got(static_assign(m, {"p": rows(spark, dict(name="x", value=7.0), dict(name="y", hour=1, value=8.0))}, "hour"), "name", "p") == [("x", 7.0), ("y", 2.0)]
    wide = series_pivot(rows(spark, dict(name="a.b", hour=0, value=1.0), dict(name="c", hour=1, value=2.0)), ["hour"])
    assert set(wide.columns) == {"hour", "a.b", "c"}
    v = spark.createDataFrame([(0.0,), (1.0,), (None,)], "value double")
    assert drop_defaults(v, 0.0).count() == 2 and drop_defaults(v, None).count() == 2


LINKS = {"Line": {"eff": Given(varying=True, connection=True), "p": Given(varying=True, default=0.0), "flow": Given(output=True, varying=True, default=0.0)}}


def network(spark):
    """Two lines of two and three ports in two scenarios and periods; efficiencies by port, one a series."""
    from lamina.schema import AttributeSpec, Dimension, Schema

    every = frozenset({"hour", "period", "scenario"})
    dims = {"hour": Dimension("BIGINT"), "period": Dimension("BIGINT"), "scenario": Dimension("VARCHAR", keys=frozenset({"component", "connection"}))}
    schema = Schema(dims, {"Line": {"eff": AttributeSpec("DOUBLE", None, every, bus="connection"), "p": AttributeSpec("DOUBLE", 0.0, every)}}, frozenset({"scenario", "period"}))
    axes = {
        "hour": spark.createDataFrame([(7, 0), (3, 1)], "hour bigint, _row bigint"),
        "period": spark.createDataFrame([(2030, 0), (2020, 1)], "period bigint, _row bigint"),
        "scenario": spark.createDataFrame([("low", 0), ("high", 1)], "scenario string, _row bigint"),
    }
    members = {"Line": spark.createDataFrame([("a", None, 0), ("b", None, 1)], "name string, scenario string, _row bigint")}
    ends = [("a", "x", "output", None), ("a", "y", "input", None), ("b", "y", "output", None), ("b", "z", "output", "low"), ("b", "w", "input", None)]
    links = {"Line": spark.createDataFrame([(*e, k) for k, e in enumerate(ends)], "name string, bus string, role string, scenario string, _row bigint")}
    kind = "name string, bus string, hour bigint, period bigint, scenario string, breakpoint double, value double"
    eff = [("a", "x", None, None, None, None, 0.9), ("a", "y", None, None, None, None, 0.4), ("b", "y", 7, None, "high", None, 0.1), ("b", "y", 3, None, "high", None, 0.2), ("b", "w", None, None, None, None, 0.7)]
    p = [("a", None, 3, 2020, "low", None, 5.0), ("a", None, 7, 2030, None, None, 6.0), ("b", None, None, None, None, None, 1.5)]
    inputs = {a: spark.createDataFrame(x, kind).withColumn("attribute", F.lit(a)) for a, x in (("eff", eff), ("p", p))}
    return LayeredRecord(Resolver(spark, schema, [Layer("a", axes, members, links, inputs)]))


def test_ports_are_numbered_within_a_scenario_and_keep_their_values(spark):
    net = NetworkTool(LINKS, snapshot="hour").build(network(spark))
    assert net.stochastic and net.multiperiod
    static = got(net.static["Line"], "name", "scenario", "bus0", "bus1", "bus2", "eff0", "eff")
    assert static == [("a", "high", "y", "x", None, 0.4, 0.9), ("a", "low", "y", "x", None, 0.4, 0.9), ("b", "high", "w", "y", None, 0.7, None), ("b", "low", "w", "y", "z", 0.7, None)]
    assert got(net.static["Line"], "name", "scenario", "p") == [("a", "high", None), ("a", "low", None), ("b", "high", 1.5), ("b", "low", 1.5)]
    assert set(net.series["Line"]) == {"eff", "p"}
    p = net.series["Line"]["p"]
    assert [(r.period, r.hour) for r in p.collect()] == [(2030, 7), (2030, 3), (2020, 7), (2020, 3)]
    assert set(p.columns) == {"period", "hour", "a\x01low", "a\x01high"}
    assert [r["a\x01low"] for r in p.collect()] == [6.0, None, None, 5.0] and [r["a\x01high"] for r in p.collect()] == [6.0, None, None, None]
    assert [r["b\x01high"] for r in net.series["Line"]["eff"].collect()] == [0.1, 0.2, 0.1, 0.2]


def test_a_network_comes_back_as_the_record_it_was(spark, tmp_path):
    from lamina.operators.record import DirectoryRecord
    from lamina.operators.write import write_record
    from lamina.sources.store import Store
    from tests.test_edit import Source

    tool_ = NetworkTool(LINKS, snapshot="hour")
    before = network(spark)
    net = tool_.build(before)
    net.outputs["Line"] = {"flow": net.series["Line"]["p"]}
    assert got(tool_.results(net)["flow"], "name", "scenario", "period", "hour", "value") == [("a", "high", 2030, 7, 6.0), ("a", "low", 2020, 3, 5.0), ("a", "low", 2030, 7, 6.0)]
    net.connections.clear()
    schema, layer = tool_.to_record(net)
    store = Store(spark, f"file://{tmp_path}/s")
    write_record(store, Source(schema, dims=layer.dims, components=layer.components, connections=layer.connections, attributes=layer.inputs), uri=f"file://{tmp_path}/d")
    after = LayeredRecord(Resolver(spark, schema, [DirectoryRecord(spark, f"file://{tmp_path}/d").layer]))
    cols = ("name", "bus", "scenario", "hour", "value")
    assert got(after.attributes["p"].filter("hour IS NOT NULL"), *cols, "period") == [("a", None, "high", 7, 6.0, 2030), ("a", None, "low", 3, 5.0, 2020), ("a", None, "low", 7, 6.0, 2030)]
    assert got(after.attributes["p"].filter("hour IS NULL"), *cols) == [("b", None, s, None, 1.5) for s in ("high", "low")]
    assert got(after.attributes["eff"].filter("hour IS NULL"), *cols) == [("a", b, s, None, v) for b, s, v in sorted([("x", "high", 0.9), ("x", "low", 0.9), ("y", "high", 0.4), ("y", "low", 0.4)])] + [("b", "w", s, None, 0.7) for s in ("high", "low")]
    assert got(after.attributes["eff"].filter("hour IS NOT NULL"), *cols, "period") == sorted([("b", "y", "high", h, v, y) for h, v in ((3, 0.2), (7, 0.1)) for y in (2020, 2030)], key=repr)
    assert got(after.connections["Line"], "name", "bus", "role", "scenario") == got(before.connections["Line"], "name", "bus", "role", "scenario")
    assert [d for d in after.dims] == ["hour", "period", "scenario"]

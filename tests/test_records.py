"""Resolution of small stacks, hand-made and random."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions.frames import anti, latest_per, semi, union_by_name
from lamina.operators.axes import expand
from lamina.operators.record import LayeredRecord
from lamina.operators.resolve import Resolver
from lamina.schema import AttributeSpec, Dimension, Schema
from lamina.sources.layers import Layer

SCHEMA = Schema(
    {"hour": Dimension("BIGINT"), "scenario": Dimension(keys={"component", "connection"})},
    {"Gen": {"p": AttributeSpec(dims={"hour", "scenario"}), "cost": AttributeSpec(dims={"scenario"}, breakpoints=True), "eff": AttributeSpec(dims={"scenario"}, bus="connection")}},
    frozenset({"scenario"}),
)
LONG = "name string, bus string, hour bigint, scenario string, attribute string, breakpoint double, value double"


def rows(spark, *items, attribute="p"):
    full = [(i.get("name"), i.get("bus"), i.get("hour"), i.get("scenario"), attribute, i.get("breakpoint"), i.get("value")) for i in items]
    return spark.createDataFrame(full, LONG)


def scenarios(spark, *labels):
    return {"scenario": spark.createDataFrame([(s, n) for n, s in enumerate(labels)], "scenario string, _row bigint")}


def members(spark, *items, kind="name string, scenario string, deleted boolean, _row bigint"):
    return {"Gen": spark.createDataFrame(list(items), kind)}


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_a_constant_replaces_a_series_and_its_sibling_stays(spark):
    base = Layer("a", members(spark) and {}, inputs={"p": rows(spark, *[dict(name=n, hour=h, value=float(h)) for n in ("x", "y") for h in range(3)])})
    child = Layer("b", inputs={"p": rows(spark, dict(name="x", value=0.5))})
    out = Resolver(spark, SCHEMA, [base, child]).attribute("p")
    assert got(out, "name", "hour", "value") == sorted([("x", None, 0.5), ("y", 0, 0.0), ("y", 1, 1.0), ("y", 2, 2.0)], key=repr)


def test_scenario_override_and_missing_axis(spark):
    base = Layer("a", scenarios(spark, "low", "high"), inputs={"p": rows(spark, dict(name="x", value=1.0))})
    child = Layer("b", inputs={"p": rows(spark, dict(name="x", scenario="high", value=2.0))})
    assert got(Resolver(spark, SCHEMA, [base, child]).attribute("p"), "scenario", "value") == [("high", 2.0), ("low", 1.0)]
    bare = Layer("a", inputs={"p": rows(spark, dict(name="x", value=1.0))})
    assert got(Resolver(spark, SCHEMA, [bare]).attribute("p"), "scenario", "value") == [(None, 1.0)]


def test_curves_are_owned_whole(spark):
    base = Layer("a", inputs={"cost": rows(spark, *[dict(name="x", breakpoint=b, value=v) for b, v in ((0.0, 20.0), (50.0, 35.0), (80.0, 60.0))], attribute="cost")})
    child = Layer("b", inputs={"cost": rows(spark, dict(name="x", breakpoint=0.0, value=25.0), dict(name="x", breakpoint=90.0, value=70.0), attribute="cost")})
    r = Resolver(spark, SCHEMA, [base, child])
    assert got(r.attribute("cost"), "breakpoint", "value") == [(0.0, 25.0), (90.0, 70.0)]


def test_bus_is_part_of_the_key_and_never_expanded(spark):
    base = Layer("a", inputs={"eff": rows(spark, dict(name="d", bus="h2", value=2.1), dict(name="d", bus="ore", value=1.6), dict(name="d", value=9.0), attribute="eff")})
    child = Layer("b", inputs={"eff": rows(spark, dict(name="d", bus="h2", value=9.9), attribute="eff")})
    assert got(Resolver(spark, SCHEMA, [base, child]).attribute("eff"), "bus", "value") == sorted([("h2", 9.9), ("ore", 1.6), (None, 9.0)], key=repr)


def test_tombstones_scoped_and_readded(spark):
    base = Layer("a", scenarios(spark, "low", "high"), components=members(spark, ("x", None, False, 0), ("y", None, False, 1), ("z", None, False, 2)), inputs={"p": rows(spark, *[dict(name=n, value=1.0) for n in "xyz"])})
    kill = Layer("b", components=members(spark, ("x", None, True, 0), ("y", "low", True, 1), ("z", None, True, 2)))
    back = Layer("c", components=members(spark, ("z", None, False, 0)), inputs={"p": rows(spark, dict(name="z", value=3.0))})
    r = Resolver(spark, SCHEMA, [base, kill, back])
    assert got(r.attribute("p"), "name", "scenario", "value") == [("y", "high", 1.0), ("z", "high", 3.0), ("z", "low", 3.0)]
    assert got(r.entities("components", "Gen"), "name", "scenario") == [("y", "high"), ("z", "high"), ("z", "low")]
    own = Resolver(spark, SCHEMA, [Layer("a", components=members(spark, ("x", None, True, 0)), inputs={"p": rows(spark, dict(name="x", value=5.0))})])
    assert got(own.attribute("p"), "value") == [(5.0,)]


def test_a_component_tombstone_kills_connections_a_connection_tombstone_one_pair(spark):
    kind = "name string, bus string, role string, deleted boolean, _row bigint"
    link = {"Gen": spark.createDataFrame([("d", "h2", "input", False, 0), ("d", "ore", "input", False, 1), ("e", "h2", "input", False, 2)], kind)}
    base = Layer("a", components=members(spark, ("d", None, False, 0), ("e", None, False, 1)), connections=link, inputs={"eff": rows(spark, dict(name="d", bus="ore", value=1.0), dict(name="d", bus="h2", value=2.0), attribute="eff")})
    cut = Layer("b", connections={"Gen": spark.createDataFrame([("d", "ore", None, True, 0)], kind)})
    gone = Layer("c", components=members(spark, ("e", None, True, 0)))
    r = Resolver(spark, SCHEMA, [base, cut, gone])
    assert got(r.entities("connections", "Gen"), "name", "bus") == [("d", "h2")]
    assert got(r.attribute("eff"), "bus", "value") == [("h2", 2.0)]


def test_flags_say_what_is_stored_for_winners_of_a_type(spark):
    gens = members(spark, ("x", None, False, 0), ("g", None, False, 1))
    links = {"Link": spark.createDataFrame([("l", None, False, 0)], "name string, scenario string, deleted boolean, _row bigint")}
    base = Layer("a", components=gens | links, inputs={"p": rows(spark, dict(name="x", hour=0, value=1.0), dict(name="x", hour=1, value=1.0), dict(name="l", value=1.0))})
    rec = LayeredRecord(Resolver(spark, SCHEMA, [base]))
    f, g = rec.flags("Gen")["p"], rec.flags("Link")["p"]
    assert (f.varies, f.broadcast, f.breakpoints) == ({"hour"}, {"scenario"}, False)
    assert (g.varies, g.broadcast) == (frozenset(), {"hour", "scenario"})
    child = Layer("b", inputs={"p": rows(spark, dict(name="g", value=2.0))})
    both = LayeredRecord(Resolver(spark, SCHEMA, [base, child])).flags("Gen")["p"]
    assert "hour" in both.varies and "hour" in both.broadcast


def test_axis_rows_are_replaced_in_place(spark):
    kind = "scenario string, weight double, _row bigint"
    a = spark.createDataFrame([("s2", 1.0, 0), ("s1", 1.0, 1)], kind)
    b = spark.createDataFrame([("s0", 1.0, 0), ("s1", 7.0, 1)], kind)
    r = Resolver(spark, SCHEMA, [Layer("a", {"scenario": a}), Layer("b", {"scenario": b})])
    assert [tuple(x) for x in r.axis("scenario").select("scenario", "weight").collect()] == [("s2", 1.0), ("s1", 7.0), ("s0", 1.0)]


def test_expanding_over_an_empty_axis_keeps_the_row(spark):
    df = rows(spark, dict(name="x", value=1.0))
    none = spark.createDataFrame([], "scenario string, _row bigint")
    assert expand(df, ["scenario"], {"scenario": none}).count() == 1


def test_frame_helpers(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    b = spark.createDataFrame([(None,)], "k int")
    assert got(semi(a, b, ["k"]), "v") == [("b",)] and got(anti(a, b, ["k"]), "v") == [("a",)]
    assert anti(a, b, [], ["k"]).count() == 0
    u = union_by_name([a, spark.createDataFrame([(2,)], "k int")])
    assert got(u, "k", "v") == sorted([(1, "a"), (None, "b"), (2, None)], key=repr)
    last = latest_per(spark.createDataFrame([(None, 1, "x"), (None, 2, None)], "k int, s int, v string"), ["k"], ["s"])
    assert got(last, "k", "s", "v") == [(None, 2, None)]


def sequential(stack, labels):
    """The rule one layer at a time: {(name, scenario, attribute) -> (layer, value)}."""
    own: dict = {}
    for n, (values, dead) in enumerate(stack):
        for name, scope in dead:
            for s in [scope] if scope else labels:
                for k in [k for k in own if k[0] == name and k[1] == s]:
                    del own[k]
        mine = {}
        for name, scope, v in values:
            for s in [scope] if scope else labels:
                mine[name, s] = (n, v)
        own |= mine
    return own


@pytest.mark.parametrize("seed", range(3))
def test_random_stacks_match_the_sequential_rule_with_and_without_a_cache(spark, seed):
    rng, labels = random.Random(seed), ["a", "b"]
    stack = []
    for _ in range(5):
        names = rng.sample("uvwxyz", rng.randint(1, 4))
        values = [(n, s, float(rng.randint(0, 99))) for n in names for s in ([None] if rng.random() < 0.6 else [rng.choice(labels)])]
        dead = [(n, rng.choice([None, *labels])) for n in rng.sample("uvwxyz", rng.randint(0, 2))]
        stack.append((values, dead))
    layers = []
    for n, (values, dead) in enumerate(stack):
        comp = members(spark, *[(d, s, True, k) for k, (d, s) in enumerate(dead)]) if dead else {}
        layers.append(Layer(str(n), scenarios(spark, *labels) if n == 0 else {}, components=comp, inputs={"p": rows(spark, *[dict(name=a, scenario=s, value=v) for a, s, v in values])}))
    want = sorted([(k[0], k[1], v) for k, (_, v) in sequential(stack, labels).items()])
    assert got(Resolver(spark, SCHEMA, layers).attribute("p"), "name", "scenario", "value") == want
    cached = Resolver(spark, SCHEMA, layers[:3]).maps()
    assert got(Resolver(spark, SCHEMA, layers, cached).attribute("p"), "name", "scenario", "value") == want


def test_keys_need_partial(spark):
    with pytest.raises(ValueError):
        Resolver(spark, Schema({"s": Dimension(keys={"component"})}), [])


def test_the_scan_reads_only_key_columns_for_the_map(spark, tmp_path):
    path = f"file://{tmp_path}/p.parquet"
    rows(spark, dict(name="x", value=1.0)).write.parquet(path)
    plan = Resolver(spark, SCHEMA, [Layer("a", inputs={"p": spark.read.parquet(path)})]).inputs_map()._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_default_fill(spark):
    from lamina.operators.record import default_fill

    schema = Schema(SCHEMA.dimensions, {"Gen": {"p": AttributeSpec(default=9.0, dims={"hour"})}}, SCHEMA.partial)
    hours = spark.createDataFrame([(0,), (1,)], "hour bigint")
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    v = rows(spark, dict(name="x", hour=0, value=1.0), dict(name="y", value=2.0))
    out = default_fill(v, names, {"hour": hours}, schema, "p")
    assert got(out, "name", "hour", "value") == [("x", 0, 1.0), ("x", 1, 9.0), ("y", 0, 2.0), ("y", 1, 2.0), ("z", 0, 9.0), ("z", 1, 9.0)]
    assert out.filter(F.col("value").isNull()).count() == 0

"""Queries over layers written to a store as parquet, over plain directories, and through a tool."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.frames import q, union_by_name, with_missing
from lamina.operators.edit import NewChild, WorkingRecord
from lamina.operators.record import DirectoryRecord, LayeredRecord
from lamina.operators.reshape import scalar_rows, series_pivot
from lamina.operators.resolve import Resolver
from lamina.operators.write import write_record
from lamina.plans.data import SCHEMA, SQL, Tables, layers, link_ends, long, months, name, pairs, resolved_sql, scenarios
from lamina.plans.queries import _OWNED, _PLAIN, _ROWS, _STAGED, DEMAND, KINDS, daily, query, shared_root, _flags_sql
from lamina.plans.tool import Given, NetworkTool
from lamina.schema import AttributeSpec, Dimension, Schema
from lamina.sources.layers import Layer
from lamina.sources.store import Store, try_read

_STORES: dict[tuple[str, str], tuple[Store, list[str]]] = {}


@dataclass(frozen=True)
class Parts:
    """A record to be written, part by part."""

    schema: Schema
    dims: dict = field(default_factory=dict)
    components: dict = field(default_factory=dict)
    connections: dict = field(default_factory=dict)
    attributes: dict = field(default_factory=dict)
    outputs: dict = field(default_factory=dict)


def written(spark: SparkSession, sf: str) -> tuple[Store, list[str]]:
    """A store with the layers of ``plans.data``, a revision each, and their ids; one a session and ``sf``."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORES:
        store, ids = Store(spark, shared_root(spark)), []
        for x in layers(spark, sf):
            ids.append(store.create(ids[-1] if ids else None).id)
            keyed = [{t: with_missing(f, {"scenario": "VARCHAR"}) for t, f in getattr(x, k).items()} for k in ("components", "connections")]
            write_record(store, Parts(SCHEMA, x.dims, *keyed, x.inputs, x.outputs), revision=ids[-1])
        _STORES[at] = store, ids
    return _STORES[at]


def _record(spark, sf, upto: int) -> LayeredRecord:
    store, ids = written(spark, sf)
    return store.get(ids[upto]).record


@query(f"{resolved_sql(3)} {_ROWS}")
def store_overlay(spark, sf):
    return _record(spark, sf, 3).attributes["demand"].select(*DEMAND)


@query(f"{resolved_sql(3)} {_OWNED}")
def store_owner_map(spark, sf):
    r = _record(spark, sf, 3)
    sums = r.attributes["demand"].groupBy("name", "scenario").agg(F.count("*").alias("row_count"), F.sum("value").alias("total"))
    return sums.join(r.resolver.inputs_map(["demand"]).select("name", "scenario", "depth"), ["name", "scenario"])


@query(f"""WITH {SQL},
m AS (SELECT 0 AS depth, 'C' || c_custkey AS name, c_mktsegment AS segment, c_acctbal AS acctbal, scenario, c_custkey AS pos FROM customer, scen
  UNION ALL SELECT 3, 'C' || c_custkey, c_mktsegment, c_acctbal, scenario, c_custkey FROM customer, scen WHERE c_custkey % 194 = 0
  UNION ALL SELECT 3, 'C-new', 'NEW', 0.0, scenario, 2147483648 FROM scen),
w AS (SELECT *, row_number() OVER (PARTITION BY name, scenario ORDER BY depth DESC) AS rn FROM m),
live AS (SELECT w.* FROM w LEFT JOIN dead_rows d ON d.name = w.name AND d.scenario = w.scenario WHERE rn = 1 AND (d.depth IS NULL OR w.depth >= d.depth))
SELECT name, scenario, segment, acctbal, row_number() OVER (PARTITION BY scenario ORDER BY depth, pos) AS nth FROM live""")
def store_members(spark, sf):
    """Members as read from files, in the order in which they were written."""
    rows = _record(spark, sf, 3).components["Customer"]
    return rows.select("name", "scenario", "segment", "acctbal", F.row_number().over(Window.partitionBy("scenario").orderBy("order_key")).cast("bigint").alias("nth"))


@query(f"""WITH {SQL} SELECT name, bus, role, scenario, row_number() OVER (PARTITION BY name, scenario ORDER BY ends.pos) AS nth FROM ends, scen WHERE NOT (name = 'L0_1' AND role = 'output')""")
def store_connections(spark, sf):
    rows = _record(spark, sf, 4).connections["Link"]
    return rows.select("name", "bus", "role", "scenario", F.row_number().over(Window.partitionBy("name", "scenario").orderBy("order_key")).cast("bigint").alias("nth"))


@query(f"{resolved_sql(3)} SELECT 'before' AS at, name, scenario, snapshot, value FROM resolved UNION ALL SELECT 'after', name, scenario, snapshot, value FROM resolved")
def store_materialised(spark, sf):
    """The same record before and after the maps of an ancestor were written."""
    store, ids = written(spark, sf)
    before = store.get(ids[3]).record.attributes["demand"].select(F.lit("before").alias("at"), *DEMAND)
    store.materialise(ids[2])
    after = store.get(ids[3]).record
    if after.resolver.base is None:
        raise RuntimeError("written maps are not used")
    return before.unionByName(after.attributes["demand"].select(F.lit("after").alias("at"), *DEMAND))


def _edits(w: WorkingRecord, spark, sf) -> None:
    ids = lambda c: Tables(spark, sf).customer.filter(c).select(name("C", "c_custkey").alias("name"))
    w.set("demand", ids("c_custkey % 6 = 1").withColumn("value", F.lit(10).cast("bigint")))
    w.set("demand", ids("c_custkey % 12 = 1").withColumn("value", F.lit(20).cast("bigint")))
    w.remove("Customer", ["C13", "C25"])


_COMMITTED = f"""WITH {SQL}, st AS ({_STAGED})
SELECT name, scenario, CAST(NULL AS TIMESTAMP) AS snapshot, value FROM st, scen WHERE name NOT IN ('C13', 'C25')
UNION ALL SELECT name, scenario, snapshot, value FROM demand_rows WHERE depth = 0 AND name NOT IN (SELECT name FROM st) AND name NOT IN ('C13', 'C25')"""


@query(_COMMITTED)
def commit_new_child(spark, sf):
    """Edits committed as a child revision, read back from its files through its ancestry."""
    store, ids = written(spark, sf)
    w = WorkingRecord(store.get(ids[0]).record)
    _edits(w, spark, sf)
    child = w.commit(NewChild())
    if w.pending or child.ancestry() != [ids[0], child.id]:
        raise RuntimeError("not committed")
    return child.record.attributes["demand"].select(*DEMAND)


@query(f"WITH {SQL} SELECT name, scenario, snapshot, value FROM demand_rows WHERE depth = 0")
def edits_rolled_back(spark, sf):
    w = WorkingRecord(_record(spark, sf, 0))
    _edits(w, spark, sf)
    w.rollback()
    return w.attributes["demand"].select(*DEMAND)


@query(f"WITH {SQL}, st AS ({_STAGED}) " + _flags_sql("SELECT 'demand' AS attribute, snapshot, CAST(NULL AS VARCHAR) AS scenario, CAST(NULL AS DOUBLE) AS breakpoint FROM series WHERE 'C' || custkey NOT IN (SELECT name FROM st) UNION ALL SELECT 'demand', NULL, NULL, NULL FROM flat UNION ALL SELECT 'demand', NULL, 'high', NULL FROM st"))
def flags_with_pending(spark, sf):
    """Flags of a record whose edits are not yet committed: those of one scenario make the axis vary."""
    w = WorkingRecord(_record(spark, sf, 0))
    rows = Tables(spark, sf).customer.filter("c_custkey % 6 = 1").select(name("C", "c_custkey").alias("name"), F.when(F.col("c_custkey") % 12 == 1, 20).otherwise(10).cast("bigint").alias("value"))
    w.set("demand", rows, scenario="high")
    found = [(a, d, d in f.varies, d in f.broadcast, f.breakpoints) for a, f in w.flags("Customer").items() for d in SCHEMA.dimensions]
    return spark.createDataFrame(found, "attribute string, dim string, varies boolean, broadcast boolean, breakpoints boolean")


@query("SELECT 'C' || o_custkey AS name, CAST(count(*) AS BIGINT) AS value FROM orders GROUP BY ALL")
def staged_outputs(spark, sf):
    w = WorkingRecord(_record(spark, sf, 0))
    w.set("spend", Tables(spark, sf).orders.groupBy(name("C", "o_custkey").alias("name")).agg(F.count("*").alias("value")), kind="outputs")
    return w.outputs["spend"].select("name", q("value").cast("bigint").alias("value"))


@query("""WITH m AS (SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS nth FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS snapshot FROM orders)), s(scenario) AS (VALUES ('base'), ('high'), ('low'))
SELECT 'C1' AS name, scenario, snapshot, CAST(nth AS BIGINT) AS value FROM m, s UNION ALL SELECT 'C2', scenario, CAST(NULL AS TIMESTAMP), CAST(5 AS BIGINT) FROM s UNION ALL SELECT 'C3', scenario, NULL, CAST(6 AS BIGINT) FROM s""")
def values_normalised(spark, sf):
    """A value a label of the axis, in its order, and a mapping of names."""
    w = WorkingRecord(_record(spark, sf, 0))
    n = w.dims["snapshot"].count()  # labels of an axis
    w.set("demand", list(range(1, n + 1)), names="C1")
    w.set("demand", {"C2": 5, "C3": 6}, names=["C2", "C3"])
    staged = spark.createDataFrame([("C1",), ("C2",), ("C3",)], "name string")
    return w.attributes["demand"].join(staged, "name", "left_semi").select(*DEMAND)


@query(f"""WITH {SQL}, hit AS (SELECT custkey, min(snapshot) AS snapshot FROM series GROUP BY ALL)
SELECT 'C' || h.custkey AS name, scenario, h.snapshot, CAST(2 AS BIGINT) AS value FROM hit h, scen
UNION ALL SELECT 'C' || s.custkey, scenario, s.snapshot, s.cents FROM series s JOIN hit h ON s.custkey = h.custkey AND s.snapshot <> h.snapshot, scen
UNION ALL SELECT 'C' || custkey, scenario, NULL, cents FROM flat, scen""")
def repeated_coordinates(spark, sf):
    """Every coordinate twice in one call: the later row stands."""
    w = WorkingRecord(_record(spark, sf, 0))
    one = Tables(spark, sf).orders.filter("o_custkey % 5 != 0").groupBy("o_custkey").agg(F.min(F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")).alias("snapshot"))
    one = one.select(name("C", "o_custkey").alias("name"), "snapshot", F.explode(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))).alias("value"))
    w.set("demand", one)
    return w.attributes["demand"].select(*DEMAND)


@query(f"WITH {SQL} SELECT name, bus, scenario, row_number() OVER (PARTITION BY name, scenario ORDER BY ends.pos DESC) AS nth FROM ends, scen")
def members_in_order_of_their_call(spark, sf):
    """All links connected anew in one call, in turned order: they keep the order of the call."""
    t = Tables(spark, sf)
    ends = link_ends(pairs(t)).orderBy(F.desc("_row")).select("name", "bus", "role")
    l0 = layers(spark, sf)[0]
    bare = Layer("bare", l0.dims, {"Link": l0.components["Link"]})
    w = WorkingRecord(LayeredRecord(Resolver(spark, SCHEMA, [bare])))
    w.connect("Link", ends)
    rows = w.connections["Link"]
    return rows.select("name", "bus", "scenario", F.row_number().over(Window.partitionBy("name", "scenario").orderBy("order_key")).cast("bigint").alias("nth"))


@query("SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS nth FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS snapshot FROM orders)")
def directory_axis(spark, sf):
    axis = _directory(spark, sf).dims["snapshot"].select("snapshot", F.monotonically_increasing_id().alias("at"))
    return axis.select("snapshot", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("nth"))  # an axis


@query(f"WITH {SQL} SELECT 'C' || custkey AS name, snapshot, cents AS value FROM series UNION ALL SELECT 'C' || custkey, NULL, cents FROM flat")
def directory_attribute(spark, sf):
    return _directory(spark, sf).attributes["demand"].select("name", "snapshot", "value")


@query(f"WITH {SQL} {_flags_sql(_PLAIN)}")
def directory_flags(spark, sf):
    """Flags of every type of a directory, put together."""
    d = _directory(spark, sf)
    found = {(a, x, x in f.varies, x in f.broadcast, f.breakpoints) for t in ("Customer", "Part", "Link") for a, f in d.flags(t).items() for x in SCHEMA.dimensions}
    return spark.createDataFrame(sorted(found), "attribute string, dim string, varies boolean, broadcast boolean, breakpoints boolean")


def _directory(spark, sf) -> DirectoryRecord:
    store, ids = written(spark, sf)
    return DirectoryRecord(spark, store.layer_uri(ids[0]), SCHEMA)


_REFUSED = {
    "a label that does not parse": "raised", "a layer that is there": "FileExistsError", "an axis without its parent": "RecordError", "a schema that breaks records": "SchemaError",
    "connections without a bus": "RecordError", "nothing is left": "nothing", "one name of two types": "RecordError", "values without columns": "RecordError", "an absent file": "nothing",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _REFUSED.items()) + ") x(what, answer)")
def refusals(spark, sf):
    """What a write must not let through, each tried on the tables' own rows."""
    store, ids = written(spark, sf)
    t, out = Tables(spark, sf), {}
    members = t.customer.select(name("C", "c_custkey").alias("name"), F.lit(None).cast("string").alias("scenario"))
    nested = Schema({**SCHEMA.dimensions, "period": Dimension("BIGINT"), "hour": Dimension("BIGINT", within="period")}, SCHEMA.attributes, SCHEMA.partial)
    tries = {
        "a layer that is there": (ids[0], Parts(SCHEMA)), "an axis without its parent": (None, Parts(nested, {"hour": t.nation.select(F.col("n_nationkey").cast("bigint").alias("hour"))})),
        "a schema that breaks records": (None, Parts(Schema({"snapshot": Dimension("TIMESTAMP")}, {}, frozenset()))), "connections without a bus": (None, Parts(SCHEMA, connections={"Customer": members})),
        "one name of two types": (None, Parts(SCHEMA, components={"Customer": members, "Part": members})), "values without columns": (None, Parts(SCHEMA, attributes={"demand": members})),
    }
    left = "nothing"
    for what, (revision, parts) in tries.items():
        id_ = revision or store.create(ids[0]).id
        try:
            write_record(store, parts, revision=id_)
            out[what] = "written"
        except (ValueError, FileExistsError) as e:
            out[what] = type(e).__name__
        if revision is None and (store.files.exists(store.layer_uri(id_)) or store.files.names(f"{store.root}/layers/.staging")):
            left = what
    out["nothing is left"] = left
    w = WorkingRecord(store.get(ids[0]).record)
    w.set("demand", members.limit(1).select("name", F.lit("not-a-date").alias("snapshot"), F.lit(9).cast("bigint").alias("value")))
    try:
        w.attributes["demand"].count()
        out["a label that does not parse"] = "taken"
    except Exception as e:  # noqa: BLE001 - Spark wraps what the executors raise
        out["a label that does not parse"] = "raised" if "snapshot is no" in str(e) else str(e)
    out["an absent file"] = "nothing" if try_read(spark, f"{store.root}/layers/none/inputs/x.parquet") is None else "something"
    return spark.createDataFrame(sorted(out.items()), "what string, answer string")


@query("SELECT 'C' || c_custkey AS name, 'acctbal' AS attribute, c_acctbal AS value FROM customer")
def members_to_scalar_rows(spark, sf):
    return scalar_rows(layers(spark, sf)[0].components["Customer"], "acctbal", "snapshot").filter("snapshot IS NULL").select("name", "attribute", "value")


_DAYS = "WITH d AS (SELECT date_trunc('month', o_orderdate) AS snapshot FROM orders GROUP BY ALL UNION SELECT date_trunc('day', ts) FROM events), v AS (SELECT date_trunc('day', ts) AS snapshot, event_type AS name, count(*) AS value FROM events GROUP BY ALL)"


@query(f"{_DAYS} SELECT snapshot, " + ", ".join(f"(SELECT CAST(value AS BIGINT) FROM v WHERE v.snapshot = d.snapshot AND v.name = '{k}') AS {k}" for k in KINDS) + " FROM d")
def series_on_axis(spark, sf):
    """A wide frame over a longer axis: labels without rows come back empty."""
    axis = union_by_name([months(Tables(spark, sf)).select("snapshot"), daily(spark, sf).select("snapshot")]).distinct().withColumn("_pos", F.unix_micros(F.col("snapshot").cast("timestamp")))
    return series_pivot(daily(spark, sf), ["snapshot"], KINDS, axis=axis)


def _activity(spark, sf) -> LayeredRecord:
    """Event types as members: daily hits, doubled in one scenario for some, and a weight as one number."""
    every = frozenset({"snapshot", "scenario"})
    schema = Schema(dict(SCHEMA.dimensions), {"Kind": {"hits": AttributeSpec("BIGINT", None, every), "weight": AttributeSpec("DOUBLE", 0.0, every)}}, SCHEMA.partial)
    hits = daily(spark, sf)
    names = hits.select("name").distinct()
    axis = hits.select("snapshot").distinct().withColumn("_row", F.unix_micros(F.col("snapshot").cast("timestamp")) / 86_400_000_000)
    root = Layer(
        "a", {"snapshot": axis.withColumn("_row", F.col("_row").cast("bigint")), "scenario": scenarios(spark)}, {"Kind": names},
        inputs={"hits": long(hits, "hits", name=F.col("name"), snapshot=F.col("snapshot"), value=F.col("value")), "weight": long(names, "weight", name=F.col("name"), value=F.length("name").cast("double"))},
    )
    more = hits.filter("name IN ('click', 'view')")
    child = Layer("b", inputs={"hits": long(more, "hits", name=F.col("name"), snapshot=F.col("snapshot"), scenario=F.lit("high"), value=F.col("value") * 2)})
    return LayeredRecord(Resolver(spark, schema, [root, child]))


TOOL = NetworkTool({"Kind": {"hits": Given(varying=True, dtype="BIGINT"), "weight": Given(varying=True, default=0.0), "out": Given(output=True, varying=True, dtype="BIGINT")}})
_HITS = """WITH scen(scenario) AS (VALUES ('base'), ('high'), ('low')), h AS (SELECT event_type AS name, date_trunc('day', ts) AS snapshot, count(*) AS n FROM events GROUP BY ALL),
hits AS (SELECT name, scenario, snapshot, CAST(CASE WHEN scenario = 'high' AND name IN ('click', 'view') THEN 2 * n ELSE n END AS BIGINT) AS value FROM h, scen)"""


@query(f"{_HITS} SELECT name, scenario, snapshot, value FROM hits")
def tool_series(spark, sf):
    """What a tool is given as wide frames, taken back as its results."""
    net = TOOL.build(_activity(spark, sf))
    net.outputs["Kind"] = {"out": net.series["Kind"]["hits"]}
    return TOOL.results(net)["out"].select("name", "scenario", "snapshot", "value")


@query(f"WITH {SQL} SELECT name, scenario, max(CASE WHEN role = 'input' THEN bus END) AS bus0, max(CASE WHEN role = 'output' THEN bus END) AS bus1, max(CASE WHEN role = 'input' THEN n END) AS efficiency0, max(CASE WHEN role = 'output' THEN n END) AS efficiency FROM ends, scen GROUP BY ALL")
def tool_static(spark, sf):
    """Links with a bus and an efficiency a port, a row a scenario."""
    l0 = layers(spark, sf)[0]
    few = Layer("L0", l0.dims, {"Link": l0.components["Link"]}, {"Link": l0.connections["Link"]}, {"efficiency": l0.inputs["efficiency"]})
    net = NetworkTool({"Link": {"efficiency": Given(dtype="BIGINT", connection=True)}}).build(LayeredRecord(Resolver(spark, SCHEMA, [few])))
    return net.static["Link"].select("name", "scenario", "bus0", "bus1", "efficiency0", "efficiency")


@query(f"{_HITS} SELECT 'hits' AS attribute, name, scenario, snapshot, CAST(value AS DOUBLE) AS value FROM hits UNION ALL SELECT DISTINCT 'weight', name, scenario, CAST(NULL AS TIMESTAMP), CAST(length(name) AS DOUBLE) FROM hits")
def tool_roundtrip(spark, sf):
    """A record built into a network and taken back as a layer resolves to the same rows."""
    schema, layer = TOOL.to_record(TOOL.build(_activity(spark, sf)))
    back = LayeredRecord(Resolver(spark, schema, [layer]))
    rows = [back.attributes[a].select("attribute", "name", "scenario", "snapshot", q("value").cast("double").alias("value")) for a in ("hits", "weight")]
    return rows[0].unionByName(rows[1])

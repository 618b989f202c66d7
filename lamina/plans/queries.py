"""The query catalogue: one query an operator, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.frames import anti, ordered, q, union_by_name
from lamina.functions.settle import settled, shared_folder
from lamina.operators.axes import expand, fold_axis
from lamina.operators.edit import WorkingRecord
from lamina.operators.record import LayeredRecord, default_fill
from lamina.operators.reshape import drop_defaults, melt, ports_pivot, ports_unpivot, series_pivot, static_assign
from lamina.operators.resolve import Resolver, flags_by_scan
from lamina.operators.write import ambiguous_names
from lamina.plans.data import SCHEMA, SQL, Tables, customers, layers, link_ends, long, months, name, pairs, resolved_sql, stack
from lamina.plans.tool import Attr
from lamina.schema import AttributeSpec, Dimension, Schema
from lamina.sources.layers import Layer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DEMAND = ("name", "scenario", "snapshot", "value")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _demand(spark, sf, upto: int) -> DataFrame:
    return stack(spark, sf, upto).attribute("demand").select(*DEMAND)


_ROWS = "SELECT name, scenario, snapshot, value FROM resolved"


@query(f"{resolved_sql(1)} {_ROWS}")
def overlay_lww(spark, sf):
    return _demand(spark, sf, 1)


@query(f"{resolved_sql(3)} {_ROWS}")
def overlay_all_layers(spark, sf):
    return _demand(spark, sf, 3)


@query(f"{resolved_sql(3)} SELECT DISTINCT name, scenario, depth FROM resolved")
def owner_map_inputs(spark, sf):
    return stack(spark, sf, 3).inputs_map(["demand"]).select("name", "scenario", "depth")


def _owned(spark, sf, upto: int) -> DataFrame:
    """Who owns each name's demand in each scenario, and what it comes to."""
    r = stack(spark, sf, upto)
    sums = r.attribute("demand").groupBy("name", "scenario").agg(F.count("*").alias("row_count"), F.sum("value").alias("total"))
    return sums.join(r.inputs_map(["demand"]).select("name", "scenario", "depth"), ["name", "scenario"])


_OWNED = "SELECT name, scenario, depth, count(*) AS row_count, CAST(sum(value) AS BIGINT) AS total FROM resolved GROUP BY ALL"


@query(f"{resolved_sql(1)} {_OWNED}")
def partial_scenario_override(spark, sf):
    return _owned(spark, sf, 1)


@query(f"WITH {SQL} SELECT 'C' || custkey AS name, scenario, cents AS value FROM flat, scen")
def broadcast_null_expand(spark, sf):
    r = stack(spark, sf, 0)
    flat = r.layers[0].inputs["demand"].filter("snapshot IS NULL")
    return expand(flat, ["scenario"], r.axes).select("name", "scenario", "value")


@query(f"{resolved_sql(0)} {_ROWS} WHERE snapshot IS NULL")
def broadcast_kept_nonpartial(spark, sf):
    return _demand(spark, sf, 0).filter("snapshot IS NULL")


@query(f"{resolved_sql(1)} SELECT name, scenario, count(*) AS row_count, count(snapshot) AS labels FROM resolved GROUP BY ALL")
def series_owned_whole(spark, sf):
    return _demand(spark, sf, 1).groupBy("name", "scenario").agg(F.count("*").alias("row_count"), F.count("snapshot").alias("labels"))


@query("""
SELECT 'P' || p_partkey AS name, scenario, bp AS breakpoint, p_retailprice * CASE WHEN p_partkey % 7 = 0 THEN g ELSE f END AS value
FROM part, (VALUES ('base'), ('high'), ('low')) s(scenario),
     (VALUES (CAST(0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE)), (10, 0.9, 0.5), (50, 0.8, 0.25)) v(bp, f, g)""")
def curve_owned_whole(spark, sf):
    return stack(spark, sf, 4).attribute("price").select("name", "scenario", "breakpoint", "value")


@query(f"WITH {SQL} SELECT name, bus, scenario, n AS value FROM ends, scen WHERE NOT (name = 'L0_1' AND role = 'output')")
def per_connection_values(spark, sf):
    return stack(spark, sf, 4).attribute("efficiency").select("name", "bus", "scenario", "value")


@query(f"WITH {SQL} SELECT name, bus, scenario, CASE WHEN role = 'input' AND n % 2 = 0 THEN -n ELSE n END AS value FROM ends, scen")
def per_connection_override(spark, sf):
    base = layers(spark, sf)[:1]
    ends = link_ends(pairs(Tables(spark, sf))).filter("role = 'input' AND n % 2 = 0")
    child = Layer("child", inputs={"efficiency": long(ends, "efficiency", name=q("name"), bus=q("bus"), value=-q("n"))})
    return Resolver(spark, SCHEMA, [*base, child]).attribute("efficiency").select("name", "bus", "scenario", "value")


@query(f"{resolved_sql(2)} {_ROWS}")
def component_tombstone(spark, sf):
    return _demand(spark, sf, 2)


@query(f"{resolved_sql(2)} SELECT name, count(DISTINCT scenario) AS scenarios FROM resolved GROUP BY ALL")
def scoped_tombstone(spark, sf):
    return _demand(spark, sf, 2).groupBy("name").agg(F.countDistinct("scenario").alias("scenarios"))


@query(f"WITH {SQL} SELECT name, bus, scenario, role FROM ends, scen WHERE NOT (name = 'L0_1' AND role = 'output')")
def connection_tombstone(spark, sf):
    return stack(spark, sf, 4).entities("connections", "Link").select("name", "bus", "scenario", "role")


@query(f"{resolved_sql(3)} {_OWNED}")
def tombstone_then_readd(spark, sf):
    return _owned(spark, sf, 3)


@query(f"""WITH {SQL} SELECT 'C' || c_custkey AS name, 'N' || c_nationkey AS bus, scenario FROM customer, scen
WHERE NOT EXISTS (SELECT 1 FROM dead_rows d WHERE d.name = 'C' || c_custkey AND d.scenario = scen.scenario)""")
def tombstone_kills_connections(spark, sf):
    return stack(spark, sf, 3).entities("connections", "Customer").select("name", "bus", "scenario")


@query(f"""WITH {SQL},
m AS (SELECT 0 AS depth, 'C' || c_custkey AS name, c_mktsegment AS segment, c_acctbal AS acctbal, scenario, c_custkey AS pos FROM customer, scen
  UNION ALL SELECT 3, 'C' || c_custkey, c_mktsegment, c_acctbal, scenario, c_custkey FROM customer, scen WHERE c_custkey % 194 = 0
  UNION ALL SELECT 3, 'C-new', 'NEW', 0.0, scenario, 2147483648 FROM scen),
w AS (SELECT *, row_number() OVER (PARTITION BY name, scenario ORDER BY depth DESC) AS rn FROM m)
SELECT w.name, w.scenario, segment, acctbal, CAST(w.depth * 1099511627776 + pos AS BIGINT) AS order_key
FROM w LEFT JOIN dead_rows d ON d.name = w.name AND d.scenario = w.scenario WHERE rn = 1 AND (d.depth IS NULL OR w.depth >= d.depth)""")
def members_resolved(spark, sf):
    return stack(spark, sf, 3).entities("components", "Customer").select("name", "scenario", "segment", "acctbal", "order_key")


@query(f"WITH {SQL} SELECT name, bus, role, scenario, row_number() OVER (PARTITION BY name, scenario ORDER BY ends.pos) AS nth FROM ends, scen")
def connections_ordered(spark, sf):
    from pyspark.sql.window import Window

    rows = stack(spark, sf, 0).entities("connections", "Link")
    w = Window.partitionBy("name", "scenario").orderBy("order_key")
    return rows.select("name", "bus", "role", "scenario", F.row_number().over(w).cast("bigint").alias("nth"))


def _axis_frames(spark, sf):
    t = Tables(spark, sf)
    first = months(t).withColumn("weight", F.lit(1.0))
    second = months(t).filter("month(snapshot) = 6").withColumn("weight", F.lit(2.0))
    third = spark.createDataFrame([("2030-01-01", 3.0, 0)], "s string, weight double, _row bigint").select(F.to_timestamp_ntz("s").alias("snapshot"), "weight", "_row")
    return [(0, first), (1, second), (2, third)]


_AXIS = """WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS snapshot FROM orders),
a AS (SELECT 0 AS depth, snapshot, CAST(1.0 AS DOUBLE) AS weight, year(snapshot) * 12 + month(snapshot) AS r FROM m
  UNION ALL SELECT 1, snapshot, 2.0, year(snapshot) * 12 + month(snapshot) FROM m WHERE month(snapshot) = 6
  UNION ALL SELECT 2, TIMESTAMP '2030-01-01', 3.0, 0)"""


@query(f"{_AXIS} SELECT snapshot, weight FROM a QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY depth DESC) = 1")
def axis_fold_lww(spark, sf):
    return fold_axis(_axis_frames(spark, sf), ["snapshot"]).select("snapshot", "weight")


@query(f"{_AXIS}, f AS (SELECT snapshot, min(depth * 1099511627776 + r) AS p FROM a GROUP BY ALL) SELECT snapshot, row_number() OVER (ORDER BY p) AS nth FROM f")
def axis_first_introduced(spark, sf):
    from pyspark.sql.window import Window

    # an axis: as many rows as it has labels
    return fold_axis(_axis_frames(spark, sf), ["snapshot"]).select("snapshot", F.row_number().over(Window.orderBy("_pos")).cast("bigint").alias("nth"))


@query("""WITH m AS (SELECT DISTINCT year(o_orderdate) AS period, month(o_orderdate) AS snapshot FROM orders),
a AS (SELECT 0 AS depth, *, CAST(1.0 AS DOUBLE) AS weight FROM m UNION ALL SELECT 1, *, 7.0 FROM m WHERE period = 1996 AND snapshot = 1)
SELECT CAST(period AS BIGINT) AS period, CAST(snapshot AS BIGINT) AS snapshot, weight FROM a QUALIFY row_number() OVER (PARTITION BY period, snapshot ORDER BY depth DESC) = 1""")
def nested_axis_fold(spark, sf):
    schema = Schema({"period": Dimension("BIGINT"), "snapshot": Dimension("BIGINT", within="period")}, {}, frozenset({"period"}))
    m = Tables(spark, sf).orders.select(F.year("o_orderdate").cast("bigint").alias("period"), F.month("o_orderdate").cast("bigint").alias("snapshot")).distinct()
    m = m.select("*", F.lit(1.0).alias("weight"), (F.col("period") * 12 + F.col("snapshot")).alias("_row"))
    edit = m.filter("period = 1996 AND snapshot = 1").withColumn("weight", F.lit(7.0))
    return Resolver(spark, schema, [Layer("a", {"snapshot": m}), Layer("b", {"snapshot": edit})]).axes["snapshot"].select("period", "snapshot", "weight")


def _flags_sql(rows: str) -> str:
    """Flags of rows (attribute, snapshot, scenario, breakpoint)."""
    each = " UNION ALL ".join(f"SELECT attribute, '{d}' AS dim, bool_or({d} IS NOT NULL) AS varies, bool_or({d} IS NULL) AS broadcast, bool_or(breakpoint IS NOT NULL) AS breakpoints FROM ({rows}) GROUP BY attribute" for d in ("snapshot", "scenario"))
    return f"SELECT attribute, dim, varies, broadcast, bool_or(breakpoints) OVER (PARTITION BY attribute) AS breakpoints FROM ({each})"


_PLAIN = """SELECT 'demand' AS attribute, snapshot, CAST(NULL AS VARCHAR) AS scenario, CAST(NULL AS DOUBLE) AS breakpoint FROM series
UNION ALL SELECT 'demand', NULL, NULL, NULL FROM flat
UNION ALL SELECT 'price', NULL, NULL, bp FROM part, (VALUES (CAST(0 AS DOUBLE)), (10), (50)) v(bp)
UNION ALL SELECT 'efficiency', NULL, NULL, NULL FROM ends"""
#: The rows that win in layers 0-3 as they were written: with NULL where a row holds for all scenarios.
_WRITTEN = """SELECT 'demand' AS attribute, snapshot, CASE WHEN depth = 1 AND snapshot IS NOT NULL THEN scenario END AS scenario, CAST(NULL AS DOUBLE) AS breakpoint FROM resolved"""


@query(f"WITH {SQL} {_flags_sql(_PLAIN)}")
def flags_directory(spark, sf):
    l0 = layers(spark, sf)[0]
    return flags_by_scan({a: l0.inputs[a] for a in l0.inputs}, SCHEMA)


@query(f"{resolved_sql(3)} {_flags_sql(_WRITTEN)}")
def flags_layered(spark, sf):
    return stack(spark, sf, 3).flags("Customer")


@query("SELECT CAST(0 AS BIGINT) AS inherited, (SELECT count(DISTINCT o_custkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey) AS own")
def outputs_not_inherited(spark, sf):
    child = LayeredRecord(stack(spark, sf, 1))
    own = LayeredRecord(stack(spark, sf, 0)).outputs["spend"]
    return own.agg(F.count("*").alias("own")).select(F.lit(len(child.outputs)).cast("bigint").alias("inherited"), "own")


@query("SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS size FROM customer UNION ALL BY NAME SELECT p_partkey AS id, p_size AS size FROM part")
def union_by_name_missing(spark, sf):
    t = Tables(spark, sf)
    return union_by_name([t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))])


def _working(spark, sf, upto: int = 0) -> WorkingRecord:
    return WorkingRecord(LayeredRecord(stack(spark, sf, upto)))


def _edited(spark, sf) -> WorkingRecord:
    """Two sets of one attribute, the second over half of the first; one removal."""
    w = _working(spark, sf)
    t = Tables(spark, sf)
    ids = lambda c: t.customer.filter(c).select(name("C", "c_custkey").alias("name"))
    w.set("demand", ids("c_custkey % 6 = 1").withColumn("value", F.lit(10).cast("bigint")))
    w.set("demand", ids("c_custkey % 12 = 1").withColumn("value", F.lit(20).cast("bigint")))
    w.remove("Customer", ["C13", "C25"])
    return w


_STAGED = "SELECT 'C' || c_custkey AS name, CAST(CASE WHEN c_custkey % 12 = 1 THEN 20 ELSE 10 END AS BIGINT) AS value FROM customer WHERE c_custkey % 6 = 1"


@query(f"{_STAGED} AND c_custkey NOT IN (13, 25)")
def staged_lww_collapse(spark, sf):
    return _edited(spark, sf).collapsed_values("demand").select("name", "value")


@query("SELECT unnest(['C13', 'C25']) AS name, CAST(0 AS BIGINT) AS row_count")
def staged_tombstone_wins(spark, sf):
    w = _edited(spark, sf)
    gone = spark.createDataFrame([("C13",), ("C25",)], "name string")
    rows = w.attributes["demand"].select("name", F.lit(1).alias("hit"))
    return gone.join(rows, "name", "left").groupBy("name").agg(F.count("hit").alias("row_count"))


@query("SELECT 'inputs' AS kind, 'demand' AS item, (SELECT count(*) FROM customer WHERE c_custkey % 6 = 1) + (SELECT count(*) FROM customer WHERE c_custkey % 12 = 1) AS \"rows\" UNION ALL SELECT 'components', 'Customer', 2")
def pending_counts(spark, sf):
    return _edited(spark, sf).pending_rows()


@query(f"""WITH {SQL}, st AS ({_STAGED})
SELECT name, scenario, CAST(NULL AS TIMESTAMP) AS snapshot, value FROM st, scen WHERE name NOT IN ('C13', 'C25')
UNION ALL SELECT name, scenario, snapshot, value FROM demand_rows WHERE depth = 0 AND name NOT IN (SELECT name FROM st) AND name NOT IN ('C13', 'C25')""")
def read_with_pending(spark, sf):
    return _edited(spark, sf).attributes["demand"].select(*DEMAND)


@query(f"""WITH {SQL}, hit AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY snapshot) AS rn FROM series WHERE custkey % 11 = 2)
SELECT 'C' || custkey AS name, scenario, snapshot, CASE WHEN rn = 1 THEN CAST(-1 AS BIGINT) ELSE cents END AS value FROM hit, scen""")
def restate_on_commit(spark, sf):
    """One hour of some series is edited: the whole series is written, nothing else."""
    w = _working(spark, sf)
    from lamina.plans.data import monthly

    one = monthly(Tables(spark, sf)).filter("custkey % 11 = 2").groupBy("custkey").agg(F.min("snapshot").alias("snapshot"))
    w.set("demand", one.select(name("C", "custkey").alias("name"), "snapshot", F.lit(-1).cast("bigint").alias("value")))
    rows = w.staged_layer().inputs["demand"]
    return expand(rows, ["scenario"], w._base.axes).select(*DEMAND)


@query(f"WITH {SQL} SELECT name, scenario, snapshot, value * 11 AS value FROM demand_rows WHERE depth = 0")
def derived_edit(spark, sf):
    w = _working(spark, sf)
    w.set("demand", q("value") * 11)
    return w.attributes["demand"].select(*DEMAND)


@query("SELECT 'C' || c_custkey AS name, scenario, CAST(5 AS BIGINT) AS value FROM customer, (VALUES ('base'), ('high'), ('low')) s(scenario)")
def set_all_declaring(spark, sf):
    w = _working(spark, sf)
    w.set("demand", 5)
    return w.attributes["demand"].select("name", "scenario", "value")


@query(f"""{resolved_sql(4)},
back AS (SELECT 'C' || c_custkey AS name, c_mktsegment AS segment, c_acctbal AS acctbal, scenario FROM customer, scen
  WHERE c_custkey % 194 = 0 OR NOT EXISTS (SELECT 1 FROM dead_rows d WHERE d.name = 'C' || c_custkey AND d.scenario = scen.scenario)
  UNION ALL SELECT 'C-new', 'NEW', 0.0, scenario FROM scen),
rows AS (
  SELECT 'input' AS kind, 'demand' AS item, name, NULL AS bus, NULL AS role, scenario, snapshot, NULL AS breakpoint, CAST(value AS DOUBLE) AS number, NULL AS label FROM resolved
  UNION ALL SELECT 'input', 'price', 'P' || p_partkey, NULL, NULL, scenario, NULL, bp, p_retailprice * CASE WHEN p_partkey % 7 = 0 THEN g ELSE f END, NULL
  FROM part, scen, (VALUES (CAST(0 AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE)), (10, 0.9, 0.5), (50, 0.8, 0.25)) v(bp, f, g)
  UNION ALL SELECT 'input', 'efficiency', name, bus, NULL, scenario, NULL, NULL, n, NULL FROM ends, scen WHERE NOT (name = 'L0_1' AND role = 'output')
  UNION ALL SELECT 'component', 'Customer', name, NULL, NULL, scenario, NULL, NULL, acctbal, segment FROM back
  UNION ALL SELECT 'component', 'Part', 'P' || p_partkey, NULL, NULL, scenario, NULL, NULL, p_size, p_brand FROM part, scen
  UNION ALL SELECT 'component', 'Bus', 'N' || n_nationkey, NULL, NULL, scenario, NULL, NULL, n_regionkey, NULL FROM nation, scen
  UNION ALL SELECT 'component', 'Link', 'L' || s || '_' || c, NULL, NULL, scenario, NULL, NULL, NULL, NULL FROM pairs, scen
  UNION ALL SELECT 'connection', 'Customer', 'C' || c_custkey, 'N' || c_nationkey, 'attached', scenario, NULL, NULL, NULL, NULL FROM customer, scen
  WHERE NOT EXISTS (SELECT 1 FROM dead_rows d WHERE d.name = 'C' || c_custkey AND d.scenario = scen.scenario)
  UNION ALL SELECT 'connection', 'Link', name, bus, role, scenario, NULL, NULL, NULL, NULL FROM ends, scen WHERE NOT (name = 'L0_1' AND role = 'output'))
SELECT * FROM rows""")
def flatten_directory(spark, sf):
    """The unreduced stack committed to a directory; every reread row of every attribute, component and connection type."""
    from lamina.operators.edit import Directory
    from lamina.sources.store import Store

    root = shared_root(spark)
    d = WorkingRecord(LayeredRecord(stack(spark, sf, 4)), Store(spark, root)).commit(Directory(f"{root}/flat"))
    kinds = {"name": "string", "bus": "string", "role": "string", "scenario": "string", "snapshot": "timestamp_ntz", "breakpoint": "double", "number": "double", "label": "string"}
    labels = {"Customer": ("acctbal", "segment"), "Part": ("size", "brand"), "Bus": ("region", None)}

    def rows(kind: str, item: str, df: DataFrame, number: str | None = None, label: str | None = None) -> DataFrame:
        own = {c: c for c in df.columns if c not in ("number", "label")} | {k: c for k, c in (("number", number), ("label", label)) if c}
        return df.select(F.lit(kind).alias("kind"), F.lit(item).alias("item"), *[(q(own[c]) if c in own else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    got = [rows("input", a, d.attributes[a], "value") for a in d.attributes]
    got += [rows("component", t, d.components[t], *labels.get(t, ())) for t in d.components]
    got += [rows("connection", t, d.connections[t]) for t in d.connections]
    out = got[0]
    for g in got[1:]:
        out = out.unionByName(g)
    return out


def shared_root(spark) -> str:
    """A new folder in what the cluster shares."""
    import uuid

    return f"{shared_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


@query("SELECT k AS name, count(DISTINCT t) AS types FROM (SELECT c_nationkey AS k, 'Customer' AS t FROM customer UNION ALL SELECT s_nationkey, 'Supplier' FROM supplier UNION ALL SELECT n_nationkey + 10, 'Nation' FROM nation) GROUP BY ALL HAVING count(DISTINCT t) > 1")
def name_uniqueness(spark, sf):
    t = Tables(spark, sf)
    return ambiguous_names({"Customer": t.customer.select(F.col("c_nationkey").alias("name")), "Supplier": t.supplier.select(F.col("s_nationkey").alias("name")), "Nation": t.nation.select((F.col("n_nationkey") + 10).alias("name"))})


@query("""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS snapshot FROM orders),
v AS (SELECT 'C' || o_custkey AS name, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE date_trunc('month', o_orderdate) END AS snapshot, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS value FROM orders GROUP BY ALL)
SELECT 'C' || c_custkey AS name, m.snapshot, coalesce(v.value, 0) AS value FROM customer CROSS JOIN m LEFT JOIN v ON v.name = 'C' || c_custkey AND (v.snapshot IS NULL OR v.snapshot = m.snapshot)""")
def default_filled(spark, sf):
    l0 = layers(spark, sf)[0]
    axes = {"snapshot": l0.dims["snapshot"]}
    return default_fill(l0.inputs["demand"], l0.components["Customer"], axes, SCHEMA, "demand").select("name", "snapshot", "value")


@query("SELECT l_orderkey, l_linenumber, l_discount AS value FROM lineitem WHERE l_discount IS DISTINCT FROM 0.05")
def default_dropped(spark, sf):
    rows = Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value"))
    return drop_defaults(rows, 0.05)


KINDS = ("click", "error", "purchase", "signup", "view")
_COUNTS = ", ".join(f"CAST(count(*) FILTER (event_type = '{k}') AS BIGINT) AS {k}" for k in KINDS)


def daily(spark, sf) -> DataFrame:
    """(name, snapshot, value): events of each type a day."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return Tables(spark, sf).events.groupBy(day.alias("snapshot"), F.col("event_type").alias("name")).agg(F.count("*").alias("value"))


@query(f"SELECT date_trunc('day', ts) AS snapshot, {_COUNTS} FROM events GROUP BY ALL")
def series_wide(spark, sf):
    return series_pivot(daily(spark, sf), ["snapshot"], KINDS).na.fill(0, list(KINDS))


@query("SELECT 'C' || c_custkey AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 10 = 4 THEN CAST(c_custkey AS DOUBLE) ELSE c_acctbal END AS acctbal FROM customer")
def static_frame(spark, sf):
    t = Tables(spark, sf)
    over = long(t.customer.filter("c_custkey % 10 = 4"), "acctbal", name=name("C", "c_custkey"), value=F.col("c_custkey").cast("double"))
    return static_assign(customers(t).drop("_row"), {"acctbal": over}, "snapshot").select("name", "segment", "acctbal")


@query(f"WITH {SQL} SELECT name, max(CASE WHEN role = 'input' THEN bus END) AS bus0, max(CASE WHEN role = 'output' THEN bus END) AS bus1 FROM ends GROUP BY ALL")
def ports_wide(spark, sf):
    ends = link_ends(pairs(Tables(spark, sf))).withColumnRenamed("_row", "order_key")
    return ports_pivot(ends, 2).select("name", "bus0", "bus1")


@query(f"WITH {SQL} SELECT name, bus, role FROM ends")
def ports_long(spark, sf):
    ends = link_ends(pairs(Tables(spark, sf))).withColumnRenamed("_row", "order_key")
    return ports_unpivot(ports_pivot(ends, 2), {"bus0": "input", "bus1": "output"})


@query("SELECT l_orderkey, l_linenumber, attribute, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR attribute IN (l_quantity, l_discount, l_tax))")
def wide_to_long(spark, sf):
    return melt(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey - (SELECT min(r_regionkey) FROM region) AS BIGINT) AS depth FROM region")
def ancestry_chain(spark, sf):
    """A revision a region, each the child of the one before; the chain, root first, as the store keeps it."""
    from lamina.sources.store import Store

    s, ids = Store(spark, shared_root(spark)), {}
    for r in Tables(spark, sf).region.orderBy("r_regionkey").collect():  # regions of the world
        ids[r.r_regionkey] = s.create(list(ids.values())[-1] if ids else None).id
        s.create(ids[r.r_regionkey])  # a branch that is not in the chain
    number = {v: k for k, v in ids.items()}
    return spark.createDataFrame([(number[x], d) for d, x in enumerate(s.ancestry(list(ids.values())[-1]))], "id bigint, depth bigint")


@query("SELECT CAST(c_custkey AS BIGINT) AS k, 'net' AS attribute, c_acctbal - s_acctbal AS value FROM customer JOIN supplier ON c_custkey = s_suppkey")
def attr_compute(spark, sf):
    t = Tables(spark, sf)
    a = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    b = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("other"))
    net = Attr(("a", "b"), lambda x, y: x.join(y, "k").select("k", (q("value") - q("other")).alias("value")))
    return net.resolve({"a": a, "b": b}, "net").select(q("k").cast("bigint").alias("k"), "attribute", "value")


@query(f"{resolved_sql(3)} {_ROWS}")
def materialise_invariance(spark, sf):
    """The maps of the first two layers, settled, start the fold over the others."""
    from lamina.operators.resolve import Maps

    every = layers(spark, sf)[:4]
    m = Resolver(spark, SCHEMA, every[:2]).maps()
    kept = Maps(m.depth, settled(m.inputs), settled(m.components), settled(m.connections), m.axes)
    return Resolver(spark, SCHEMA, every, kept).attribute("demand").select(*DEMAND)


_NULLS = "SELECT '{0}' AS side, c_custkey, c_nationkey FROM customer l WHERE NOT EXISTS (SELECT 1 FROM (SELECT CASE WHEN s_nationkey {1} THEN s_nationkey END AS k FROM supplier WHERE s_nationkey < 12) r WHERE r.k IS NOT DISTINCT FROM CASE WHEN c_nationkey <> 3 THEN c_nationkey END)"


@query(f"{_NULLS.format('null', '<> 5')} UNION ALL {_NULLS.format('none', '>= 0')}")
def null_safe_anti(spark, sf):
    """Left keys with NULLs, against right keys with NULLs and without."""
    t = Tables(spark, sf)
    left = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("name"))
    right = t.supplier.filter("s_nationkey < 12")
    some = anti(left, right.select(F.when(F.col("s_nationkey") != 5, F.col("s_nationkey")).alias("name")), ["name"])
    none = anti(left, right.select(F.col("s_nationkey").alias("name")), ["name"])
    return some.select(F.lit("null").alias("side"), "c_custkey", "c_nationkey").unionByName(none.select(F.lit("none").alias("side"), "c_custkey", "c_nationkey"))


@query("SELECT snapshot, row_number() OVER (ORDER BY snapshot) AS nth FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS snapshot FROM orders)")
def ordered_axis(spark, sf):
    """An axis as a record gives it, numbered as it comes."""
    from pyspark.sql.window import Window

    axis = LayeredRecord(stack(spark, sf, 1)).dims["snapshot"].select("snapshot", F.monotonically_increasing_id().alias("at"))
    # an axis: as many rows as it has labels
    return axis.select("snapshot", F.row_number().over(Window.orderBy("at")).cast("bigint").alias("nth"))


@query("SELECT 'C' || c_custkey AS name, 'N' || c_nationkey AS bus, scenario FROM customer, (VALUES ('base'), ('high'), ('low')) s(scenario) WHERE NOT (c_custkey IN (1, 2)) UNION ALL SELECT 'C1', 'N-x', scenario FROM (VALUES ('base'), ('high'), ('low')) s(scenario)")
def connect_and_disconnect(spark, sf):
    w = _working(spark, sf)
    old = Tables(spark, sf).customer.filter("c_custkey IN (1, 2)").select("c_custkey", "c_nationkey").collect()  # two rows
    w.disconnect("Customer", [(f"C{r.c_custkey}", f"N{r.c_nationkey}") for r in old])
    w.connect("Customer", [{"name": "C1", "bus": "N-x", "role": "attached"}])
    return w.connections["Customer"].select("name", "bus", "scenario")


@query(f"WITH {SQL} SELECT name, scenario, snapshot, value FROM demand_rows WHERE depth = 0 UNION ALL SELECT 'C-a', scenario, NULL, CAST(7 AS BIGINT) FROM scen")
def add_members(spark, sf):
    w = _working(spark, sf)
    w.add("Customer", [{"name": "C-a", "segment": "NEW", "demand": 7}])
    return w.attributes["demand"].select(*DEMAND)

"""The star-schema tables as a stack of layers, derived by deterministic predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.resolve import Resolver
from lamina.schema import AttributeSpec, Dimension, Schema
from lamina.sources.layers import Frames, Layer

ALL = frozenset({"snapshot", "scenario"})
SCHEMA = Schema(
    {"snapshot": Dimension("TIMESTAMP"), "scenario": Dimension("VARCHAR", keys=frozenset({"component", "connection"}))},
    {
        "Customer": {"demand": AttributeSpec("BIGINT", 0, ALL), "segment": AttributeSpec("VARCHAR"), "acctbal": AttributeSpec("DOUBLE")},
        "Part": {"price": AttributeSpec("DOUBLE", None, frozenset({"scenario"}), True), "brand": AttributeSpec("VARCHAR"), "size": AttributeSpec("INTEGER")},
        "Bus": {"region": AttributeSpec("INTEGER")},
        "Link": {"efficiency": AttributeSpec("BIGINT", None, frozenset({"scenario"}), bus="connection")},
    },
    frozenset({"scenario"}),
)


class Tables:
    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def __getattr__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf}/{name}.parquet")
        setattr(self, name, df)  # a file's footer is read once
        return df


def lazy(**build) -> Frames:
    """Frames built when they are looked up."""
    return Frames(tuple(build), lambda k: build[k]())


def month(c: str):
    return F.date_trunc("month", F.col(c)).cast("timestamp_ntz")


def long(df: DataFrame, attribute: str, **cols) -> DataFrame:
    """Long rows: what is not given is NULL."""
    kinds = {"name": "string", "bus": "string", "snapshot": "timestamp_ntz", "scenario": "string", "breakpoint": "double"}
    pick = [(cols[c] if c in cols else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return df.select(*pick, F.lit(attribute).alias("attribute"), cols["value"].alias("value"))


def name(prefix: str, key: str):
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('base', 0.5D, 0L), ('high', 0.3D, 1L), ('low', 0.2D, 2L) AS x(scenario, weight, _row)")


def months(t: Tables) -> DataFrame:
    m = month("o_orderdate")
    return t.orders.select(m.alias("snapshot")).distinct().withColumn("_row", (F.year("snapshot") * 12 + F.month("snapshot")).cast("bigint"))


def monthly(t: Tables) -> DataFrame:
    """(custkey, snapshot, cents) of the customers whose demand is a series."""
    o = t.orders.filter("o_custkey % 5 != 0")
    return o.groupBy(F.col("o_custkey").alias("custkey"), month("o_orderdate").alias("snapshot")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def yearly(t: Tables) -> DataFrame:
    """(custkey, cents) of the customers whose demand is one number."""
    o = t.orders.filter("o_custkey % 5 = 0")
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


def curves(t: Tables, factors: tuple[float, float, float], where: str | None = None) -> DataFrame:
    parts = t.part.filter(where) if where else t.part
    points = F.array(*[F.struct(F.lit(float(b)).alias("b"), F.lit(f).alias("f")) for b, f in zip((0, 10, 50), factors)])
    each = parts.select("p_partkey", "p_retailprice", F.explode(points).alias("x"))
    return long(each, "price", name=name("P", "p_partkey"), breakpoint=F.col("x.b"), value=F.col("p_retailprice") * F.col("x.f"))


def pairs(t: Tables) -> DataFrame:
    """(s, c, n): line items between supplier and customer nations; a row a pair of nations, kept by
    the session, as every frame of links is made from it."""
    li = t.lineitem.select("l_orderkey", "l_suppkey")
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("s"))
    c = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("c")), F.col("o_custkey") == F.col("c_custkey"))
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("s", "c").agg(F.count("*").alias("n")).persist()


def link_name():
    return F.concat(F.lit("L"), F.col("s").cast("string"), F.lit("_"), F.col("c").cast("string"))


def link_ends(p: DataFrame) -> DataFrame:
    """(name, bus, role, n): two connections a link, one where the nations are equal."""
    ends = F.array(F.struct(name("N", "s").alias("bus"), F.lit("input").alias("role")), F.struct(name("N", "c").alias("bus"), F.lit("output").alias("role")))
    each = p.select(link_name().alias("name"), "s", "c", "n", F.posexplode(ends).alias("k", "e"))
    return each.filter("k = 0 OR s != c").select("name", "e.bus", "e.role", "n", (F.col("s") * 100 + F.col("c") * 2 + F.col("k")).cast("bigint").alias("_row"))


def customers(t: Tables, where: str = "true") -> DataFrame:
    return t.customer.filter(where).select(name("C", "c_custkey").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"), F.col("c_custkey").alias("_row"))


def removed(df: DataFrame, scenario=None) -> DataFrame:
    return df.select("name", F.lit(scenario).cast("string").alias("scenario"), F.lit(True).alias("deleted"), "_row")


def layers(spark: SparkSession, sf: str) -> list[Layer]:
    t = Tables(spark, sf)

    def ends() -> DataFrame:
        return link_ends(pairs(t))

    def demand() -> DataFrame:
        series = long(monthly(t), "demand", name=name("C", "custkey"), snapshot=F.col("snapshot"), value=F.col("cents"))
        return series.unionByName(long(yearly(t), "demand", name=name("C", "custkey"), value=F.col("cents")))

    def spend() -> DataFrame:
        lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        sums = lines.groupBy("o_custkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))
        return long(sums, "spend", name=name("C", "o_custkey"), value=F.col("cents"))

    l0 = Layer(
        "L0",
        lazy(snapshot=lambda: months(t), scenario=lambda: scenarios(spark)),
        lazy(
            Customer=lambda: customers(t),
            Part=lambda: t.part.select(name("P", "p_partkey").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("_row")),
            Bus=lambda: t.nation.select(name("N", "n_nationkey").alias("name"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("bigint").alias("_row")),
            Link=lambda: pairs(t).select(link_name().alias("name"), (F.col("s") * 100 + F.col("c")).cast("bigint").alias("_row")),
        ),
        lazy(
            Customer=lambda: t.customer.select(name("C", "c_custkey").alias("name"), name("N", "c_nationkey").alias("bus"), F.lit("attached").alias("role"), F.col("c_custkey").alias("_row")),
            Link=lambda: ends().drop("n"),
        ),
        lazy(demand=demand, price=lambda: curves(t, (1.0, 0.9, 0.8)), efficiency=lambda: long(ends(), "efficiency", name=F.col("name"), bus=F.col("bus"), value=F.col("n"))),
        lazy(spend=spend),
    )

    def doubled() -> DataFrame:
        high = long(monthly(t).filter("custkey % 10 = 3"), "demand", name=name("C", "custkey"), snapshot=F.col("snapshot"), scenario=F.lit("high"), value=F.col("cents") * 2)
        return high.unionByName(long(t.customer.filter("c_custkey % 10 = 4"), "demand", name=name("C", "c_custkey"), value=F.lit(4242).cast("bigint")))

    l1 = Layer("L1", inputs=lazy(demand=doubled))
    l2 = Layer("L2", components=lazy(Customer=lambda: removed(customers(t, "c_custkey % 97 = 0")).unionByName(removed(customers(t, "c_custkey % 89 = 0"), "low"))))

    def back() -> DataFrame:
        new = spark.range(1).select(F.lit("C-new").alias("name"), F.lit("NEW").alias("segment"), F.lit(0.0).alias("acctbal"), F.lit(1 << 31).cast("bigint").alias("_row"))
        return customers(t, "c_custkey % 194 = 0").unionByName(new)

    def again() -> DataFrame:
        return long(back(), "demand", name=F.col("name"), value=F.when(F.col("name") == "C-new", 999).otherwise(777).cast("bigint"))

    l3 = Layer("L3", components=lazy(Customer=back), inputs=lazy(demand=again))
    cut = lambda: ends().filter("role = 'output' AND name = 'L0_1'").select("name", "bus", F.lit(True).alias("deleted"), "_row")
    l4 = Layer("L4", connections=lazy(Link=cut), inputs=lazy(price=lambda: curves(t, (1.0, 0.5, 0.25), "p_partkey % 7 = 0")))
    return [l0, l1, l2, l3, l4]


def stack(spark: SparkSession, sf: str, upto: int = 4) -> Resolver:
    return Resolver(spark, SCHEMA, layers(spark, sf)[: upto + 1])


#: The same derivation in SQL.
SQL = """
scen(scenario, pos) AS (VALUES ('base', 0), ('high', 1), ('low', 2)),
series AS (
  SELECT o_custkey AS custkey, date_trunc('month', o_orderdate) AS snapshot, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders WHERE o_custkey % 5 <> 0 GROUP BY ALL),
flat AS (
  SELECT o_custkey AS custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM orders WHERE o_custkey % 5 = 0 GROUP BY ALL),
demand_rows AS (
  SELECT 0 AS depth, 'C' || custkey AS name, scenario, snapshot, cents AS value FROM series, scen
  UNION ALL SELECT 0, 'C' || custkey, scenario, NULL, cents FROM flat, scen
  UNION ALL SELECT 1, 'C' || custkey, 'high', snapshot, cents * 2 FROM series WHERE custkey % 10 = 3
  UNION ALL SELECT 1, 'C' || c_custkey, scenario, NULL, CAST(4242 AS BIGINT) FROM customer, scen WHERE c_custkey % 10 = 4
  UNION ALL SELECT 3, 'C' || c_custkey, scenario, NULL, CAST(777 AS BIGINT) FROM customer, scen WHERE c_custkey % 194 = 0
  UNION ALL SELECT 3, 'C-new', scenario, NULL, CAST(999 AS BIGINT) FROM scen),
dead_rows AS (
  SELECT 2 AS depth, 'C' || c_custkey AS name, scenario FROM customer, scen
  WHERE c_custkey % 97 = 0 OR (c_custkey % 89 = 0 AND scenario = 'low')),
pairs AS (
  SELECT s_nationkey AS s, c_nationkey AS c, count(*) AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
ends AS (
  SELECT 'L' || s || '_' || c AS name, 'N' || s AS bus, 'input' AS role, n, CAST(s * 100 + c * 2 AS BIGINT) AS pos FROM pairs
  UNION ALL SELECT 'L' || s || '_' || c, 'N' || c, 'output', n, CAST(s * 100 + c * 2 + 1 AS BIGINT) FROM pairs WHERE s <> c)"""


def resolved_sql(upto: int) -> str:
    """CTEs that end in ``resolved``: what the first layers up to ``upto`` resolve to."""
    return f"""WITH {SQL},
won AS (SELECT name, scenario, max(depth) AS depth FROM demand_rows WHERE depth <= {upto} GROUP BY ALL),
resolved AS (
  SELECT r.name, r.scenario, r.snapshot, r.value, r.depth
  FROM demand_rows r JOIN won w ON r.name = w.name AND r.scenario = w.scenario AND r.depth = w.depth
  LEFT JOIN (SELECT * FROM dead_rows WHERE depth <= {upto}) x ON x.name = r.name AND x.scenario = r.scenario
  WHERE x.depth IS NULL OR r.depth >= x.depth)"""

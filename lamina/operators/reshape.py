"""Long rows to wide static and series frames, ports, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.functions.frames import q, union_by_name

SEPARATOR = "\x01"


def static_assign(members: DataFrame, rows: Mapping[str, DataFrame], snapshot: str, key: Sequence[str] = ("name",)) -> DataFrame:
    """Members with a column an attribute: a row without ``snapshot`` beats the member's own column.

    ``rows`` are long rows by attribute; of several such rows of a key the smallest value's stands.
    """
    for a, f in rows.items():
        flat = f.filter(q(snapshot).isNull() & q("breakpoint").isNull()) if "breakpoint" in f.columns else f.filter(q(snapshot).isNull())
        flat = flat.groupBy(*[q(k).alias("__k_" + k) for k in key]).agg(F.min("value").alias("__v"))
        on = [q(k).eqNullSafe(q("__k_" + k)) for k in key]
        cond = on[0]
        for c in on[1:]:
            cond &= c
        got = members.join(flat, cond, "left")
        value: Column = F.coalesce(q("__v"), q(a).cast(flat.schema["__v"].dataType)) if a in members.columns else q("__v")
        members = got.select(*[q(c) for c in members.columns if c != a], value.alias(a))
    return members


def series_pivot(rows: DataFrame, index: Sequence[str], columns: Sequence[str] | None = None, key: Sequence[str] = ("name",), axis: DataFrame | None = None) -> DataFrame:
    """Rows with a label, one column a member: GROUP BY index, PIVOT key.

    Given ``columns`` the pivot plans without a pass to find them.  ``axis`` with ``_pos`` brings
    back labels without rows, in the axis' order.
    """
    live = rows.filter(q(index[-1]).isNotNull())
    name = q(key[0]) if len(key) == 1 else F.concat_ws(SEPARATOR, *[F.coalesce(q(k).cast("string"), F.lit("")) for k in key])
    keyed = live.withColumn("__key", name)
    wide = keyed.groupBy(*map(q, index)).pivot("__key", list(columns) if columns is not None else None).agg(F.first("value", ignorenulls=True))
    if axis is None:
        return wide
    have = [c for c in index if c in axis.columns]
    return axis.select(*map(q, have), "_pos").join(wide, have, "left").orderBy("_pos").drop("_pos")


def melt(wide: DataFrame, ids: Sequence[str], values: Sequence[str], attribute: str = "attribute", value: str = "value") -> DataFrame:
    """Wide to long: a row an id and column."""
    return wide.unpivot(list(map(q, ids)), list(map(q, values)), attribute, value)


def stack_series(wide: DataFrame, index: str | Sequence[str], attribute: str, key: Sequence[str] = ("name",)) -> DataFrame:
    """A series frame (one column a member, or a member and its labels of ``key[1:]``) to long rows."""
    index = [index] if isinstance(index, str) else list(index)
    names = [c for c in wide.columns if c not in index]
    rows = wide.unpivot(list(map(q, index)), list(map(q, names)), "name", "value")
    if len(key) > 1:
        parts = F.split("name", SEPARATOR, -1)
        label = lambda k: F.when(F.get(parts, F.lit(k)) != "", F.get(parts, F.lit(k)))
        rows = rows.select(*map(q, index), *[label(k).alias(c) for k, c in enumerate(key)], "value")
    return rows.withColumn("attribute", F.lit(attribute))


def scalar_rows(members: DataFrame, attribute: str, snapshot: str, kind: str = "timestamp_ntz", column: str | None = None) -> DataFrame:
    """A member column to long rows that hold for every label of ``snapshot``; scenarios stay apart."""
    more = [q("scenario")] if "scenario" in members.columns else []
    return members.select("name", *more, F.lit(None).cast(kind).alias(snapshot), F.lit(attribute).alias("attribute"), q(column or attribute).alias("value"))


def drop_defaults(rows: DataFrame, default) -> DataFrame:
    """Rows that say more than the default does; NULL values differ from any default."""
    if default is None:
        return rows.filter(q("value").isNotNull())
    return rows.filter(~q("value").eqNullSafe(F.lit(default)))


def numbered_ports(connections: DataFrame, key: Sequence[str] = ("name",), order: str = "order_key") -> DataFrame:
    """Connections with ``port`` 0, 1, ...: inputs first, then as ordered; and their number."""
    rank = F.when(q("role") == "input", 0).when(q("role") == "output", 2).otherwise(1)
    w = Window.partitionBy(*map(q, key))
    nth = F.row_number().over(w.orderBy(rank, q(order).asc_nulls_last(), q("bus")))
    return connections.withColumn("port", (nth - 1).cast("bigint")).withColumn("ports", F.count("*").over(w))


def ports_pivot(connections: DataFrame, most: int | None = None, key: Sequence[str] = ("name",), order: str = "order_key", values: Sequence[str] = ()) -> DataFrame:
    """One row a ``key`` with ``bus0``, ``bus1`` ... (a lone attached port is plain ``bus``) and each
    of ``values`` by port.  Connections that have a ``port`` already keep it."""
    ports = connections if "port" in connections.columns else numbered_ports(connections, key, order)
    if most is None:
        most = (ports.agg(F.max("port")).first()[0] or 0) + 1  # one number
    lone = (q("ports") == 1) & (q("role") == "attached")
    cols = []
    for v in ("bus", *values):
        if v == "bus":
            cols.append(F.max(F.when(lone, q(v))).alias(v))
            cols += [F.max(F.when(~lone & (q("port") == k), q(v))).alias(f"bus{k}") for k in range(most)]
        else:
            # a lone port and port 1 share the plain name
            cols.append(F.max(F.when(lone | (q("port") == 1), q(v))).alias(v))
            cols += [F.max(F.when(~lone & (q("port") == k), q(v))).alias(port_attribute(v, k)) for k in range(most) if k != 1]
    return ports.groupBy(*map(q, key)).agg(*cols)


def port_attribute(attribute: str, port: int) -> str:
    """``efficiency`` on port 1, ``efficiency0`` and ``efficiency2`` on the others."""
    return attribute if port == 1 else f"{attribute}{port}"


def port_role(port: int) -> str:
    return "input" if port == 0 else "output"


def ports_unpivot(members: DataFrame, ports: Mapping[str, str]) -> DataFrame:
    """Connection rows (name, bus, role) of port columns ``{column: role}``; empty ports give none."""
    more = [q("scenario")] if "scenario" in members.columns else []
    return union_by_name([members.select("name", q(c).alias("bus"), F.lit(r).alias("role"), *more).filter(q("bus").isNotNull() & (q("bus") != "")) for c, r in ports.items()])


def port_attribute_rows(members: DataFrame, attribute: str, ports: Mapping[int | None, str]) -> DataFrame | None:
    """Long rows of one attribute over its port columns: ``{port: bus column}`` names each row's bus, a
    lone port is None; None where the members have no such column."""
    more = [q("scenario")] if "scenario" in members.columns else []
    held = [(bus, attribute if k is None else port_attribute(attribute, k)) for k, bus in ports.items()]
    rows = [members.select("name", q(bus).alias("bus"), *more, F.lit(attribute).alias("attribute"), q(c).alias("value")) for bus, c in held if c in members.columns and bus in members.columns]
    return union_by_name(rows).filter(q("value").isNotNull() & q("bus").isNotNull() & (q("bus") != "")).distinct() if rows else None

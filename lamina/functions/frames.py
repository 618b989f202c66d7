"""Null-safe matching and unions by name."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lamina.functions.types import ddl, spark_type

R = "__r_"


def q(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def renamed(df: DataFrame, prefix: str = R) -> DataFrame:
    return df.select(*[q(c).alias(prefix + c) for c in df.columns])


def matches(exact: Sequence[str], wide: Sequence[str] = (), prefix: str = R) -> Column:
    """Rows agree null-safely on ``exact``; on ``wide`` a NULL on the left stands for every value."""
    return all_of([*[q(c).eqNullSafe(q(prefix + c)) for c in exact], *[q(c).isNull() | q(c).eqNullSafe(q(prefix + c)) for c in wide]])


def semi(left: DataFrame, right: DataFrame, on: Sequence[str], wide: Sequence[str] = ()) -> DataFrame:
    return left.join(renamed(right.select(*map(q, [*on, *wide]))), matches(on, wide), "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str], wide: Sequence[str] = ()) -> DataFrame:
    """Left rows that no right row equals on ``on``; a NULL in ``wide`` of the *right* covers all."""
    r = renamed(right.select(*map(q, [*on, *wide])))
    cond = all_of([*[q(c).eqNullSafe(q(R + c)) for c in on], *[q(R + c).isNull() | q(c).eqNullSafe(q(R + c)) for c in wide]])
    return left.join(r, cond, "left_anti")


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by name; a column or struct field that one side lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add what is absent of ``columns`` (name -> declared type) as typed NULLs."""
    have = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit(None).cast(ddl(t)).alias(c) for c, t in columns.items() if c.lower() not in have])


def cast_declared(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast the declared columns, pass the others through."""
    return df.select(*[q(c).cast(ddl(columns[c])).alias(c) if c in columns else q(c) for c in df.columns])


def empty(spark: SparkSession, columns: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c, spark_type(t)) for c, t in columns.items()]))


def latest_per(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; NULL keys group together.

    One aggregate that combines before the shuffle, so a key's older rows stay where they are; by one
    column of order, each other column apart, which is a hash aggregate where they are numbers.
    """
    rest = [c for c in df.columns if c not in key]
    if len(order) == 1:
        each = [F.max(q(c)).alias(c) if c in order else F.max_by(q(c), q(order[0])).alias(c) for c in rest]
        return df.groupBy(*map(q, key)).agg(*each).select(*map(q, df.columns))
    best = df.groupBy(*map(q, key)).agg(F.max_by(F.struct(*map(q, rest)), F.struct(*map(q, order))).alias("__last"))
    return best.select(*[q(c) if c in key else F.col("__last").getField(c).alias(c) for c in df.columns])


def strict(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast the declared columns; a value that is not of its type raises, whatever the session's mode."""

    def one(c: str) -> Column:
        if c not in columns or df.schema[c].dataType == spark_type(columns[c]):
            return q(c)
        got = q(c).try_cast(ddl(columns[c]))
        bad = F.raise_error(F.concat(F.lit(f"{c} is no {columns[c]}: "), q(c).cast("string"))).cast(ddl(columns[c]))
        return F.when(q(c).isNotNull() & got.isNull(), bad).otherwise(got).alias(c)

    return df.select(*[one(c) for c in df.columns])


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*[q(k).asc_nulls_last() for k in keys])

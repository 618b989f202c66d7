"""Axes: folding their layers, and expanding NULL labels over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.frames import q, union_by_name

#: An order that sorts by layer, then by row, with room for 2^40 rows a layer.
ORDER_SHIFT = 40


def order_of(depth, row):
    return F.shiftleft(depth.cast("bigint"), ORDER_SHIFT) + row.cast("bigint")


def fold_axis(frames: Sequence[tuple[int, DataFrame]], key: Sequence[str]) -> DataFrame:
    """One row a key, of the deepest layer that has it, with ``_pos``: where it was first introduced.

    ``frames`` are (depth, rows with ``_row``).  Newer rows replace content, not place.
    """
    rows = union_by_name([f.withColumn("_depth", F.lit(d)) for d, f in frames])
    rest = [c for c in rows.columns if c not in (*key, "_depth", "_row")]
    place = order_of(F.col("_depth"), F.col("_row"))
    last = F.max_by(F.struct(*map(q, rest), F.lit(0).alias("__")), F.struct("_depth", F.negative("_row")))
    out = rows.groupBy(*map(q, key)).agg(last.alias("__last"), F.min(place).alias("_pos"))
    return out.select(*map(q, key), *[F.col("__last").getField(c).alias(c) for c in rest], "_pos")


def labels_of(axis: DataFrame, dim: str) -> DataFrame:
    """One row: the distinct labels of an axis as an array."""
    return axis.agg(F.collect_set(q(dim)).alias(f"__labels_{dim}"))


def expand(df: DataFrame, dims: Sequence[str], axes: Mapping[str, DataFrame], where: Column | None = None) -> DataFrame:
    """Replace NULL in ``dims`` by a row a label, in the rows of ``where`` alone if it is given; an
    axis that is absent or empty leaves the NULL.

    The labels travel as one row, so no row is joined with an axis.
    """
    for d in dims:
        if d not in axes or d not in df.columns:
            continue
        labels = f"__labels_{d}"
        # one row, an array of an axis' labels; Spark knows that and sends it out while it is small
        df = df.crossJoin(labels_of(axes[d], d))
        wide = q(d).isNull() if where is None else q(d).isNull() & where
        each = F.explode_outer(F.when(wide, F.col(labels)).otherwise(F.array(q(d)))).alias(d)
        df = df.select(*[each if c == d else q(c) for c in df.columns if c != labels])
    return df

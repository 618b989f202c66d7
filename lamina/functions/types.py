"""Declared type names and non-finite defaults."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql.types import DataType, _parse_datatype_string

_NAMES = {
    "varchar": "string", "text": "string", "str": "string", "string": "string", "object": "string", "uuid": "string", "geometry": "string",
    "double": "double", "float64": "double", "float8": "double", "real": "float", "float": "float", "float32": "float",
    "bigint": "bigint", "int64": "bigint", "long": "bigint", "int8": "bigint", "integer": "int", "int": "int", "int32": "int", "smallint": "smallint", "tinyint": "tinyint",
    "boolean": "boolean", "bool": "boolean", "logical": "boolean", "date": "date", "blob": "binary", "binary": "binary",
    "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz", "datetime64[us]": "timestamp_ntz", "datetime64[ns]": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz", "timestamptz": "timestamp", "timestamp with time zone": "timestamp",
    "decimal": "decimal(18,3)", "numeric": "decimal(18,3)",
}


def ddl(name: str) -> str:
    """The Spark spelling of a declared type; lists, maps and sized decimals included."""
    low = " ".join(name.strip().lower().split())
    if low in _NAMES:
        return _NAMES[low]
    if low.endswith("[]"):
        return f"array<{ddl(low[:-2])}>"
    if low.startswith("map(") and low.endswith(")"):
        depth, inner = 0, low[4:-1]
        for k, c in enumerate(inner):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                return f"map<{ddl(inner[:k])},{ddl(inner[k + 1 :])}>"
    head, _, rest = low.partition("(")
    if head in ("decimal", "numeric") and rest:
        return f"decimal({rest}"
    if head == "varchar" and rest:
        return "string"
    raise ValueError(f"unknown type name: {name!r}")


def spark_type(name: str) -> DataType:
    return _parse_datatype_string(ddl(name))


def encode_default(value: Any) -> Any:
    """A JSON value; infinities and NaN become marked strings."""
    if isinstance(value, float) and not math.isfinite(value):
        return "__nan__" if math.isnan(value) else "__inf__" if value > 0 else "__-inf__"
    return value


def decode_default(value: Any) -> Any:
    return {"__nan__": math.nan, "__inf__": math.inf, "__-inf__": -math.inf}.get(value, value) if isinstance(value, str) else value

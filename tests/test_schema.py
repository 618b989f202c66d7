import math

import pytest

from lamina.functions.types import ddl, decode_default, encode_default
from lamina.schema import AttributeSpec, Dimension, Schema, SchemaError

S = Schema(
    {"snapshot": Dimension("TIMESTAMP", within="period"), "period": Dimension("BIGINT"), "scenario": Dimension(keys={"component", "connection"})},
    {"Gen": {"p": AttributeSpec(dims={"snapshot", "scenario"}), "cap": AttributeSpec("DOUBLE", math.inf)}},
    frozenset({"scenario", "period"}),
)


def test_keys_follow_from_the_declaration():
    assert S.split_dims == ("period", "scenario")
    assert S.whole_dims == ("snapshot",)
    assert S.values_key == ("name", "bus", "period", "scenario", "attribute")
    assert S.member_key == ("name", "scenario")
    assert S.link_key == ("name", "bus", "scenario")
    assert S.label_key("snapshot") == ("period", "snapshot")
    assert S.label_key("period") == ("period",)
    assert S.owned_per(S.spec("p")) == ("scenario",)
    assert S.row_columns == ("name", "bus", "snapshot", "period", "scenario", "attribute", "breakpoint", "value")
    assert S.spec("p").varying and not S.spec("cap").varying
    assert S.types_with("p") == ("Gen",) and S.value_type("unknown") == "DOUBLE"


@pytest.mark.parametrize(
    "args",
    [
        dict(attributes={"G": {"p": AttributeSpec()}}),
        dict(dimensions={"a": Dimension(within="b")}),
        dict(dimensions={"a": Dimension(within="a")}),
        dict(dimensions={"a": Dimension(within="b"), "b": Dimension(within="a")}),
        dict(dimensions={"a": Dimension()}, attributes={"G": {"p": AttributeSpec(dims={"b"})}}),
        dict(dimensions={"a": Dimension()}, partial={"b"}),
        dict(dimensions={"a": Dimension(keys={"component"})}, partial=frozenset()),
        dict(dimensions={"a": Dimension(), "A": Dimension()}),
        dict(dimensions={"name": Dimension()}),
    ],
)
def test_contradictions_are_refused(args):
    with pytest.raises(SchemaError):
        Schema(**args)


def test_an_empty_schema_is_no_manifest_yet():
    assert not Schema() and Schema().values_key == ("name", "bus", "attribute")


def test_json_round_trip_with_non_finite_defaults():
    back = Schema.from_json(S.to_json())
    assert back == S and back.spec("cap").default == math.inf
    for x in (math.inf, -math.inf):
        assert decode_default(encode_default(x)) == x
    assert math.isnan(decode_default(encode_default(math.nan)))
    with pytest.raises(SchemaError):
        Schema.from_json('{"version": 99}')


def test_compatibility():
    assert S.conflicts(S) == []
    wider = Schema({**S.dimensions, "vintage": Dimension()}, {"Gen": {**S.attributes["Gen"], "q": AttributeSpec()}}, S.partial)
    assert S.conflicts(wider) == []
    assert wider.conflicts(S)
    narrowed = Schema(S.dimensions, {"Gen": {**S.attributes["Gen"], "p": AttributeSpec(dims={"snapshot"})}}, S.partial)
    assert "lost dims" in S.conflicts(narrowed)[0]
    retyped = Schema({**S.dimensions, "period": Dimension("VARCHAR")}, S.attributes, S.partial)
    assert "changed type" in S.conflicts(retyped)[0]
    whole = Schema({**S.dimensions, "scenario": Dimension()}, S.attributes, frozenset({"scenario"}))
    assert "no longer partial" in S.conflicts(whole)[-1]


def test_type_names_of_both_spellings():
    assert [ddl(x) for x in ("VARCHAR", "str", "float64", "datetime64[us]", "DECIMAL(10,2)", "DOUBLE[]", "MAP(VARCHAR, BIGINT)")] == ["string", "string", "double", "timestamp_ntz", "decimal(10,2)", "array<double>", "map<string,bigint>"]
    with pytest.raises(ValueError):
        ddl("quaternion")

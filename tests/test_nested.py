import json

import pytest

from sunloom.operators import nested
from sunloom.plans import problems

SCHEMA = "json_id long, file_name string, site string, body string, pre int, entity string"
FULL = {
    "Site": {"location": "a", "latitude": "36.1", "longitude": ""},
    "Mount": {"Mount 1": {"tilt": 24, "azimuth": ""}, "Mount 3": {}},
    "meta": {"tags": ["x"], "note": None},
    "Inverters": {
        "Inverter 1": {"inverter_id": 7, "strings": [{"string_id": 1, "modules": [{"serial": "Q1"}, {}, {"serial": "Q3", "tests": [{"kind": "el"}]}]}, {"modules": {"serial": "M"}}]},
        "Inverter 2": {"strings": {"string_id": "A", "modules": None}},
    },
}
WANT = {
    ("mount", "Mount 1", ""), ("mount", "Mount 3", ""), ("inverter", "Inverter 1", "Mount 1"), ("inverter", "Inverter 2", ""),
    ("string", "Inverter 1/1", "Inverter 1"), ("string", "Inverter 1/#2", "Inverter 1"), ("string", "Inverter 2/A", "Inverter 2"),
    ("module", "Inverter 1/1/Q1", "Inverter 1/1"), ("module", "Inverter 1/1/#2", "Inverter 1/1"), ("module", "Inverter 1/1/Q3", "Inverter 1/1"), ("module", "Inverter 1/#2/M", "Inverter 1/#2"),
}


def variants():
    low = json.loads(json.dumps(FULL))
    upper = {"SITE": low["Site"], "MOUNT": low["Mount"], "INVERTERS": {k: {a.upper(): b for a, b in v.items()} for k, v in low["Inverters"].items()}}
    moved = {"Site": low["Site"] | {"Inverters": low["Inverters"]}, "Mount": low["Mount"]}
    listed = low | {"Inverters": [{"name": k} | v for k, v in low["Inverters"].items()]}
    text = low | {"Inverters": json.dumps(low["Inverters"]), "Mount": json.dumps(low["Mount"])}
    return [low, upper, moved, listed, text]


def found(spark, bodies):
    df = spark.createDataFrame([(i, "f", "s", b, 99, "clash") for i, b in enumerate(bodies)], SCHEMA)
    return [(r.json_id, r.entity, r.entity_key, r.parent_key) for r in nested.found(df).collect()]


def test_shapes_places_and_case(spark):
    bodies = [json.dumps(v) for v in variants()]
    got = found(spark, bodies)
    for i in range(len(bodies)):
        assert {g[1:] for g in got if g[0] == i} == WANT


def test_unreadable_bodies_have_no_rows(spark):
    deep = "[" * 100_000 + "]" * 100_000
    assert found(spark, [None, "", "null", "[]", "3", '{"Mount": {"Mount 1": {', "{}", deep, '{"Inverters": null, "Mount": 5, "Site": []}']) == []


def test_long_body_repeated_rows_and_equal_ids(spark):
    modules = [{"serial": f"S{i}"} for i in range(20_000)]
    body = json.dumps({"Inverters": {"Inverter 1": {"strings": [{"string_id": "x", "modules": modules}, {"string_id": "x"}]}}})
    got = found(spark, [body])
    assert len(got) == 1 + 2 + 20_000
    assert sum(g[1] == "string" and g[2] == "Inverter 1/x" for g in got) == 2
    df = spark.createDataFrame([(1, '{"Mount": {"Mount 1": {}}}')] * 2, "json_id long, body string")
    assert nested.found(df).count() == 2


def test_labels_nest_and_link_as_brute_force(spark):
    for v in variants():
        nodes = nested.label_body(json.dumps(v))
        spans = [(n[1], n[2]) for n in nodes]
        assert len(set(spans)) == len(spans)
        for entity, pre, post, *_ in nodes:
            holders = [m for m in nodes if m[1] < pre and m[2] > post]
            if entity == "module":
                assert sorted(m[0] for m in holders if m[0] in ("inverter", "string")) == ["inverter", "string"]


def test_flat_tables_and_empty_table(spark):
    df = spark.createDataFrame([(1, json.dumps(FULL))], "json_id long, body string")
    flat = nested.flatten_sites(df)
    assert {k: t.count() for k, t in flat.items()} == {"site": 1, "mount": 2, "inverter": 2, "string": 3, "module": 4}
    site = flat["site"].first()
    assert (site.latitude, site.longitude, site.location) == (36.1, None, "a")
    assert nested.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("value, key", [("", "#1"), (None, "#1"), (0, "0"), ("é/ü", "é/ü")])
def test_ids(value, key):
    body = json.dumps({"Inverters": [{"name": "Inverter 1", "strings": [{"string_id": value}]}]})
    assert [n[5] for n in nested.label_body(body) if n[0] == "string"] == [key]


def test_a_query_gives_the_attributes_of_all_nodes(spark, tmp_path):
    body = '{"Site": {"location": "x", "longitude": 1.5}, "Inverters": {"i": {"inverter_id": "7"}}}'
    spark.createDataFrame([(1, body)], "json_id long, body string").write.parquet(str(tmp_path / "site_json.parquet"))
    got = {r.entity: r for r in problems.QUERIES["p1_tables"](spark, str(tmp_path)).collect()}
    assert (got["site"].longitude, got["site"].location, got["inverter"].inverter_id) == (1.5, "x", "7")

import json
import random

from cairnlake.operators import nested

SCHEMA = "content_id string, node_index int, value string, parse_error string"


def brute(value):
    out = set()

    def walk(x, path, parent):
        if isinstance(x, dict):
            out.add((path, parent))
            for k, v in x.items():
                walk(v, path + "/" + k.replace("~", "~0").replace("/", "~1"), path)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(v, f"{path}/{i}", parent)

    walk(json.loads(value), "#", "")
    return out


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.3:
        return rng.choice([None, True, 1, 2.5, "x", "{}", '{"a":{}}', "a\\b\"[{"])
    if kind < 0.65:
        return {rng.choice(["a", "b/c", "d~e", "", "@type", "ü"]): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]


def test_objects_match_brute_force(spark):
    rng = random.Random(7)
    values = [json.dumps(made(rng, 6)) for _ in range(150)]
    df = spark.createDataFrame([(f"c{i}", i, v, None) for i, v in enumerate(values)], SCHEMA)
    got = {}
    for r in nested.objects(df).collect():
        got.setdefault(r.node_index, set()).add((r.obj_path, r.parent_path))
    for i, v in enumerate(values):
        assert got.get(i, set()) == brute(v), v


def test_objects_odd_rows(spark):
    deep = "[" * 60 + "{}" + "]" * 60
    df = spark.createDataFrame(
        [
            ("a", 1, '{"x":{"y":1}}', None), ("a", 1, '{"x":{"y":1}}', None),  # repeated
            ("b", 1, '{"x":{}}', "Invalid JSON syntax"),  # not to be trusted
            ("c", 1, None, None), ("d", None, "{}", None), (None, 2, "{}", None), ("e", 3, "not json", None),
            ("f", 4, '{"k":1,"k":{"z":{}}}', None),  # the last value of a repeated key holds
            ("g", 5, deep, None), ("h", 6, "", None), ("i", 7, "[1, NaN, {}]", None),
        ],
        SCHEMA,
    ).selectExpr("*", "'clash' AS obj_path", "'clash' AS found", "'clash' AS doc")
    got = {tuple(r) for r in nested.objects(df).collect()}
    assert ("a", 1, "#/x", "#") in got and ("d", None, "#", "") in got and (None, 2, "#", "") in got
    assert {g for g in got if g[0] == "f"} == {("f", 4, "#", ""), ("f", 4, "#/k", "#"), ("f", 4, "#/k/z", "#/k")}
    assert {g for g in got if g[0] == "g"} == {("g", 5, "#" + "/0" * 60, "")}
    assert ("i", 7, "#/2", "") in got
    assert not {g for g in got if g[0] in ("b", "c", "e", "h")}
    assert len(got) == nested.objects(df).count()


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    for f in (nested.objects, nested.object_types, nested.fields, nested.elements):
        assert f(df).count() == 0


def test_related_tables(spark):
    v = '{"@type":["A","B"],"n":1,"s":null,"o":{"@type":"C","t":[1,"x",{"q":2},null]}}'
    df = spark.createDataFrame([("a", 1, v, None)], SCHEMA)
    types = {(r.obj_path, r.type_no, r.obj_type) for r in nested.object_types(df).collect()}
    assert types == {("#", 0, "A"), ("#", 1, "B"), ("#/o", 0, "C")}
    fields = {(r.obj_path, r.field, r.text) for r in nested.fields(df).collect()}
    assert fields == {("#", "n", "1"), ("#", "s", None), ("#/o", "@type", "C"), ("#/o/t/2", "q", "2")}
    items = {(r.obj_path, r.field, r.place, r.text) for r in nested.elements(df).collect()}
    assert {("#/o", "t", "0", "1"), ("#/o", "t", "1", "x"), ("#/o", "t", "3", None), ("#", "@type", "0", "A")} == items - {("#", "@type", "1", "B")}


def test_scalars_of_nested_and_top_arrays(spark):
    df = spark.createDataFrame([("a", 1, '{"m":[[1,2],[3]],"k":[{"z":[[true]]}]}', None), ("b", 1, '[1,["x",[null]],{"q":["y"]}]', None)], SCHEMA)
    items = {(r.content_id, r.obj_path, r.field, r.place, r.kind, r.text) for r in nested.elements(df).collect()}
    assert items == {
        ("a", "#", "m", "0/0", "number", "1"), ("a", "#", "m", "0/1", "number", "2"), ("a", "#", "m", "1/0", "number", "3"), ("a", "#/k/0", "z", "0/0", "boolean", "true"),
        ("b", "", "", "0", "number", "1"), ("b", "", "", "1/0", "string", "x"), ("b", "", "", "1/1/0", "null", None), ("b", "#/2", "q", "0", "string", "y"),
    }


def test_documents_beyond_the_parser(spark):
    deep = '{"@type":"T","a":[' * 1100 + '"x"' + "]}" * 1100
    deeper = "[" * 60000 + '{"n":' + "7" * 2000 + "}" + "]" * 60000
    df = spark.createDataFrame([("a", 1, deep, None), ("b", 1, deeper, None), ("c", 1, deep + "]", None)], SCHEMA)
    counts = [{r.content_id: r["count"] for r in f(df).groupBy("content_id").count().collect()} for f in (nested.objects, nested.object_types, nested.fields, nested.elements)]
    assert counts == [{"a": 1100, "b": 1}, {"a": 1100}, {"a": 1100, "b": 1}, {"a": 1}]


def test_reader_without_recursion():
    rng = random.Random(8)
    for _ in range(300):
        text = json.dumps(made(rng, 5), indent=rng.choice([None, 1]))
        assert json.loads(json.dumps(nested.read_json(text))) == json.loads(text, parse_int=str, parse_float=str)
    for bad in ("", "{", "[1,]", '{"a"}', "[1 2]", "nul", '{"a":1,}', "[1]]", "01", '"a\nb'.replace("\\n", "\n")):
        try:
            nested.read_json(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_one_element_with_two_wordings(spark):
    df = spark.createDataFrame([("a", 1, '{"x":{"y":1}}', None), ("a", 1, '{"x": {"y": 2}, "z": {}}', None)], SCHEMA)
    assert sorted(r.obj_path for r in nested.objects(df).collect()) == ["#", "#/x", "#/z"]

import json

from pyspark.sql import functions as F

from driftspark.operators import jsondocs as ops


def test_split_jsonc(spark):
    texts = {
        "plain": '{"a": "x // y" /* c */} // z',
        "header": "// one\n\n  // two\n{\n  // in\n  \"a\": 1 /* b\n */ }",
        "one_blank": "\n{}",
        "escapes": '{"a": "\\" // \\\\", "b": "/* no */"}',
        "only_header": "// x",
        "broken": "{",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = {r.doc_id: r for r in ops.split_jsonc(df).withColumn("data", F.to_json("data")).collect()}
    assert rows["plain"]["json"] == '{"a": "x // y" } ' and rows["plain"].header == ""
    assert json.loads(rows["plain"].data) == {"a": "x // y"}
    assert rows["header"].header == "// one\n\n  // two\n"
    assert json.loads(rows["header"].data) == {"a": 1}
    assert rows["one_blank"].header == "" and rows["one_blank"].data == "{}"
    assert json.loads(rows["escapes"].data) == {"a": '" // \\', "b": "/* no */"}
    assert rows["only_header"].header == "// x\n" and rows["only_header"].data is None
    assert rows["broken"].data is None


CHECKED = {
    "last": ('{"a": 1, "b": {"c": 1.50, "c": [1, {"d": 1, "d": "\\ud83c\\udf89 Infinity"}]}, "a": "NaN"}', None),
    "empty_key": ('{"": 1, "": 2}', None),
    "large": ('{"a": 1, "a": 1e400, "b": ' + "9" * 5000 + "}", None),
    "unique": ('{"a": 1.50, "b": "é \U0001f389"}', None),
    "scalar": (" 12 ", None),
    "open": ("{", 1),
    "behind": ('{"é\U0001f389": 1} x', 10),
    "word": ('{"NaN": "\\"NaN", "a": NaN}', 22),
    "minus": ('["Infinity", -Infinity]', 13),
    "comma": ('{"a": 1,, "b": 2}', 8),
    "quote": ("{'a': 1}", 1),
    "line": ('{"a": "\n"}', 7),
    "deep": ("[" * 200_000, 0),
    "empty": ("", 0),
    "only_header": ("// x", 0),
    "none": (None, None),
}


def test_checked_jsonc(spark):
    rows = [(name, text, name, 1) for name, (text, _) in CHECKED.items()] + [("last", CHECKED["last"][0], "last", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, name string, _x int")
    read = ops.checked_jsonc(df).withColumn("data", F.to_json("data")).collect()
    assert len(read) == len(rows) and {"name", "_x"} <= set(read[0].asDict())
    got = {r.doc_id: r for r in read}
    for name, (text, place) in CHECKED.items():
        assert (got[name].error_at, got[name].valid) == (place, None if text is None else place is None), name
        if text is None or place is not None:
            assert got[name].data is None
        elif name not in ("large", "unique"):
            assert json.loads(got[name].data) == json.loads(text), name
    assert json.loads(got["unique"].data) == json.loads(CHECKED["unique"][0])
    assert got["large"].data is not None
    assert ops.checked_jsonc(df.limit(0)).count() == 0


CLASSES = [
    ({"enum": ["a"], "type": "boolean"}, "enum", False),
    ({"enum": None, "type": "boolean"}, "boolean", False),
    ({"type": ["null", "boolean"]}, "boolean", True),
    ({"type": "integer"}, "number", False),
    ({"type": ["number", "null"]}, "number", True),
    ({"type": "array", "items": {"type": "object"}}, "array-object", False),
    ({"type": "array", "items": {"properties": {"a": {}}}}, "array-object", False),
    ({"type": "array", "items": {"type": "string"}}, "array-scalar", False),
    ({"type": "array"}, "array-scalar", False),
    ({"type": "object", "additionalProperties": True}, "dictionary", False),
    ({"type": "object", "additionalProperties": {"type": "string"}, "properties": {}}, "dictionary", False),
    ({"type": "object", "additionalProperties": False}, "object", False),
    ({"type": "object", "additionalProperties": True, "properties": {"a": {}}}, "object", False),
    ({"type": ["object", "null"]}, "object", True),
    ({"type": "string"}, "string", False),
    ({}, "string", False),
]


def test_classify(spark):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _, _) in enumerate(CLASSES)], "i int, t string")
    out = ops.classify_json_property(df.withColumn("v", F.parse_json("t")), "v").collect()
    got = {r.i: (r["class"], r.nullable) for r in out}
    assert [got[i] for i in range(len(CLASSES))] == [(c, n) for _, c, n in CLASSES]


def nest(depth):
    node = {"type": "string", "description": "leaf"}
    for i in range(depth):
        node = {"type": "object", "properties": {f"k{i}": node, "properties": {"default": i}}}
    return node


def walk(node, prefix=""):
    for key, child in node.get("properties", {}).items():
        path = f"{prefix}.{key}" if prefix else key
        yield path, child.get("description"), child.get("default")
        yield from walk(child, path)


def test_flatten_any_depth(spark):
    docs = {"flat": {"type": "string"}, "three": nest(3), "deep": nest(30), "empty": {"properties": {}}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "id string, t string")
    rows = ops.flatten_json(df.select("id", F.parse_json("t").alias("v")), "v").collect()
    got = sorted((r.id, r.path, r.description, r.default) for r in rows)
    want = sorted(
        (k, p, d, None if x is None else json.dumps(x)) for k, v in docs.items() for p, d, x in walk(v)
    )
    assert sorted(got, key=str) == sorted(want, key=str)


def nested(n):
    return {"properties": {f"k{i}": {"type": "object", "properties": {"leaf": {"type": ["string", "null"]}}} for i in range(n)}}


def flat_rows(spark, document):
    docs = spark.createDataFrame([(json.dumps(document),)], "text string").select(F.parse_json("text").alias("doc"))
    return ops.flatten_json(docs, "doc")


def test_many_nested_objects(spark):
    rows = flat_rows(spark, nested(4000)).groupBy("class", "nullable").count().collect()
    assert {(r["class"], r.nullable): r["count"] for r in rows} == {("object", False): 4000, ("string", True): 4000}


def test_deep_objects_and_braces_in_strings(spark):
    document = {"type": "integer", "description": "}{ \" {{{"}
    for _ in range(60):
        document = {"properties": {"a{\"}": document}}
    rows = flat_rows(spark, document).collect()
    assert max(r.path.count(".") for r in rows) == 59 and len(rows) == 60

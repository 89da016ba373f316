from driftspark.operators import settings as ops


def test_parse_kv(spark):
    df = spark.createDataFrame(
        [(1, "Host=a;Port=1;Host=b;bad;=x; Password = a=b ;"), (2, ""), (3, None), (4, "A=;a=1")],
        "id int, conn string",
    )
    rows = sorted(tuple(r) for r in ops.parse_kv(df, "conn").collect())
    assert rows == [
        (1, 0, "Host", "b"), (1, 1, "Port", "1"), (1, 3, "Password", "a=b"), (4, 0, "A", ""), (4, 1, "a", "1"),
    ]


def test_extract_file_refs(spark):
    df = spark.createDataFrame(
        [(1, " ./p.json --optional ./d.json --x y ./e.json --optional z ./f.json"), (2, "a b"),
         (3, "--optional --a.json b.json --optional a.json c.json"), (4, None)],
        "id int, cmd string",
    )
    rows = sorted((r.id, r.pos, r.path, r.optional) for r in ops.extract_file_refs(df, "cmd").collect())
    assert rows == [
        (1, 0, "./p.json", False), (1, 1, "./d.json", True), (1, 2, "./e.json", False),
        (1, 3, "./f.json", True),
        (3, 0, "b.json", False), (3, 1, "a.json", True), (3, 2, "c.json", False),
    ]


def test_resolve_placeholders(spark):
    templates = spark.createDataFrame(
        [(1, "{A}/{B}"), (2, "{"), (3, "no braces"), (4, ""), (5, "{a{b} {} {A}{A}x{N}"), (6, None),
         (7, "{Z} then\n{Y}{Z}")],
        "id int, template string",
    )
    dictionary = spark.createDataFrame([("A", "1"), ("N", ""), ("a{b", "odd")], "key string, value string")
    rows = {r.id: (r.resolved, r.unresolved) for r in
            ops.resolve_placeholders(templates, dictionary, "template").collect()}
    assert rows == {
        1: ("1/{B}", ["B"]), 2: ("{", []), 3: ("no braces", []), 4: ("", []),
        5: ("odd {} 11x", []), 6: (None, []), 7: ("{Z} then\n{Y}{Z}", ["Z", "Y", "Z"]),
    }


def test_layered_merge(spark):
    layers = spark.createDataFrame(
        [(0, "tools", "psql", "psql"), (1, "tools", "psql", "/bin/psql"), (2, "tools", "psql", ""),
         (0, "", "verbose", "true"), (1, "", "verbose", "false"), (0, "project", "schemas", "[]")],
        "layer_rank int, section string, key string, value string",
    )
    rows = {(r.section, r.key): (r.value, r.layer_rank) for r in ops.layered_merge(layers).collect()}
    assert rows == {
        ("tools", "psql"): ("", 2), ("", "verbose"): ("false", 1), ("project", "schemas"): ("[]", 0),
    }


def test_missing_keys(spark):
    expected = spark.createDataFrame([("", "a", 1), ("s", "b", 2), ("s", "c", 3)], "section string, key string, pos int")
    existing = spark.createDataFrame([("s", "b"), ("s", "b"), ("", "z")], "section string, key string")
    rows = sorted(tuple(r) for r in ops.missing_keys(expected, existing).collect())
    assert rows == [("", "a", 1), ("s", "c", 3)]


def test_first_seen(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 5, None)], "path string, pos int, x string")
    rows = sorted(tuple(r) for r in ops.first_seen(df, ["path"], "pos").collect())
    assert rows == [("a", 1, "first"), ("b", 5, None)]


def test_outdated(spark):
    installed = spark.createDataFrame(
        [("a", "3.10.0.0"), ("b", "3.9.1"), ("c", "4.0"), ("d", "1.0.0")], "name string, installed string"
    )
    latest = spark.createDataFrame([("a", "v3.10.0"), ("b", "3.10.0"), ("c", "3.9.9")], "name string, latest string")
    rows = {r.name: r.status for r in ops.outdated(installed, latest).collect()}
    assert rows == {"a": "latest", "b": "update", "c": None, "d": None}


def test_ties_are_decided_by_values(spark):
    rows = [("s", "k", 1, v) for v in ("b", "a", None, "c")] + [("s", "k", 0, "z"), ("s", "n", None, "x")]
    layers = spark.createDataFrame(rows, "section string, key string, layer_rank int, value string").repartition(4)
    assert {(r.key, r.value) for r in ops.layered_merge(layers).collect()} == {("k", "c"), ("n", None)}
    seen = spark.createDataFrame([(1, 5, "b", {"x": 1}), (1, 5, "a", {"x": 2}), (1, 6, "0", {}), (2, None, "q", {})], "k int, o int, v string, m map<string,int>")
    assert {(r.k, r.v) for r in ops.first_seen(seen.repartition(4), ["k"], "o").where("k = 1").collect()} == {(1, "a")}

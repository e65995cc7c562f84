"""Mappings, property schemas, providers, mutations, strategies, plans and streams."""

import json

import pytest
from graphs import link, modern, stations, typed
from pyspark.sql import functions as F

from weftgraph import Graph, T, __, eq, gt, within
from weftgraph.functions.scalars import math_column, math_names
from weftgraph.sources.interpolate import interpolate
from weftgraph.sources.properties import BUILDERS, Static, build, register
from weftgraph.sources.providers import load


def vals(t):
    return sorted(t.toList(), key=str)


def one(spark, properties, rows, schema, **more):
    config = {"vertices": [{"table": "t", "id": "@id", "label": "x", "properties": properties, **more}]}
    return Graph.of(spark, config, {"t": spark.createDataFrame(rows, schema)}).traversal()


def test_interpolation():
    env = {"A": "1", "B": "2"}
    assert interpolate({"x": ["${A}-${B}", {"y": "${C:-d}"}], "z": "${C:-}", "n": 3}, env) == {"x": ["1-2", {"y": "d"}], "z": "", "n": 3}
    assert interpolate("${bad name} $A ${", env) == "${bad name} $A ${"
    with pytest.raises(KeyError, match="file.json: MISSING"):
        interpolate("${MISSING}", env, "file.json")


def test_concatenate(spark):
    rows = [("1", "marko", 29), ("2", "a_b", 3), ("3", "lop", None)]
    g = one(spark, {"name_age": {"fields": ["@name", "@age"], "delimiter": "_"}}, rows, "id string, name string, age int")
    assert vals(g.V().values("name_age")) == ["a_b_3", "marko_29"]
    assert vals(g.V().has("name_age", "marko_29").id()) == ["1"]
    assert vals(g.V().has("name_age", "a_b_3").id()) == ["2"]  # a part holds the delimiter
    assert g.V().has("name_age", "marko").count().next() == 0
    assert vals(g.V().has("name_age", within("marko_29", "a_b_3")).id()) == ["1", "2"]


def test_other_schemas(spark):
    rows = [("1", "F", None, "b"), ("2", "O", "a", None), ("3", None, None, None)]
    properties = {"state": {"field": "s", "alias": {"F": "final"}}, "either": {"fields": ["@p", "@q"], "type": "coalesce"}, "both": ["@p", "@q"], "fixed": "k", "again": "$fixed"}
    g = one(spark, properties, rows, "id string, s string, p string, q string")
    assert vals(g.V().values("state")) == ["O", "final"]
    assert vals(g.V().has("state", "final").id()) == ["1"] and g.V().has("state", "F").count().next() == 0
    assert vals(g.V().values("either")) == ["a", "b"]
    assert vals(g.V().has("either", "b").id()) == ["1"]
    assert vals(g.V().values("both")) == ["a", "b"] and vals(g.V().has("both", "a").id()) == ["2"]
    assert g.V().has("fixed", "k").count().next() == 3 and g.V().has("fixed", "other").count().next() == 0
    assert g.V().has("again", "k").count().next() == 3
    assert g.V().has("unmapped", "x").count().next() == 0


def test_include_exclude_nullable(spark):
    rows = [("1", "person", None), ("2", "dog", "x"), ("3", None, "y")]
    df = spark.createDataFrame(rows, "id string, kind string, n string")
    make = lambda label, **p: Graph.of(spark, {"vertices": [{"table": "t", "id": "@id", "label": label, "properties": p}]}, {"t": df}).traversal()
    assert vals(make({"field": "kind", "include": ["person"]}).V().id()) == ["1"]
    assert vals(make({"field": "kind", "exclude": ["person"]}).V().id()) == ["2"]
    assert make({"field": "kind", "include": ["person"]}).V().hasLabel("dog").count().next() == 0
    assert vals(make("x", n={"field": "n", "nullable": False}).V().id()) == ["2", "3"]


def test_json_uuid_enum(spark):
    rows = [("1", '{"address": {"city": "NYC"}, "n": 7}', "ABCDEF00-0000-0000-0000-000000000001", "active"), ("2", "[1]", None, "inactive")]
    properties = {"data": {"field": "data", "type": "jsonb"}, "ref": {"field": "ref", "type": "uuid"}, "status": {"field": "status", "type": "enum"}}
    g = one(spark, properties, rows, "id string, data string, ref string, status string")
    assert vals(g.V().has("data.address.city", "NYC").id()) == ["1"]
    assert g.V().has("data.n", "7").count().next() == 1
    assert g.V().values("data").count().next() == 1  # not an object: no property
    assert g.V().has("ref", "abcdef00-0000-0000-0000-000000000001").count().next() == 1
    assert g.V().has("ref", "ABCDEF00-0000-0000-0000-000000000001").count().next() == 1
    assert vals(g.V().has("status", "inactive").id()) == ["2"]


def test_dynamic_properties(spark):
    g = one(spark, {"n": "@name"}, [("1", "a", 5, 6)], "id string, name string, p int, q int", dynamicProperties={"excludeFields": ["q"]})
    assert g.V().df().columns == ["id", "label", "n", "p"]
    assert g.V().has("p", 5).count().next() == 1 and g.V().has("q", 6).count().next() == 0


def test_inner_edges(spark):
    rows = [("1", "person", "marko", None, None, None), ("2", "person", "vadas", "1", "7", 0.5), ("3", "software", "lop", None, None, None)]
    df = spark.createDataFrame(rows, "id string, label string, name string, knownby string, edgeid string, edgeweight double")
    inner = {"id": "@edgeid", "label": "knows", "direction": "IN", "properties": {"weight": "@edgeweight"}, "vertex": {"ref": True, "id": {"field": "knownby", "nullable": False}, "label": "person"}}
    config = {"vertices": [{"table": "v", "id": "@id", "label": {"field": "label", "include": ["person"]}, "properties": {"name": "@name"}, "edges": [inner]}, {"table": "v", "id": "@id", "label": {"field": "label", "exclude": ["person"]}, "properties": {"name": "@name"}}]}
    g = Graph.of(spark, config, {"v": df}).traversal()
    assert g.V().count().next() == 3 and g.E().count().next() == 1
    assert vals(g.V("1").out("knows").values("name")) == ["vadas"]
    assert vals(g.V("2").in_("knows").values("name")) == ["marko"]
    assert g.V("1").outE("knows").values("weight").next() == 0.5


def test_inner_edges_after_mutation(spark):
    df = spark.createDataFrame([("1", "a", "2"), ("2", "b", None)], "id string, name string, up string")
    inner = {"id": "@id", "label": "up", "direction": "OUT", "vertex": {"ref": True, "id": "@up", "label": "n"}}
    g = Graph.of(spark, {"vertices": [{"table": "t", "id": "@id", "label": "n", "properties": {"name": "@name"}, "edges": [inner]}]}, {"t": df}).traversal()
    assert g.V("1").out("up").values("name").toList() == ["b"] and g.V("2").in_("up").values("name").toList() == ["a"]
    g.E("1").drop().iterate()
    assert g.V("1").out("up").count().next() == 0 and g.V("2").in_("up").count().next() == 0 and g.V().count().next() == 2


def test_full_endpoint(spark):
    df = spark.createDataFrame([("1", "marko", "3", "lop", "e1"), ("2", "josh", "3", "lop", "e2")], "id string, name string, sid string, sname string, eid string")
    inner = {"id": "@eid", "label": "created", "direction": "OUT", "vertex": {"ref": False, "id": "@sid", "label": "software", "properties": {"name": "@sname"}}}
    g = Graph.of(spark, {"vertices": [{"table": "v", "id": "@id", "label": "person", "properties": {"name": "@name"}, "edges": [inner]}]}, {"v": df}).traversal()
    assert vals(g.V().hasLabel("software").values("name")) == ["lop"]
    assert g.V().out("created").has("name", "lop").count().next() == 2


def test_nested_items(spark, tmp_path):
    docs = [{"_id": "1", "name": "marko", "creations": [{"creationId": "9", "weight": 0.4, "softwareId": "3", "name": "lop", "lang": "java"}]}, {"_id": "4", "name": "josh", "creations": [{"creationId": "10", "weight": 1.0, "softwareId": "5", "name": "ripple", "lang": "java"}, {"creationId": "11", "weight": 0.4, "softwareId": "3", "name": "lop", "lang": "java"}]}, {"_id": "2", "name": "vadas"}]
    (tmp_path / "person.json").write_text("\n".join(map(json.dumps, docs)))
    edge = {"path": "creations", "id": "@creationId", "label": "created", "direction": "OUT", "properties": {"weight": "@weight"}, "vertex": {"ref": False, "id": "@softwareId", "label": "software", "properties": {"name": "@name", "lang": "@lang"}}}
    config = {"class": "documents", "path": str(tmp_path), "vertices": [{"index": "person", "id": "@_id", "label": "person", "properties": {"name": "@name"}, "edges": [edge]}]}
    g = Graph.of(spark, config).traversal()
    assert g.E().hasLabel("created").count().next() == 3
    assert vals(g.V("4").out("created").values("name")) == ["lop", "ripple"]
    assert vals(g.V("3").in_("created").values("name")) == ["josh", "marko"]
    assert vals(g.V().hasLabel("software").values("name")) == ["lop", "ripple"]


def test_rest_resources(spark, tmp_path):
    hits = lambda rows: json.dumps({"hits": {"hits": [{"_source": r} for r in rows]}})
    (tmp_path / "vertex.json").write_text(hits([{"id": "1", "type": "person", "name": "marko", "age": 29}, {"id": "3", "type": "software", "name": "lop", "lang": "java"}]))
    (tmp_path / "edge.json").write_text(hits([{"id": "9", "type": "created", "outid": "1", "outlabel": "person", "inid": "3", "inlabel": "software", "weight": 0.4}]))
    end = lambda s: {"ref": True, "id": f"@_source.{s}id", "label": f"@_source.{s}label"}
    config = {"class": "RestSourceProvider", "path": str(tmp_path), "resultPath": "hits.hits", "vertices": [{"resource": "vertex", "id": "@_source.id", "label": "@_source.type", "properties": {"name": "@_source.name", "age": "@_source.age"}}], "edges": [{"resource": "edge", "id": "@_source.id", "label": "@_source.type", "properties": {"weight": "@_source.weight"}, "outVertex": end("out"), "inVertex": end("in")}]}
    g = Graph.of(spark, config).traversal()
    assert vals(g.V().out("created").values("name")) == ["lop"]
    assert g.V().has("person", "age", gt(20)).count().next() == 1


def test_folder_of_providers(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("WHERE", str(tmp_path / "data"))
    spark.createDataFrame([("1", "a")], "id string, name string").write.csv(str(tmp_path / "data" / "n.csv"), header=True)
    spark.createDataFrame([("2", "b")], "id string, name string").write.parquet(str(tmp_path / "data" / "m.parquet"))
    for kind, table in (("csv", "n"), ("parquet", "m")):
        (tmp_path / f"{kind}.json").write_text(json.dumps({"class": kind, "path": "${WHERE}", "vertices": [typed(table, table, name="name")]}))
    graph = Graph.open(spark, str(tmp_path))
    assert vals(graph.traversal().V().values("name")) == ["a", "b"]
    assert len(load(str(tmp_path))) == 2
    assert graph.reload().traversal().V().count().next() == 2


def test_extension_points(spark):
    register(lambda c, others: Static("extra") if c == "!extra" else None)
    try:
        assert build("!extra") == Static("extra")
        g = one(spark, {"e": "!extra"}, [("1",)], "id string")
        assert g.V().values("e").next() == "extra"
    finally:
        BUILDERS.pop()
    graph = modern(spark).graph
    graph.traversal_filter = lambda mapping, predicates: mapping.name != "edges"
    assert graph.traversal().E().count().next() == 0 and graph.traversal().V().count().next() == 6


def test_mutations(spark, tmp_path):
    g = modern(spark)
    g.addV("person").property("id", "20").property("name", "ann").iterate()
    g.addV("person").property("id", "20").property("name", "other").iterate()  # there already
    assert vals(g.V("20").values("name")) == ["ann"]
    g.addE("knows").from_(__.V("1")).to(__.V("20")).property("weight", 2.0).iterate()
    assert "ann" in g.V("1").out("knows").values("name").toList()
    g.V("2").property("age", 99).property("name", "V").iterate()
    assert vals(g.V("2").values("name", "age")) == ["99", "V"]
    g.V("2").property("age", None).iterate()
    assert g.V("2").values("age").toList() == []
    g.V("3").drop().iterate()
    assert g.V("3").count().next() == 0 and g.V().out("created").count().next() == 1
    g.E("8").drop().iterate()
    assert g.V("1").out("knows").count().next() == 2
    g.mergeV({"label": "person", "name": "ann"}).onMatch({"age": 5}).iterate()
    g.mergeV({"label": "person", "id": "30", "name": "bob"}).onCreate({"age": 6}).iterate()
    assert g.V().has("name", "ann").values("age").next() == 5 and g.V("30").values("age").next() == 6
    g.mergeE({"label": "knows", "out": ("person", "20"), "in": ("person", "30")}).iterate()
    g.mergeE({"label": "knows", "out": ("person", "20"), "in": ("person", "30")}).iterate()
    assert g.V("20").out("knows").count().next() == 1
    g.graph.commit(str(tmp_path))
    assert len(list(tmp_path.iterdir())) == len(g.graph.vertices) + len(g.graph.edges)


def test_strategies(spark):
    g = modern(spark)
    with pytest.raises(PermissionError):
        g.withReadOnly().addV("x").iterate()
    assert g.withSubgraph(__.hasLabel("person")).V().count().next() == 4
    assert g.withSubgraph(None, __.has("weight", gt(0.45))).V("1").out().count().next() == 2
    assert g.withPartition("lang", "java").V().count().next() == 2
    assert g.withSideEffect("x", 7).V("1").cap("x").next() == 7


def test_profile(spark):
    rows = {r["source"]: r["rows"] for r in modern(spark).V().hasLabel("person").profile().collect()}
    assert rows == {"vertices": 4}


def plan(t):
    return t.df()._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    for name, rows, schema in (("host", [(1, "a", 1), (2, "b", 2)], "id long, name string, rack long"), ("person", [(1, "c")], "id long, name string"), ("rack", [(1, "r")], "id long, name string"), ("own", [(1, 1, 1)], "id long, src_id long, dst_id long")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    host = typed("host", "host", name="name") | {"edges": [{"id": "@id", "label": "in_rack", "direction": "OUT", "vertex": {"ref": True, "id": "@rack", "label": "rack"}}]}
    config = {"class": "parquet", "path": str(tmp_path), "vertices": [host, typed("person", "person", name="name"), typed("rack", "rack", name="name")], "edges": [link("owns", "own", "host", "person")]}
    g = Graph.of(spark, config).traversal()
    found = plan(g.V("host", 1).values("name"))
    assert found.count("FileScan") == 1 and "EqualTo(id,1)" in found and "rack" not in found.partition("ReadSchema")[2]
    assert plan(g.V().hasLabel("host").out("in_rack").count()).count("FileScan") == 1  # the row holds the edge
    assert plan(g.V().hasLabel("rack").in_("in_rack").has("name", "a").values("name")).count("FileScan") == 2  # the far row, once
    assert "EqualTo(name,a)" in plan(g.V().hasLabel("rack").in_("in_rack").has("name", "a").count())
    assert g.V().hasLabel("rack").in_("in_rack").values("name").toList() == ["a"]
    assert plan(g.V().hasLabel("host").out("owns").count()).count("FileScan") == 2  # no person table
    assert plan(g.V().hasLabel("host").out("owns").values("name")).count("FileScan") == 3
    assert "LeftSemi" in plan(g.V().hasLabel("host").where(__.out("owns")).id())
    assert "LeftAnti" in plan(g.V().hasLabel("host").not_(__.out("owns")).id())
    assert "TakeOrderedAndProject" in plan(g.V().hasLabel("host").order().by("name").limit(2).id())
    assert "EqualTo(name,x)" in plan(g.V().hasLabel("host").out("owns").has("name", "x").count())


def test_stream(spark, tmp_path):
    from weftgraph.streaming.edges import stream_graph, windowed_counts

    schema = "id string, src_id string, dst_id string, at timestamp"
    spark.createDataFrame([("e1", "n1", "n2"), ("e2", "n2", "n1"), ("e3", "n1", "gone")], "id string, src_id string, dst_id string").withColumn("at", F.lit("2024-01-01 00:00:30").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    nodes = spark.createDataFrame([("n1", "a"), ("n2", "b")], "id string, name string")
    config = {"vertices": [typed("node", "nodes", name="name")], "edges": [link("link", "links", "node", "node")]}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    g = stream_graph(spark, config, {"nodes": nodes}, {"links": stream}).traversal()
    out = g.E().hasLabel("link").inV().values("name").df()
    assert out.isStreaming
    run = out.writeStream.format("memory").queryName("names").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r[0] for r in spark.table("names").collect()) == ["a", "b"]
    counts = windowed_counts(stream, "at", ["src_id"], "1 minute", "1 minute")
    run = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted((r["src_id"], r["cnt"]) for r in spark.table("counts").collect()) == [("n1", 2), ("n2", 1)]


def test_arithmetic(spark):
    df = spark.range(1).select(F.lit(3.0).alias("a"), F.lit(2.0).alias("b"))
    for text, value in (("a + b * 2", 7.0), ("(a + b) * 2", 10.0), ("a ^ b ^ 1", 9.0), ("-a + b", -1.0), ("sqrt(a * a)", 3.0), ("pow(a, b) % 4", 1.0), ("a / b - 0.5", 1.0)):
        assert df.select(math_column(text, {"a": F.col("a"), "b": F.col("b")})).first()[0] == pytest.approx(value), text
    assert math_names("a + sin(b) * a") == ["a", "b"]
    for bad in ("a +", "a b", "(a", "a $ b", ""):
        with pytest.raises((ValueError, KeyError, IndexError)):
            math_column(bad, {"a": F.col("a"), "b": F.col("b")})


def test_anonymous_and_errors(spark):
    g = stations(spark)
    assert [s.name for s in __.out("x").as_("y").in_().steps] == ["out", "in"]
    with pytest.raises(AttributeError):
        g.V().no_such_step()
    with pytest.raises(TypeError):
        g.V().values("name").out().df()
    assert g.V().has(T.id, "s1").count().next() == 1
    assert g.V().has("name", eq("ash")).hasNext()


def test_jdbc(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string").write.format("jdbc").options(url=url, driver=driver, dbtable="hosts").save()
    config = {"class": "JdbcSourceProvider", "driver": driver, "address": [url], "vertices": [typed("host", "hosts", name="name")]}
    g = Graph.of(spark, config).traversal()
    assert vals(g.V().values("name")) == ["a", "b"]
    found = g.V("host", 2).values("name")
    assert found.toList() == ["b"]
    assert "EqualTo(ID,2)" in plan(found) or "EqualTo(id,2)" in plan(found)  # the database filters

"""Small graphs that tests share."""

from weftgraph import Graph

REF = {"ref": True}

GENERIC = {
    "vertices": [{"table": "vertices", "id": "@id", "label": "@label", "properties": {}, "dynamicProperties": True}],
    "edges": [
        {
            "table": "edges",
            "id": "@id",
            "label": "@label",
            "dynamicProperties": True,
            "outVertex": {"ref": True, "id": "@outid", "label": "@outlabel"},
            "inVertex": {"ref": True, "id": "@inid", "label": "@inlabel"},
        }
    ],
}


def modern(spark):
    """Six vertices and six edges: who knows whom and created what."""
    people = [("1", "person", "marko", 29, None), ("2", "person", "vadas", 27, None), ("4", "person", "josh", 32, None), ("6", "person", "peter", 35, None), ("3", "software", "lop", None, "java"), ("5", "software", "ripple", None, "java")]
    edges = [("7", "knows", "1", "person", "2", "person", 0.5), ("8", "knows", "1", "person", "4", "person", 1.0), ("9", "created", "1", "person", "3", "software", 0.4), ("10", "created", "4", "person", "5", "software", 1.0), ("11", "created", "4", "person", "3", "software", 0.4), ("12", "created", "6", "person", "3", "software", 0.2)]
    tables = {"vertices": spark.createDataFrame(people, "id string, label string, name string, age int, lang string"), "edges": spark.createDataFrame(edges, "id string, label string, outid string, outlabel string, inid string, inlabel string, weight double")}
    return Graph.of(spark, GENERIC, tables).traversal()


def typed(label, table, key="id", **properties):
    return {"table": table, "id": f"@{key}", "label": label, "properties": {k: f"@{v}" for k, v in properties.items()}}


def link(label, table, out, in_):
    end = lambda side, one: {"ref": True, "id": f"@{side}_id", "label": one or f"@{side}_label"}
    return {"table": table, "id": "@id", "label": label, "properties": {}, "dynamicProperties": True, "outVertex": end("src", out), "inVertex": end("dst", in_)}


ALLIANCE = "0a1b2c3d-0000-4000-8000-00000000beef"


def flights(spark):
    """Four ports of one alliance: a chain of three flights and one that skips a port."""
    ports = spark.createDataFrame([(x, "port", ALLIANCE) for x in ("ams", "osl", "rom", "lis")], "code string, kind string, alliance string")
    legs = [("f1", "ams", "osl"), ("f2", "osl", "rom"), ("f3", "ams", "rom"), ("f4", "rom", "lis")]
    flown = spark.createDataFrame([(i, "flies", a, "port", b, "port", ALLIANCE) for i, a, b in legs], "id string, label string, src_id string, src_label string, dst_id string, dst_label string, alliance string")
    vertex = {"table": "ports", "id": "@code", "label": "@kind", "properties": {"alliance": {"field": "alliance", "type": "uuid"}}}
    return Graph.of(spark, {"vertices": [vertex], "edges": [link("flies", "flown", None, None)]}, {"ports": ports, "flown": flown}).traversal()


def boxes(spark):
    """Boxes that hold boxes and jars: targets of two kinds."""
    box = spark.createDataFrame([("crate", "full", "walnut", 9), ("b1", "full", "amber", 2), ("b2", "empty", "birch", 3), ("b3", "full", "cedar", 4)], "id string, state string, name string, size int")
    jar = spark.createDataFrame([("j1", "full", "dill"), ("j2", "empty", "elder"), ("j3", "full", "fennel")], "id string, state string, name string")
    rows = [("k1", "crate", "b1", "box"), ("k2", "crate", "b2", "box"), ("k3", "crate", "b3", "box"), ("k4", "crate", "j1", "jar"), ("k5", "crate", "j2", "jar"), ("k6", "b1", "j3", "jar"), ("k7", "b3", "j1", "jar")]
    holds = spark.createDataFrame([(i, a, "box", b, kind) for i, a, b, kind in rows], "id string, src_id string, src_label string, dst_id string, dst_label string")
    config = {"vertices": [typed("box", "box", state="state", name="name", size="size"), typed("jar", "jar", state="state", name="name")], "edges": [link("holds", "holds", None, None)]}
    return Graph.of(spark, config, {"box": box, "jar": jar, "holds": holds}).traversal()


def stations(spark):
    """ash leads to bay and cove, cove to dell and elm."""
    stops = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate("ash bay cove dell elm".split(), 1)], "id string, name string")
    rails = spark.createDataFrame([("r1", "s1", "s2"), ("r2", "s1", "s3"), ("r3", "s3", "s4"), ("r4", "s3", "s5")], "id string, src_id string, dst_id string")
    config = {"vertices": [typed("stop", "stops", name="name")], "edges": [link("rail", "rails", "stop", "stop")]}
    return Graph.of(spark, config, {"stops": stops, "rails": rails}).traversal()


def ring(spark, n=90):
    stops = spark.createDataFrame([(f"c{i}", f"x{i}") for i in range(n)], "id string, name string")
    rails = spark.createDataFrame([(f"t{i}", f"c{i}", f"c{(i + 1) % n}") for i in range(n)], "id string, src_id string, dst_id string")
    config = {"vertices": [typed("stop", "stops", name="name")], "edges": [link("rail", "rails", "stop", "stop")]}
    return Graph.of(spark, config, {"stops": stops, "rails": rails}).traversal()


def waters(spark):
    rivers = spark.createDataFrame([(f"r{i}", n) for i, n in enumerate("aar bug cam don ebro fal".split(), 1)], "id string, name string")
    lakes = spark.createDataFrame([(f"l{i}", n) for i, n in enumerate("garda huron".split(), 1)], "id string, name string")
    return Graph.of(spark, {"vertices": [typed("river", "rivers", name="name"), typed("lake", "lakes", name="name")]}, {"rivers": rivers, "lakes": lakes}).traversal()

"""Contracts of the traversal engine on small graphs."""

import pytest
from graphs import ALLIANCE, boxes, flights, link, modern, ring, stations, typed, waters

from weftgraph import Date, Graph, T, Text, TextP, __, between, desc, eq, exists, gt, gte, inside, keys, local, lt, lte, neq, outside, type_of, values, within, without


def vals(t):
    return sorted(t.toList(), key=str)


@pytest.fixture(scope="module")
def g(spark):
    return modern(spark)


def test_scans(g):
    assert g.V().count().next() == 6
    assert g.E().count().next() == 6
    assert vals(g.V("1", "2").values("name")) == ["marko", "vadas"]
    assert vals(g.V(1, [2]).values("name")) == ["marko", "vadas"]
    assert g.V().hasLabel("nobody").count().next() == 0
    assert vals(g.V().label().dedup()) == ["person", "software"]
    assert vals(g.inject(1, 2, 3)) == [1, 2, 3]
    assert g.V("1").df().columns[:2] == ["id", "label"]


def test_a_labelled_filter_is_part_of_the_scan(g):
    both = g.V().has("name", "marko").as_("a").out("knows").hasLabel("person").as_("b").has("age", gt(30)).select("a", "b").by("name")
    assert [(r["a"], r["b"]) for r in both.df().collect()] == [("marko", "josh")]
    opened = []
    tables = {"cats": "id long, name string", "dogs": "id long, weight double"}
    config = {"vertices": [{"table": t, "id": "@id", "label": t, "dynamicProperties": False, "properties": {c: f"@{c}" for c in ("name", "weight") if c in s}} for t, s in tables.items()]}
    graph = Graph.of(g.graph.spark, config, {t: g.graph.spark.createDataFrame([], s) for t, s in tables.items()})
    for m in graph.vertices:
        m.df = lambda df=m.df, name=m.name: opened.append(name) or df
    assert graph.traversal().V().hasLabel("cats").as_("x").select("x").by("name").toList() == []
    assert opened == ["cats"]


def test_mid_traversal_scan(g):
    assert g.V().hasLabel("software").V().hasLabel("person").count().next() == 8


@pytest.mark.parametrize(
    ("p", "names"),
    [
        (eq(29), ["marko"]), (neq(29), ["josh", "peter", "vadas"]), (gt(29), ["josh", "peter"]), (gte(29), ["josh", "marko", "peter"]), (lt(29), ["vadas"]), (lte(29), ["marko", "vadas"]),
        (between(27, 32), ["marko", "vadas"]), (inside(27, 35), ["josh", "marko"]), (outside(28, 32), ["peter", "vadas"]), (within(27, 35), ["peter", "vadas"]), (within([]), []), (without(27, 35), ["josh", "marko"]),
        (without([]), ["josh", "marko", "peter", "vadas"]), (gt(29).negate(), ["marko", "vadas"]), (eq("29"), ["marko"]), (eq("old"), []), (neq("old"), ["josh", "marko", "peter", "vadas"]),
        (lt(28).or_(gt(34)), ["peter", "vadas"]), (gt(27).and_(lt(35)), ["josh", "marko"]), (exists(), ["josh", "marko", "peter", "vadas"]), (type_of("int"), ["josh", "marko", "peter", "vadas"]), (type_of("string"), []),
    ],
)
def test_number_predicates(g, p, names):
    assert vals(g.V().has("age", p).values("name")) == names


@pytest.mark.parametrize(
    ("p", "names"),
    [
        (TextP.startingWith("ma"), ["marko"]), (TextP.endingWith("o"), ["marko"]), (TextP.containing("o"), ["josh", "lop", "marko"]), (TextP.regex("^.o"), ["josh", "lop"]), (TextP.notContaining("o"), ["peter", "ripple", "vadas"]),
        (TextP.notStartingWith("ma"), ["josh", "lop", "peter", "ripple", "vadas"]), (TextP.notEndingWith("o"), ["josh", "lop", "peter", "ripple", "vadas"]), (TextP.notRegex("^.o"), ["marko", "peter", "ripple", "vadas"]),
        (Text.like("*o*"), ["josh", "lop", "marko"]), (Text.like("l?p"), ["lop"]), (Text.unlike("*o*"), ["peter", "ripple", "vadas"]), (Text.regexp("[jl]o.*"), ["josh", "lop"]), (Text.regexp("o"), []), (Text.unregexp("[jl]o.*"), ["marko", "peter", "ripple", "vadas"]),
        (Text.prefix("pe"), ["peter"]), (Text.unprefix("pe"), ["josh", "lop", "marko", "ripple", "vadas"]), (Text.fuzzy("marco"), ["marko"]), (Text.like("100%_"), []),
    ],
)
def test_text_predicates(g, p, names):
    assert vals(g.V().has("name", p).values("name")) == names


def test_null_and_missing(g):
    assert g.V().has("age", None).count().next() == 0
    assert g.V().has("no_such_key", 1).count().next() == 0
    assert g.V().hasNot("no_such_key").count().next() == 6
    assert vals(g.V().hasNot("age").values("name")) == ["lop", "ripple"]
    assert g.V().has("age").count().next() == 4
    assert vals(g.V().has("person", "name", "josh").id()) == ["4"]


def test_hops(g):
    assert vals(g.V().has("name", "marko").out().id()) == ["2", "3", "4"]
    assert vals(g.V().out().id()) == ["2", "3", "3", "3", "4", "5"]
    assert vals(g.V("3").in_("created").values("name")) == ["josh", "marko", "peter"]
    assert g.V().both().count().next() == 12
    assert g.V().bothE().count().next() == 12
    assert g.V("1").outE("knows").has("weight", gt(0.6)).inV().values("name").toList() == ["josh"]
    assert vals(g.E("9").bothV().values("name")) == ["lop", "marko"]
    assert vals(g.V("4").bothE().otherV().values("name")) == ["lop", "marko", "ripple"]
    assert g.E("9").otherV().count().next() == 0
    assert vals(g.V("1").out("knows", "created").hasLabel("software").values("name")) == ["lop"]


def test_adjacency(spark):
    g = flights(spark)
    assert g.V("ams").out("flies").has("alliance", ALLIANCE.upper()).count().next() == 2
    assert g.V("ams").out("flies").has("alliance", "x").count().next() == 0
    assert g.E().outV().has("alliance", ALLIANCE).count().next() == 4
    assert g.V().both("flies").has("alliance", ALLIANCE).count().next() == 8
    assert g.V().bothE("flies").otherV().has("alliance", ALLIANCE).count().next() == 8
    p = g.withPartition("alliance", ALLIANCE)
    assert p.V("ams").out("flies").count().next() == 2
    assert g.withPartition("alliance", "other").V("ams").out("flies").count().next() == 0
    assert p.V("ams").out("flies").out("flies").count().next() == 2
    both = g.V().project("k", "v").by("~id").by(__.coalesce(__.out("flies").id(), __.constant("stays")))
    found = {r["k"]: r["v"] for r in both.df().collect()}
    assert found["osl"] == "rom" and found["lis"] == "stays" and found["ams"] in ("osl", "rom")


def test_mixed_targets(spark):
    g = boxes(spark)
    assert g.V("crate").out("holds").hasLabel("box").has("state", "full").limit(10).count().next() == 2
    assert g.V("j1").in_("holds").hasLabel("box").has("state", "full").count().next() == 2
    assert g.V("b1").both("holds").count().next() == 2
    assert g.V("b1").both("holds").hasLabel("jar").count().next() == 1
    assert g.V().both("holds").count().next() == 14
    assert g.V().both("holds").hasLabel("jar").count().next() == 4
    assert g.V("crate").out("holds").hasLabel("box").order().by("name").limit(2).values("name").toList() == ["amber", "birch"]
    assert g.V("crate").out("holds").has("state", "full").count().next() == 3
    assert g.V("crate").out("holds").count().next() == 5


def test_windows(spark):
    g = waters(spark)
    rivers = lambda: g.V().hasLabel("river").order().by("name")
    assert rivers().range_(2, 4).values("name").toList() == ["cam", "don"]
    assert rivers().skip(4).values("name").toList() == ["ebro", "fal"]
    assert rivers().limit(2).values("name").toList() == ["aar", "bug"]
    assert rivers().tail(2).values("name").toList() == ["ebro", "fal"]
    assert g.V().hasLabel("river").dedup().range_(1, 3).count().next() == 2
    assert g.V().order().by("name").range_(5, 7).values("name").toList() == ["fal", "garda"]
    assert g.V().range_(1, 4).count().next() == 3
    assert rivers().values("name").fold().range_(local, 1, 3).toList() == [["bug", "cam"]]
    assert g.V().hasLabel("river").order().by("name", desc).values("name").toList()[0] == "fal"
    assert g.V().order().by(T.id).limit(2).id().toList() == ["l1", "l2"]
    assert g.V().sample(3).count().next() == 3
    assert g.V().coin(1.0).count().next() == 8 and g.V().coin(0.0).count().next() == 0


def test_unions(spark):
    g = stations(spark)
    assert g.V().union(__.out("rail")).values("name").order().toList() == ["bay", "cove", "dell", "elm"]
    assert vals(g.V("s1").as_("m").union(__.select("m").values("name"), __.out("rail").values("name"))) == ["ash", "bay", "cove"]
    assert g.union(__.V()).count().next() == 5
    assert vals(g.union(__.inject(1), __.inject(2))) == [1, 2]
    assert g.V().out().in_().union(__.out()).count().next() == 8
    assert g.V().union(__.out(), __.in_()).groupCount().by(T.id).select(values).sum_().next() == 8
    assert vals(g.V().choose(__.has("name", "ash"), __.union(__.out().values("name")), __.constant("z"))) == ["bay", "cove", "z", "z", "z", "z"]
    big = ring(spark)
    assert big.V().union(__.out().limit(2)).count().next() == 2
    assert big.V().union(__.out(), __.out().out()).count().next() == 180


def test_paths(spark, g):
    n = stations(spark)
    assert sorted(n.V("s1").out().out().path().by("name").toList()) == [["ash", "cove", "dell"], ["ash", "cove", "elm"]]
    assert n.V("s1").out().in_().simplePath().count().next() == 0
    assert n.V("s1").out().in_().cyclicPath().count().next() == 2
    assert g.V("1").out("knows").values("name").path().count().next() == 2
    assert g.V("1").out("created").in_("created").tree().by("name").count().next() == 3


def test_aggregates(g):
    assert g.V().values("age").sum_().next() == 123
    assert g.V().values("age").min_().next() == 27 and g.V().values("age").max_().next() == 35
    assert g.V().values("age").mean().next() == 30.75
    assert g.V().has("name", "x").values("age").sum_().toList() == []
    assert g.V().has("name", "x").count().next() == 0
    assert g.V().has("name", "x").values("age").fold().toList() == [[]]
    assert sorted(g.V().values("age").fold().next()) == [27, 29, 32, 35]
    assert g.V().values("age").order().fold().next() == [27, 29, 32, 35]
    assert g.V().values("age").order().by(desc).fold().next() == [35, 32, 29, 27]
    assert g.V().values("age").fold(0, lambda a, x: a + x).next() == 123
    assert sorted(g.V().values("age").fold().unfold().toList()) == [27, 29, 32, 35]
    assert dict(map(tuple, g.V().groupCount().by(T.label).toList())) == {"person": 4, "software": 2}
    assert dict(map(tuple, g.V().hasLabel("person").group().by("name").by(__.out("created").count()).toList())) == {"marko": 1, "vadas": 0, "josh": 2, "peter": 1}
    grouped = {r["k"]: sorted(r["v"]) for r in g.V().group().by(T.label).by("name").df().collect()}
    assert grouped == {"person": ["josh", "marko", "peter", "vadas"], "software": ["lop", "ripple"]}
    assert vals(g.V().groupCount().by(T.label).select(keys)) == ["person", "software"]
    assert sorted(g.V().hasLabel("person").aggregate("x").by("name").cap("x").next()) == ["josh", "marko", "peter", "vadas"]
    assert g.V("1").outE().subgraph("s").cap("s").count().next() == 3
    assert g.V().fold().count(local).next() == 6


def test_collection_steps(g):
    ages = lambda: g.V().values("age").order().fold()
    assert ages().sum_(local).next() == 123 and ages().max_(local).next() == 35 and ages().min_(local).next() == 27 and ages().mean(local).next() == 30.75
    assert ages().limit(local, 2).next() == [27, 29] and ages().tail(local, 1).next() == [35]
    assert ages().order(local).by(desc).next() == [35, 32, 29, 27]
    assert g.inject([1, 1, 2]).dedup(local).next() == [1, 2]
    assert g.inject([1, 2]).intersect([2, 3]).next() == [2]
    assert g.inject([1, 2]).difference([2]).next() == [1]
    assert sorted(g.inject([1, 2]).disjunct([2, 3]).next()) == [1, 3]
    assert g.inject(["a", "b"]).conjoin("-").next() == "a-b"
    assert g.inject([1, 2]).all_(gt(0)).next() is True and g.inject([1, 2]).any_(gt(5)).toList() == [False]
    assert g.inject([1, 2]).product([3]).next() == [[1, 3], [2, 3]]


def test_where_and_not(g):
    assert vals(g.V().where(__.out("created")).values("name")) == ["josh", "marko", "peter"]
    assert vals(g.V().not_(__.out()).values("name")) == ["lop", "ripple", "vadas"]
    assert vals(g.V().hasLabel("person").not_(__.out("created").has("name", "lop")).values("name")) == ["vadas"]
    assert vals(g.V().where(__.out("created").count().is_(gt(1))).values("name")) == ["josh"]
    assert vals(g.V().and_(__.out("knows"), __.has("age", gt(20))).values("name")) == ["marko"]
    assert vals(g.V().or_(__.out("knows"), __.has("name", "lop")).values("name")) == ["lop", "marko"]
    assert vals(g.V().filter_(__.in_("knows")).values("name")) == ["josh", "vadas"]
    assert vals(g.V("1").as_("a").out("created").in_("created").where(neq("a")).values("name")) == ["josh", "peter"]
    assert vals(g.V().as_("a").out("knows").as_("b").where("a", gt("b")).by("age").select("b").values("name")) == ["vadas"]
    assert vals(g.V().as_("a").out("created").as_("b").where(__.as_("b").in_("created").has("name", "peter")).select("a").values("name")) == ["josh", "marko", "peter"]
    assert g.V().as_("a").out("created").as_("b").where(__.as_("a").out("created").as_("b")).count().next() == 4
    assert vals(g.V().values("age").is_(gt(30))) == [32, 35]
    assert vals(g.V().has("age", __.is_(gt(30))).values("name")) == ["josh", "peter"]


def test_match(g):
    t = g.V().match(__.as_("a").out("created").as_("b"), __.as_("b").in_("created").as_("c"), __.as_("a").out("knows").as_("c")).select("a", "c").by("name")
    assert sorted(map(tuple, t.toList())) == [("marko", "josh")]


def test_branches(g):
    assert vals(g.V().hasLabel("person").coalesce(__.out("knows").values("name"), __.values("name"))) == ["josh", "josh", "peter", "vadas", "vadas"]
    assert vals(g.V().hasLabel("person").optional(__.out("knows")).values("name")) == ["josh", "josh", "peter", "vadas", "vadas"]
    assert vals(g.V().hasLabel("person").choose(__.values("age")).option(29, __.constant("x")).option("none", __.constant("y"))) == ["x", "y", "y", "y"]
    assert vals(g.V().hasLabel("person").choose(__.out("knows"), __.constant("k"), __.constant("n"))) == ["k", "n", "n", "n"]
    assert vals(g.V().hasLabel("person").local(__.out("created").order().by("name").limit(1)).values("name")) == ["lop", "lop", "lop"]
    assert vals(g.V().hasLabel("person").local(__.out("created").count())) == [0, 1, 1, 2]
    assert vals(g.V().hasLabel("person").map_(__.out("created").values("name").order())) == ["lop", "lop", "lop"]
    assert vals(g.V("1").flatMap(__.out("knows")).values("name")) == ["josh", "vadas"]


def test_loops(spark, g):
    assert vals(g.V("1").repeat(__.out()).times(2).values("name")) == ["lop", "ripple"]
    assert vals(g.V("1").repeat(__.out()).until(__.hasLabel("software")).values("name")) == ["lop", "lop", "ripple"]
    assert vals(g.V("1").until(__.hasLabel("person")).repeat(__.out()).values("name")) == ["marko"]
    assert vals(g.V("1").repeat(__.out()).emit().times(2).values("name")) == ["josh", "lop", "lop", "ripple", "vadas"]
    assert vals(g.V("1").emit().repeat(__.out()).times(1).values("name")) == ["josh", "lop", "marko", "vadas"]
    assert vals(g.V("1").repeat(__.out()).emit(__.has("lang")).times(2).values("name")) == ["lop", "lop", "ripple"]
    n = stations(spark)
    assert vals(n.V("s1").repeat(__.out()).emit().values("name")) == ["bay", "cove", "dell", "elm"]
    looped = ring(spark, 5)
    looped.graph.max_depth = 3
    with pytest.raises(RecursionError):
        looped.V("c0").repeat(__.out()).until(__.has("name", "nowhere")).count().next()
    assert looped.V("c0").repeat(__.out().simplePath()).times(4).path().by("name").toList() == [["x0", "x1", "x2", "x3", "x4"]]


def test_loop_counters(spark, g):
    n = stations(spark)
    assert vals(n.V("s1").repeat(__.out()).until(__.loops().is_(1)).values("name")) == ["bay", "cove"]
    assert vals(n.V("s1").repeat(__.out()).until(__.loops().is_(2)).values("name")) == ["dell", "elm"]
    assert vals(n.V("s1").repeat(__.out()).emit(__.loops().is_(1)).times(2).values("name")) == ["bay", "cove", "dell", "elm"]
    assert vals(n.V("s1").repeat("a", __.out()).until(__.loops("a").is_(gte(2))).values("name")) == ["dell", "elm"]
    assert vals(n.V("s1").repeat("a", __.repeat("b", __.out()).times(1)).until(__.and_(__.loops("a").is_(2), __.loops("b").is_(0))).values("name")) == ["dell", "elm"]
    assert n.V("s1").repeat(__.out().local(__.loops())).times(1).toList() == [0, 0]


def test_dedup_keeps_the_first(spark, g):
    assert vals(g.V().hasLabel("person").order().by("age").dedup().by(T.label).values("name")) == ["vadas"]
    assert vals(g.V().hasLabel("person").order().by("age", desc).dedup().by(T.label).values("name")) == ["peter"]
    b = boxes(spark)
    assert vals(b.V().hasLabel("box").order().by("size").dedup().by("state").values("name")) == ["amber", "birch"]


def test_branch(g):
    t = g.V().hasLabel("person").branch(__.values("age")).option(29, __.constant("x")).option(lt(30), __.constant("young")).option("any", __.constant("all"))
    assert vals(t) == ["all", "all", "all", "all", "x", "young", "young"]
    assert vals(g.V().hasLabel("person").branch(__.values("age")).option(29, __.constant("x"))) == ["x"]
    assert vals(g.V().hasLabel("person").branch(__.values("age")).option(29, __.constant("x")).option("none", __.constant("o"))) == ["o", "o", "o", "x"]


def test_added_edges(spark):
    g = stations(spark)
    g.V("s2").addE("walk").to(__.V("s4")).property("minutes", 7).iterate()
    assert g.V("s2").outE("walk").has("minutes", 7).inV().values("name").toList() == ["dell"]
    g.V("s1").as_("a").out().as_("b").addE("back").from_("b").to("a").iterate()
    assert vals(g.V().out("back").values("name")) == ["ash", "ash"] and vals(g.V("s1").in_("back").values("name")) == ["bay", "cove"]
    for _ in range(2):  # an id that is there is not added again
        g.addE("walk").from_(("stop", "s1")).to(("stop", "s5")).property(T.id, "w1").iterate()
        g.addE("rail").from_(("stop", "s1")).to(("stop", "s5")).property(T.id, "r1").iterate()
    assert vals(g.V("s1").out("walk").values("name")) == ["elm"]
    assert vals(g.V("s1").out("rail").values("name")) == ["bay", "cove"]
    g.addV("stop").property("id", "s9").property("name", "fern").addE("rail").to(__.V("s1")).iterate()
    assert g.V("s9").out("rail").values("name").toList() == ["ash"]


def test_added_vertices(spark):
    g = stations(spark)
    for i in range(200):
        g.addV("stop").property("id", f"n{i}").property("name", f"new{i}").property("size", i if i % 2 else i / 2).iterate()
    g.addV("stop").property("id", "s1").property("name", "other").iterate()
    assert g.V().hasLabel("stop").count().next() == 205
    assert g.V("s1").values("name").toList() == ["ash"]
    g.V("n3").drop().iterate()
    g.addV("stop").property("id", "n3").property("name", "again").iterate()
    assert g.V("n3").values("name").toList() == ["again"] and g.V().hasLabel("stop").count().next() == 205
    g.V("n5").properties("name").drop().iterate()
    assert g.V("n5").values("name").toList() == [] and g.V("n5").values("size").toList() == [5.0]
    assert g.graph.structure("V", "n5", "n6").count() == 2


def test_projection(g):
    assert sorted(map(tuple, g.V("1").project("n", "c").by("name").by(__.out().count()).toList())) == [("marko", 3)]
    assert g.V("1").as_("a").out("created").as_("b").select("a", "b").by("name").toList()[0].asDict() == {"a": "marko", "b": "lop"}
    assert g.V("1").valueMap("name").next() == {"name": ["marko"]}
    assert g.V("1").elementMap("name").next() == {"id": "1", "label": "person", "name": "marko"}
    assert sorted(map(tuple, g.V("3").properties().toList())) == [("lang", "java"), ("name", "lop")]
    assert vals(g.V("1").properties().hasKey("name").value()) == ["marko"]
    assert vals(g.V("1").values("name", "age")) == ["29", "marko"]
    assert g.V("1").values("age").math("_ * 2 + 1").next() == 59
    assert g.V().as_("a").out("knows").as_("b").math("a - b").by("age").order().toList() == [-3, 2]
    assert g.V("1").constant("c").next() == "c"
    assert g.withSack(1).V("1").outE("knows").sack("mult").by("weight").sack().order().toList() == [0.5, 1.0]
    assert g.V("1").values("name").toUpper().next() == "MARKO"
    assert g.V("1").values("name").substring(1, 3).next() == "ar" and g.V("1").values("name").substring(-2).next() == "ko"
    assert g.V("1").values("name").length().next() == 5 and g.V("1").values("name").reverse().next() == "okram"
    assert g.V("1").values("name").concat("-", "x").next() == "marko-x" and g.V("1").values("name").split("a").next() == ["m", "rko"]
    assert g.inject(" a ").trim().next() == "a" and g.inject("5").asNumber().next() == 5.0 and g.inject("true").asBool().next() is True
    assert g.inject("x").asNumber().toList() == []
    assert g.inject("2024-01-02").asDate().dateAdd("day", 1).asString().next().startswith("2024-01-03")


def test_dates(spark):
    times = spark.createDataFrame([("1", "2024-01-01 10:00:00"), ("2", "2024-06-01 10:00:00"), ("3", "2025-01-01 00:00:00")], "id string, at string")
    config = {"vertices": [{"table": "t", "id": "@id", "label": "x", "properties": {"at": {"field": "at", "type": "timestamptz"}, "shown": {"field": "at", "sourceFormat": "yyyy-MM-dd HH:mm:ss", "displayFormats": ["dd/MM/yyyy"]}}}]}
    g = Graph.of(spark, config, {"t": times}).traversal()
    assert vals(g.V().has("at", between("2024-01-01T10:00:00Z", "2024-06-01T10:00:00+00:00")).id()) == ["1"]
    assert vals(g.V().has("at", gt("01/02/2024")).id()) == ["2", "3"]
    assert g.V().has("at", eq(1704103200)).count().next() == 0
    assert vals(g.V().has("at", Date.between("2024-01-01", "2025-01-01")).id()) == ["1", "2"]
    assert vals(g.V().has("shown", "01/06/2024").id()) == ["2"]
    assert vals(g.V().has("shown", Date.lt("2024-03-01")).id()) == ["1"]


def towns(spark, kind="@kind"):
    """People of towns, one of no town and some of one key, with one label or several, of which one is not known; streets with loops and parallels."""
    people = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 2, "b"), (5, None, "a"), (6, 2, None), (7, 3, "a"), (7, 1, "a"), (7, 1, "b"), (2, 2, None)], "id long, town long, kind string")
    rows = [(1, "a", 2, "a"), (2, "a", 1, "a"), (1, "a", 2, "a"), (1, "a", 1, "a"), (3, "b", 2, "a"), (2, "a", 4, "b"), (7, "b", 7, None), (7, "a", 7, "b"), (1, "a", 7, None), (4, "b", 1, "a")]
    streets = spark.createDataFrame([(f"s{i}", *r) for i, r in enumerate(rows)], "id string, src_id long, src_label string, dst_id long, dst_label string")
    person = typed(kind, "people", kind="kind") | {"edges": [{"id": "@id", "label": "lives", "vertex": {"ref": True, "id": "@town", "label": "town"}}]}
    return Graph.of(spark, {"vertices": [person], "edges": [link("street", "streets", None, None)]}, {"people": people, "streets": streets}).traversal()


def neighbours(g):
    return g.V().as_("a").out("lives").in_("lives").as_("b")


def joins(t):
    return t.df()._jdf.queryExecution().optimizedPlan().toString().count("Join")


def test_pairs_are_counted_without_a_join(spark):
    g = towns(spark, "one")
    for t, n in [(neighbours(g), 35), (neighbours(g).where("a", neq("b")), 24), (neighbours(g).where("a", eq("b")), 11), (neighbours(g).where(neq("a")), 24), (neighbours(g).has("kind", "a").where("b", neq("a")), 11)]:
        assert joins(t.count()) == 0 and t.count().next() == len(t.id().toList()) == n
    many = Graph.of(spark, {"vertices": [typed("one", "p") | {"edges": [{"id": "@id", "label": "lives", "vertex": {"ref": True, "id": "@town", "label": "town"}}]}]}, {"p": spark.range(400_000).selectExpr("id", "id % 2 as town")}).traversal()
    assert neighbours(many).where("a", neq("b")).count().next() == 2 * (200_000**2 - 200_000)


@pytest.mark.parametrize("kind", ["@kind", "one"])
@pytest.mark.parametrize(
    "f",
    [
        lambda g: neighbours(g).where("a", neq("b")),
        lambda g: neighbours(g).where("b", eq("a")),
        lambda g: neighbours(g).hasLabel("a", "one").where("a", neq("b")),
        lambda g: neighbours(g).hasId(1, 7).where(neq("a")),
        lambda g: neighbours(g).has("kind", "a").where("a", neq("b")),
        lambda g: neighbours(g).where("a", neq("b")).by("kind"),
        lambda g: neighbours(g).where("a", neq("b")).where("a", eq("b")),
        lambda g: neighbours(g).where("a", neq("b").or_(eq("a"))),
        lambda g: neighbours(g).where("a", neq("b")).limit(3),
        lambda g: neighbours(g).where("a", neq("b")).out("lives").in_("lives"),
        lambda g: g.V().has("kind", "z").as_("a").out("lives").in_("lives").as_("b").where("a", neq("b")),
        lambda g: g.V().as_("a").outE("street").inV().inE("street").as_("f").where("a", neq("f")),
        lambda g: g.V().union(__.out("lives").in_("lives"), __.out("lives")),
        lambda g: g.V().where(__.out("lives").in_("lives").count().is_(gt(5))),
    ],
)
def test_a_count_of_pairs_is_that_of_the_rows(spark, f, kind):
    t = f(towns(spark, kind))
    assert t.count().next() == len(t.constant("x").toList())


@pytest.mark.parametrize(
    "f",
    [
        lambda g: g.V().as_("a").out("street").in_("street").as_("b").where("b", neq("a")),
        lambda g: g.V().as_("a").both("street").both("street").as_("b").where("a", neq("b")),
        lambda g: g.V().as_("a").out("street").as_("c").out("street").as_("b").where("a", neq("b")).where("c", neq("b")),
        lambda g: g.V().as_("a").out("street").as_("c").out("street").as_("b").where("a", neq("c")).where("a", neq("b")),
        lambda g: g.V().as_("a").out("street").as_("c").out("street").as_("b").where("a", eq("c")).where("c", neq("b")),
        lambda g: g.E().as_("e").inV().inE("street").as_("f").where("e", neq("f")),
        lambda g: g.E().as_("e").inV().inE("street").as_("f").where("e", eq("f")),
    ],
)
def test_a_count_of_pairs_by_a_table_of_edges(spark, f):
    t = f(towns(spark))
    rows = t.constant("x").toList()
    assert t.count().next() == len(rows) > 0 and (joins(t.count()) < joins(t.constant("x")) or len([s for s in t.steps if s.name == "where"]) > 1)

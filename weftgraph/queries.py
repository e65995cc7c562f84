"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import Date, Graph, T, Text, TextP, __, between, desc, eq, exists, gt, gte, inside, keys, local, lt, lte, neq, not_, outside, type_of, values, within, without
from weftgraph.plans.traversal import GraphTraversalSource

G = GraphTraversalSource
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *columns: str, urgent: bool = False) -> Callable:
    """Register a traversal (or DataFrame) of ``g`` under a name, with its column names and SQL."""

    def register(f: Callable[[G], object]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Graph.over(spark, sf_dir, urgent).traversal())
            df = found if isinstance(found, DataFrame) else found.df()
            return df.toDF(*columns) if columns else df

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = " ".join(sql.split())
        return f

    return register


q = query

# scans and predicates
q("scan_count", "select count(*) as cnt from customer", "cnt")(lambda g: g.V().hasLabel("customer").count())
q("v_by_id", "select c_name as name from customer where c_custkey in (1,2,3)", "name")(lambda g: g.V("customer", 1, 2, 3).values("name"))
q("federated_scan", "select label, count(*) as cnt from (select 'region' label from region union all select 'nation' from nation union all select 'customer' from customer) group by label", "label", "cnt")(lambda g: g.V().hasLabel("region", "nation", "customer").label().groupCount())
q("has_eq", "select cast(c_custkey as varchar) as id from customer where c_mktsegment='BUILDING'", "id")(lambda g: g.V().has("customer", "segment", "BUILDING").id())
q("has_between", "select cast(p_partkey as varchar) as id from part where p_size>=10 and p_size<20", "id")(lambda g: g.V().has("part", "size", between(10, 20)).id())
q("has_within_without", "select count(*) as cnt from orders where o_orderstatus in ('F','O') and o_orderpriority not in ('1-URGENT')", "cnt")(lambda g: g.V().has("order", "status", within("F", "O")).has("priority", without("1-URGENT")).count())
q("has_or", "select cast(p_partkey as varchar) as id from part where p_size<5 or p_size>45", "id")(lambda g: g.V().hasLabel("part").or_(__.has("size", lt(5)), __.has("size", gt(45))).id())
q("textp_containing", "select cast(doc_id as varchar) as id from documents where contains(text,'the')", "id")(lambda g: g.V().has("document", "text", TextP.containing("the")).id())
q("text_like", r"select n_name as name from nation where n_name like 'NATION\_1%' escape '\'", "name")(lambda g: g.V().has("nation", "name", Text.like("NATION_1*")).values("name"))
q("text_regexp", "select n_name as name from nation where regexp_full_match(n_name,'NATION_[0-4]')", "name")(lambda g: g.V().has("nation", "name", Text.regexp("NATION_[0-4]")).values("name"))
q("text_fuzzy", "select n_name as name from nation where levenshtein(n_name,'NATOIN_7')<=3", "name")(lambda g: g.V().has("nation", "name", Text.fuzzy("NATOIN_7")).values("name"))
q("jsonb_path", "select count(*) as cnt from events where json_extract_string(props,'$.k')='7'", "cnt")(lambda g: g.V().has("event", "props.k", "7").count())
q("date_between", "select count(*) as cnt from orders where o_orderdate>=timestamp '1995-01-01' and o_orderdate<timestamp '1996-01-01'", "cnt")(lambda g: g.V().has("order", "orderdate", Date.between("1995-01-01", "1996-01-01")).count())

# hops
q("hop_out", "select count(*) as cnt from customer join orders on o_custkey=c_custkey where c_mktsegment='BUILDING'", "cnt")(lambda g: g.V().has("customer", "segment", "BUILDING").out("placed").count())
q("hop_in", "select n_name as name from region join nation on n_regionkey=r_regionkey", "name")(lambda g: g.V().hasLabel("region").in_("in_region").values("name"))
q(
    "hop_both",
    """select label, count(*) as cnt from (select 'region' label from nation join region on n_regionkey=r_regionkey
       union all select 'customer' from nation join customer on c_nationkey=n_nationkey
       union all select 'supplier' from nation join supplier on s_nationkey=n_nationkey) group by label""",
    "label",
    "cnt",
)(lambda g: g.V().hasLabel("nation").both("in_region", "in_nation").label().groupCount())
q("hop_edges", "select count(*) as cnt from orders join lineitem on l_orderkey=o_orderkey where l_quantity>45", "cnt")(lambda g: g.V().hasLabel("order").outE("contains").has("quantity", gt(45)).count())
q("edge_inv", "select count(distinct p_partkey) as cnt from lineitem join part on l_partkey=p_partkey where l_returnflag='R' and l_quantity>49", "cnt")(lambda g: g.E().hasLabel("contains").has("returnflag", "R").has("quantity", gt(49)).inV().dedup().count())
q("other_v", "select (select count(*) from customer where c_nationkey=0)+(select count(*) from supplier where s_nationkey=0) as cnt", "cnt")(lambda g: g.V("nation", 0).bothE("in_nation").otherV().count())
q("target_filter", "select count(*) as cnt from customer join orders on o_custkey=c_custkey where o_orderstatus='F'", "cnt")(lambda g: g.V().hasLabel("customer").out("placed").has("status", "F").count())
q(
    "multi_hop_group",
    "select r_name as region, count(*) as cnt from region join nation on n_regionkey=r_regionkey join customer on c_nationkey=n_nationkey join orders on o_custkey=c_custkey group by r_name",
    "region",
    "cnt",
)(lambda g: g.V().hasLabel("region").as_("r").in_("in_region").in_("in_nation").hasLabel("customer").out("placed").groupCount().by(__.select("r").values("name")))

# order, windows, duplicates
q("order_limit", "select cast(c_custkey as varchar) as id from customer order by c_acctbal desc, c_custkey limit 10", "id")(lambda g: g.V().hasLabel("customer").order().by("acctbal", desc).by(__.id().asNumber()).limit(10).id())
q("order_range", "select n_name as name from nation order by n_name limit 3 offset 2", "name")(lambda g: g.V().hasLabel("nation").order().by("name").range_(2, 5).values("name"))
q("dedup_by", "select count(distinct p_brand) as cnt from part", "cnt")(lambda g: g.V().hasLabel("part").dedup().by("brand").count())
q("tail_ordered", "select r_name as name from region order by r_name desc limit 2", "name")(lambda g: g.V().hasLabel("region").order().by("name").tail(2).values("name"))

# reductions
q("group_sum", "select o_orderstatus as k, sum(cast(o_totalprice as decimal(18,2))) as v from orders group by o_orderstatus", "k", "v")(
    lambda g: g.V().hasLabel("order").group().by("status").by(__.values("totalprice").map_(lambda c: c.cast("decimal(18,2)")).sum_()).df().select("k", F.col("v").cast("decimal(38,2)"))
)
q("group_count_nested", "select n_name as k, (select count(*) from supplier where s_nationkey=n_nationkey) as v from nation", "k", "v")(lambda g: g.V().hasLabel("nation").group().by("name").by(__.in_("in_nation").hasLabel("supplier").count()))
q("min_size", "select min(p_size) as mn from part", "mn")(lambda g: g.V().hasLabel("part").values("size").min_())
q("max_size", "select max(p_size) as mx from part", "mx")(lambda g: g.V().hasLabel("part").values("size").max_())
q("mean_size", "select avg(p_size) as mean from part", "mean")(lambda g: g.V().hasLabel("part").values("size").mean())
q("sum_size", "select cast(sum(p_size) as bigint) as total from part", "total")(lambda g: g.V().hasLabel("part").values("size").sum_())
q("dedup_count", "select count(distinct c_nationkey) as cnt from customer", "cnt")(lambda g: g.V().hasLabel("customer").out("in_nation").dedup().count())

# branches
q(
    "union_branches",
    "select label, count(*) as cnt from (select 'customer' label from nation join customer on c_nationkey=n_nationkey union all select 'region' from nation join region on n_regionkey=r_regionkey) group by label",
    "label",
    "cnt",
)(lambda g: g.V().hasLabel("nation").union(__.in_("in_nation").hasLabel("customer"), __.out("in_region")).label().groupCount())
q("root_union", "select r_name as name from region union all select n_name from nation", "name")(lambda g: g.union(__.V().hasLabel("region").values("name"), __.V().hasLabel("nation").values("name")))
q("coalesce_branch", "select coalesce(s_name,'none') as v from nation left join supplier on s_nationkey=n_nationkey", "v")(lambda g: g.V().hasLabel("nation").coalesce(__.in_("in_nation").hasLabel("supplier").values("name"), __.constant("none")))
q("optional_branch", "select coalesce(s_name, n_name) as v from nation left join supplier on s_nationkey=n_nationkey and s_acctbal>5000", "v")(lambda g: g.V().hasLabel("nation").optional(__.in_("in_nation").has("supplier", "acctbal", gt(5000))).values("name"))
q("choose", "select case when p_size>25 then 'big' else 'small' end as k, count(*) as cnt from part group by 1", "k", "cnt")(lambda g: g.V().hasLabel("part").choose(__.has("size", gt(25)), __.constant("big"), __.constant("small")).groupCount())
q("choose_option", "select case o_orderstatus when 'F' then 'done' when 'O' then 'open' else 'other' end as k, count(*) as cnt from orders group by 1", "k", "cnt")(
    lambda g: g.V().hasLabel("order").choose(__.values("status")).option("F", __.constant("done")).option("O", __.constant("open")).option("none", __.constant("other")).groupCount()
)
q("where_semi", "select cast(c_custkey as varchar) as id from customer where exists(select 1 from orders where o_custkey=c_custkey and o_totalprice>300000)", "id")(lambda g: g.V().hasLabel("customer").where(__.out("placed").has("totalprice", gt(300000))).id())
q("not_anti", "select cast(c_custkey as varchar) as id from customer where not exists(select 1 from orders where o_custkey=c_custkey and o_orderstatus='P')", "id")(lambda g: g.V().hasLabel("customer").not_(__.out("placed").has("status", "P")).id())
q(
    "or_nested",
    "select cast(n_nationkey as varchar) as id from nation where n_regionkey=0 or exists(select 1 from supplier where s_nationkey=n_nationkey and s_acctbal<0)",
    "id",
)(lambda g: g.V().hasLabel("nation").or_(__.has("regionkey", 0), __.in_("in_nation").has("supplier", "acctbal", lt(0))).id())
q("where_labels", "select count(*) as cnt from customer a join customer b on a.c_nationkey=b.c_nationkey where a.c_custkey<>b.c_custkey", "cnt")(
    lambda g: g.V().hasLabel("customer").as_("a").out("in_nation").in_("in_nation").hasLabel("customer").as_("b").where("a", neq("b")).count()
)
q(
    "match_pattern",
    "select count(*) as cnt from customer join orders on o_custkey=c_custkey join lineitem on l_orderkey=o_orderkey join part on p_partkey=l_partkey join nation on n_nationkey=c_nationkey",
    "cnt",
)(
    lambda g: g.V().hasLabel("customer").match(__.as_("c").out("placed").as_("o"), __.as_("o").out("contains").as_("p"), __.as_("c").out("in_nation").as_("n")).select("n", "p").count()
)
q("repeat_times", "select r_name as k, count(*) as cnt from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by r_name", "k", "cnt")(
    lambda g: g.V().hasLabel("customer").repeat(__.out("in_nation", "in_region")).times(2).values("name").groupCount()
)
q(
    "repeat_emit",
    """select 'nation' as label from customer join nation on c_nationkey=n_nationkey where c_custkey=1
       union all select 'region' from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey where c_custkey=1""",
    "label",
)(lambda g: g.V("customer", 1).repeat(__.out("in_nation", "in_region")).emit().times(2).label())
q("repeat_until", "select r_name as name from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey", "name")(lambda g: g.V().hasLabel("supplier").repeat(__.out("in_nation", "in_region")).until(__.hasLabel("region")).values("name"))

# paths, maps, arithmetic
q("path_by", "select r_name as p0, n_name as p1 from region join nation on n_regionkey=r_regionkey where r_regionkey=0", "p0", "p1")(lambda g: g.V("region", 0).in_("in_region").path().by("name").df().select(F.col("value")[0], F.col("value")[1]))
q("simple_path", "select count(*) as cnt from customer a join customer b on a.c_nationkey=b.c_nationkey where a.c_custkey<>b.c_custkey and a.c_custkey between 1 and 20", "cnt")(
    lambda g: g.V("customer", *range(1, 21)).out("in_nation").in_("in_nation").hasLabel("customer").simplePath().count()
)
q("project_by", "select n_name as n, (select count(*) from customer where c_nationkey=n_nationkey) as c from nation", "n", "c")(lambda g: g.V().hasLabel("nation").project("n", "c").by("name").by(__.in_("in_nation").hasLabel("customer").count()))
q("select_tags", "select n_name as n, r_name as r from nation join region on n_regionkey=r_regionkey", "n", "r")(lambda g: g.V().hasLabel("nation").as_("n").out("in_region").as_("r").select("n", "r").by("name"))
q(
    "local_topk",
    "select cast(c_custkey as varchar) as id from (select c_custkey,row_number() over(partition by n_nationkey order by c_acctbal desc,c_custkey) rn from nation join customer on c_nationkey=n_nationkey) t where rn<=2",
    "id",
)(lambda g: g.V().hasLabel("nation").local(__.in_("in_nation").hasLabel("customer").order().by("acctbal", desc).by(__.id().asNumber()).limit(2)).id())
q("math_by", "select concat(l_orderkey,'_',l_partkey,'_',l_suppkey,'_',l_linenumber) as k, l_extendedprice*(1-l_discount) as v from lineitem", "k", "v")(
    lambda g: g.E().hasLabel("contains").project("k", "v").by(T.id).by(__.math("extendedprice * (1 - discount)"))
)
q("scalar_steps", "select upper(substring(n_name,1,6)) || '-x' as v from nation", "v")(lambda g: g.V().hasLabel("nation").values("name").substring(0, 6).toUpper().concat("-", "x"))
q("map_columns", "select upper(substring(n_name,1,6)) || '-' || length(n_name) as v from nation", "v")(lambda g: g.V().hasLabel("nation").values("name").map_(lambda c: F.concat(F.upper(F.substring(c, 1, 6)), F.lit("-"), F.length(c).cast("string"))))
q("text_steps", "select lower(replace(r_name,'_','-')) as v from region", "v")(lambda g: g.V().hasLabel("region").values("name").replace("_", "-").toLower())
q("unfold_values", "select n_name as v from nation", "v")(lambda g: g.V().hasLabel("nation").values("name").fold().unfold())
q("values_of_keys", "select v from (select n_name as v from nation union all select cast(n_regionkey as varchar) from nation)", "v")(lambda g: g.V().hasLabel("nation").values("name", "regionkey"))
q("group_select_values", "select count(*) as v from orders group by o_orderpriority", "v")(lambda g: g.V().hasLabel("order").groupCount().by("priority").select(values))
q("edge_properties", "select 'returnflag' as k, l_returnflag as v from lineitem union all select 'linestatus', l_linestatus from lineitem", "k", "v")(lambda g: g.E().hasLabel("contains").properties("returnflag", "linestatus"))
q("edge_groups", "select l_returnflag as k, count(*) as cnt from lineitem group by l_returnflag", "k", "cnt")(lambda g: g.E().hasLabel("contains").groupCount().by("returnflag"))

# property schemas
q("virtual_users", "select count(*) as cnt from events where event_type='purchase' and user_id is not null", "cnt")(lambda g: g.V().hasLabel("user").out("performed").has("type", "purchase").count())
q("prop_concat", "select count(*) as cnt from orders where o_orderstatus||'_'||o_orderpriority='F_1-URGENT'", "cnt")(lambda g: g.V().has("order", "status_priority", "F_1-URGENT").count())
q("prop_alias", "select count(*) as cnt from orders where o_orderstatus='F'", "cnt")(lambda g: g.V().has("order", "status_name", "final").count())
q("prop_datefmt", "select count(distinct strftime(o_orderdate,'%Y-%m-%d')) as cnt from orders", "cnt")(lambda g: g.V().hasLabel("order").values("orderday").dedup().count())
q("include_exclude", "select count(*) as cnt from orders where o_orderpriority in ('1-URGENT')", "cnt", urgent=True)(lambda g: g.V().hasLabel("urgent_order").count())

# strategies and mutations
q("partition_strategy", "select count(*) as cnt from nation where n_regionkey=0", "cnt")(lambda g: g.withPartition("regionkey", 0).V().hasLabel("nation").count())
q("subgraph_strategy", "select count(*) as cnt from nation where n_name like 'NATION_1%'", "cnt")(lambda g: g.withSubgraph(__.has("name", TextP.startingWith("NATION_1"))).V().hasLabel("nation").count())


@query("overlay_add_drop", "select name from (select r_name as name from region where r_regionkey<>1 union all select 'new')", "name")
def overlay_add_drop(g: G) -> object:
    g.addV("region").property("id", 99).property("name", "new").iterate()
    g.V("region", 1).drop().iterate()
    return g.V().hasLabel("region").values("name")


@query("overlay_property", "select case when r_regionkey=2 then 'renamed' else r_name end as name from region", "name")
def overlay_property(g: G) -> object:
    g.V("region", 2).property("name", "renamed").iterate()
    return g.V().hasLabel("region").values("name")


@query("overlay_add_edge", "select r_name as name from region where r_regionkey in (2,3)", "name")
def overlay_add_edge(g: G) -> object:
    g.V("region", 0).addE("near").to(__.V("region", 2)).iterate()
    g.addE("near").from_(__.V("region", 0)).to(("region", "3")).property("id", "n1").iterate()
    g.addE("near").from_(("region", "0")).to(("region", "4")).property("id", "n1").iterate()  # its id is there
    return g.V("region", 0).out("near").values("name")


@query("overlay_edges_of_labels", "select n_name as a, r_name as b from nation join region on n_regionkey=r_regionkey", "a", "b")
def overlay_edges_of_labels(g: G) -> object:
    g.V().hasLabel("nation").as_("a").out("in_region").as_("b").addE("lies").from_("a").to("b").property("w", 1).iterate()
    return g.V().hasLabel("nation").as_("a").outE("lies").has("w", 1).inV().as_("b").select("a", "b").by("name")


@query("overlay_merge", "select r_name as name from region where r_regionkey<>4 union all select 'merged' union all select 'new'", "name")
def overlay_merge(g: G) -> object:
    g.mergeV({"label": "region", "id": 4}).option("onMatch", {}).onMatch({"name": "merged"}).iterate()
    g.mergeV({"label": "region", "id": 77}).onCreate({"name": "new"}).iterate()
    return g.V().hasLabel("region").values("name")


@query("overlay_many", "select 1000 + (select count(*) from region) as cnt", "cnt")
def overlay_many(g: G) -> object:
    for i in range(1000):
        g.addV("region").property("id", 100 + i).property("name", f"r{i}").iterate()
    g.addV("region").property("id", 100).property("name", "again").iterate()
    return g.V().hasLabel("region").count()


@query("overlay_drop_property", "select cast(r_regionkey as varchar) as id from region where r_regionkey=1", "id")
def overlay_drop_property(g: G) -> object:
    g.V("region", 1).properties("name").drop().iterate()
    return g.V().hasLabel("region").hasNot("name").id()


# loops and order
q("until_loops", "select 'nation' as label", "label")(lambda g: g.V("customer", 1).repeat(__.out("in_nation", "in_region")).until(__.loops().is_(1)).label())
q("emit_loops", "select 'nation' as label union all select 'region'", "label")(lambda g: g.V("customer", 1).repeat(__.out("in_nation", "in_region")).emit(__.loops().is_(1)).times(2).label())
q("named_loops", "select 'region' as label", "label")(lambda g: g.V("customer", 1).repeat("a", __.out("in_nation", "in_region")).until(__.loops("a").is_(2)).label())
q("order_dedup", "select cast(c_custkey as varchar) as id from customer qualify row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) = 1", "id")(
    lambda g: g.V().hasLabel("customer").order().by("acctbal").by(__.id().asNumber()).dedup().by("segment").id()
)
q("order_limit_of_hop", "select c_name as name from nation join customer on c_nationkey=n_nationkey where n_regionkey=0 order by c_acctbal, c_custkey limit 5", "name")(
    lambda g: g.V("region", 0).in_("in_region").in_("in_nation").hasLabel("customer").order().by("acctbal").by(__.id().asNumber()).limit(5).values("name")
)

# predicates
q("has_inside", "select count(*) as cnt from part where p_size>10 and p_size<20", "cnt")(lambda g: g.V().has("part", "size", inside(10, 20)).count())
q("has_outside", "select count(*) as cnt from part where p_size<10 or p_size>20", "cnt")(lambda g: g.V().has("part", "size", outside(10, 20)).count())
q("has_not_predicate", "select count(*) as cnt from part where not (p_size>=25)", "cnt")(lambda g: g.V().has("part", "size", not_(gte(25))).count())
q("has_lte", "select count(*) as cnt from part where p_size<=25", "cnt")(lambda g: g.V().has("part", "size", lte(25)).count())
q("has_key", "select count(*) as cnt from part where p_brand is not null", "cnt")(lambda g: g.V().hasLabel("part").has("brand").count())
q("has_exists", "select count(*) as cnt from part where p_brand is not null", "cnt")(lambda g: g.V().has("part", "brand", exists()).count())
q("has_no_key", "select count(*) as cnt from region", "cnt")(lambda g: g.V().hasLabel("region").hasNot("acctbal").count())
q("type_of_number", "select count(*) as cnt from part where p_size is not null", "cnt")(lambda g: g.V().has("part", "size", type_of("int")).count())
q("text_unlike", r"select n_name as name from nation where n_name not like 'NATION\_1%' escape '\'", "name")(lambda g: g.V().has("nation", "name", Text.unlike("NATION_1*")).values("name"))
q("text_unregexp", "select n_name as name from nation where not regexp_full_match(n_name,'NATION_[0-4]')", "name")(lambda g: g.V().has("nation", "name", Text.unregexp("NATION_[0-4]")).values("name"))
q("text_prefix", "select n_name as name from nation where starts_with(n_name,'NATION_2')", "name")(lambda g: g.V().has("nation", "name", Text.prefix("NATION_2")).values("name"))
q("text_unprefix", "select n_name as name from nation where not starts_with(n_name,'NATION_2')", "name")(lambda g: g.V().has("nation", "name", Text.unprefix("NATION_2")).values("name"))
q("text_unfuzzy", "select n_name as name from nation where levenshtein(n_name,'NATOIN_7')>3", "name")(lambda g: g.V().has("nation", "name", Text.unfuzzy("NATOIN_7")).values("name"))
q("textp_ending", "select n_name as name from nation where n_name like '%3'", "name")(lambda g: g.V().has("nation", "name", TextP.endingWith("3")).values("name"))
q("textp_regex", "select n_name as name from nation where regexp_matches(n_name,'_1.$')", "name")(lambda g: g.V().has("nation", "name", TextP.regex("_1.$")).values("name"))
q("textp_not_regex", "select n_name as name from nation where not regexp_matches(n_name,'_1.$')", "name")(lambda g: g.V().has("nation", "name", TextP.notRegex("_1.$")).values("name"))
q("date_lt", "select count(*) as cnt from orders where o_orderdate<timestamp '1995-01-01'", "cnt")(lambda g: g.V().has("order", "orderdate", Date.lt("1995-01-01")).count())
q("is_value", "select p_size as v from part where p_size>45", "v")(lambda g: g.V().hasLabel("part").values("size").is_(gt(45)))
q("filter_traversal", "select cast(n_nationkey as varchar) as id from nation where exists(select 1 from supplier where s_nationkey=n_nationkey and s_acctbal>9000)", "id")(lambda g: g.V().hasLabel("nation").filter_(__.in_("in_nation").has("supplier", "acctbal", gt(9000))).id())
q("has_key_of_properties", "select r_name as v from region", "v")(lambda g: g.V().hasLabel("region").properties().hasKey("name").value())
q("and_nested", "select cast(n_nationkey as varchar) as id from nation where n_regionkey=1 and exists(select 1 from supplier where s_nationkey=n_nationkey)", "id")(lambda g: g.V().hasLabel("nation").and_(__.has("regionkey", 1), __.in_("in_nation").hasLabel("supplier")).id())
q("cyclic_path", "select count(*) as cnt from customer a join customer b on a.c_nationkey=b.c_nationkey where a.c_custkey=b.c_custkey and a.c_custkey between 1 and 20", "cnt")(
    lambda g: g.V("customer", *range(1, 21)).out("in_nation").in_("in_nation").hasLabel("customer").cyclicPath().count()
)

# starts and hops
q("inject_values", "select cast(unnest([1, 2, 3]) as bigint) as v", "v")(lambda g: g.inject(1, 2, 3))
q("mid_traversal_v", "select count(*) as cnt from region cross join nation where r_regionkey<2", "cnt")(lambda g: g.V("region", 0, 1).V().hasLabel("nation").count())
q("both_v", "select count(*) * 2 as cnt from nation", "cnt")(lambda g: g.E().hasLabel("in_region").bothV().count())
q("out_v", "select n_name as name from nation", "name")(lambda g: g.E().hasLabel("in_region").outV().values("name"))
q("barrier_identity", "select count(*) as cnt from nation", "cnt")(lambda g: g.V().hasLabel("nation").barrier().identity().count())
q("none_step", "select 0 as cnt", "cnt")(lambda g: g.V().hasLabel("nation").none().count().df().select(F.col("value").cast("int")))

# collections
q("fold_size", "select count(*) as cnt from region", "cnt")(lambda g: g.V().hasLabel("region").values("name").fold().count(local))
q("fold_seed", "select cast(sum(p_size) + 5 as bigint) as v from part", "v")(lambda g: g.V().hasLabel("part").values("size").asLong().fold(5, lambda a, x: (a + x).cast("int")).df().select(F.col("value").cast("long")))
q("aggregate_cap", "select n_name as v from nation", "v")(lambda g: g.V().hasLabel("nation").aggregate("x").by("name").cap("x").unfold())
q("store_cap", "select r_name as v from region", "v")(lambda g: g.V().hasLabel("region").store("x").by("name").cap("x").unfold())
q("order_local", "select string_agg(r_name, ',' order by r_name desc) as v from region", "v")(lambda g: g.V().hasLabel("region").values("name").fold().order(local).by(desc).conjoin(","))
q("range_local", "select string_agg(r_name, ',' order by r_name) as v from region where r_regionkey in (1,2)", "v")(lambda g: g.V().hasLabel("region").values("name").order().fold().range_(local, 1, 3).conjoin(","))
q("sum_local", "select cast(sum(r_regionkey) as int) as v from region", "v")(lambda g: g.V().hasLabel("nation").values("regionkey").dedup().fold().sum_(local))
q("dedup_local", "select count(distinct n_regionkey) as v from nation", "v")(lambda g: g.V().hasLabel("nation").values("regionkey").fold().dedup(local).count(local))
q("list_intersect", "select cast(unnest([2, 3]) as bigint) as v", "v")(lambda g: g.inject([1, 2, 3]).intersect([2, 3, 4]).unfold())
q("list_difference", "select cast(1 as bigint) as v", "v")(lambda g: g.inject([1, 2, 3]).difference([2, 3, 4]).unfold())
q("list_disjunct", "select cast(unnest([1, 4]) as bigint) as v", "v")(lambda g: g.inject([1, 2, 3]).disjunct([2, 3, 4]).unfold())
q("list_merge", "select cast(unnest([1, 2, 3, 4]) as bigint) as v", "v")(lambda g: g.inject([1, 2, 3]).merge([2, 3, 4]).unfold())
q("list_combine", "select cast(unnest([1, 2, 2, 3]) as bigint) as v", "v")(lambda g: g.inject([1, 2]).combine([2, 3]).unfold())
q("list_all_any", "select true as v", "v")(lambda g: g.inject([1, 2]).all_(gt(0)))
q("union_distinct", "select n_name as name from nation", "name")(lambda g: g.V().hasLabel("nation").union(__.values("name"), __.values("name")).dedup())

# values
q("as_number", "select cast(r_regionkey as double) as v from region", "v")(lambda g: g.V().hasLabel("region").id().asNumber())
q("as_number_whole", "select p_size as v from part", "v")(lambda g: g.V().hasLabel("part").values("size").asNumber())
q("abs_number", "select abs(s_acctbal) as v from supplier", "v")(lambda g: g.V().hasLabel("supplier").values("acctbal").abs())
q("as_date", "select count(*) as cnt from orders where o_orderdate + interval 1 day > timestamp '1998-01-01'", "cnt")(lambda g: g.V().hasLabel("order").values("orderdate").asDate().dateAdd("day", 1).is_(gt("1998-01-01")).count())
q("text_length", "select cast(length(n_name) as int) as v from nation", "v")(lambda g: g.V().hasLabel("nation").values("name").length())
q("text_split", "select unnest(string_split(r_name, '_')) as v from region", "v")(lambda g: g.V().hasLabel("region").values("name").split("_").unfold())
q("text_reverse_trim", "select reverse(n_name) as v from nation", "v")(lambda g: g.V().hasLabel("nation").values("name").concat(" ").trim().reverse())
q("sack_sum", "select cast(10 + r_regionkey as int) as v from nation join region on n_regionkey=r_regionkey", "v")(lambda g: g.withSack(10).V().hasLabel("nation").sack("sum").by("regionkey").sack())
q("constant_value", "select 'x' as v from region", "v")(lambda g: g.V().hasLabel("region").constant("x"))
q("side_effect_cap", "select n_name as v from nation", "v")(lambda g: g.V().hasLabel("nation").sideEffect(__.values("name").aggregate("y")).cap("y").unfold())
q("flat_map", "select n_name as v from region join nation on n_regionkey=r_regionkey", "v")(lambda g: g.V().hasLabel("region").flatMap(__.in_("in_region")).values("name"))
q("local_count", "select count(*) as v from region join nation on n_regionkey=r_regionkey group by r_regionkey", "v")(lambda g: g.V().hasLabel("region").local(__.in_("in_region").count()))
q("branch_options", "select v from (select 'small' as v from part where p_size<10 union all select 'odd' from part where p_size in (7,9) union all select 'all' from part)", "v")(
    lambda g: g.V().hasLabel("part").branch(__.values("size")).option(lt(10), __.constant("small")).option(within(7, 9), __.constant("odd")).option("any", __.constant("all"))
)
q("group_keys", "select distinct o_orderstatus as k from orders", "k")(lambda g: g.V().hasLabel("order").groupCount().by("status").select(keys))
q("has_eq_predicate", "select count(*) as cnt from orders where o_orderstatus='F'", "cnt")(lambda g: g.V().has("order", "status", eq("F")).count())

# maps, trees, subgraphs and samples, taken apart
q("value_map", "select n_name as name, cast(n_regionkey as varchar) as regionkey from nation", "name", "regionkey")(lambda g: g.V().hasLabel("nation").valueMap().df().select(F.col("value")["name"][0], F.col("value")["regionkey"][0]))
q("value_map_numbers", "select p_size as size from part", "size")(lambda g: g.V().hasLabel("part").valueMap("size").df().select(F.col("value")["size"][0]))
q("element_map", "select cast(r_regionkey as varchar) as id, 'region' as label, r_name as name from region", "id", "label", "name")(lambda g: g.V().hasLabel("region").elementMap().df().select(*[F.col("value")[k] for k in ("id", "label", "name")]))
q("tree_paths", "select r_name as p0, n_name as p1 from region join nation on n_regionkey=r_regionkey", "p0", "p1")(lambda g: g.V().hasLabel("region").in_("in_region").tree().by("name").df().select(F.col("value")[0], F.col("value")[1]))
q("subgraph_edges", "select cast(n_nationkey as varchar) as a, cast(n_regionkey as varchar) as b from nation where n_regionkey=0", "a", "b")(lambda g: g.V("region", 0).inE("in_region").subgraph("s").cap("s").df().select("out_id", "in_id"))
q("sample_rows", "select 5 as cnt, 5 as of_all", "cnt", "of_all")(
    lambda g: g.V().hasLabel("nation").sample(5).values("name").df().agg(F.count("value").cast("int").alias("cnt"), F.count(F.when(F.col("value").startswith("NATION_"), 1)).cast("int").alias("of_all"))
)
q("shuffled", "select n_name as name from nation", "name")(lambda g: g.V().hasLabel("nation").order().by("shuffle").values("name"))
q("coin_all", "select count(*) as cnt from nation", "cnt")(lambda g: g.V().hasLabel("nation").coin(1.0).count())
q("profile_scan", "select 'nation' as source, count(*) as rows from nation union all select 'region', count(*) from region", "source", "rows")(lambda g: g.V().hasLabel("nation", "region").profile())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

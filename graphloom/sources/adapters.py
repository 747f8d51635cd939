"""The given tables as an event log, a triple table, dependency edges, access lists and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = ["org", "project", "resource", "s", "p", "o", "kind", "datatype"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log: one resource per user, one revision per event, in order of event_id."""
    e = read(spark, sf_dir, "events").selectExpr(
        "concat('o', user_id % 2) org",
        "concat('p', user_id % 5) project",
        "concat('r', user_id) id",
        "if(user_id % 7 = 0, 'File', 'Resource') type",
        "event_id + 1 ordering",
        "cast(row_number() over (partition by user_id order by event_id) as int) rev",
        "event_id",
        "event_type",
        "ts instant",
        "concat('u', event_id % 4) subject",
        "value",
        "props",
    )
    e = e.withColumn(
        "kind",
        F.expr("""case when rev = 1 then 'Created' when event_id % 11 = 0 then 'TagDeleted' when event_id % 13 = 0 then 'Refreshed'
                  when event_type = 'view' then 'Updated' when event_type = 'purchase' then 'SchemaUpdated' when event_type = 'click' then 'TagAdded'
                  when event_type = 'error' then 'Deprecated' else 'Undeprecated' end"""),
    )
    return e.selectExpr(
        "org",
        "project",
        "id",
        "type",
        "ordering",
        "rev",
        "kind",
        "instant",
        "subject",
        "value",
        "if(kind in ('Created', 'Updated', 'Refreshed'), array(concat('K', event_id % 3), concat('T', event_id % 4)), null) types",
        "if(kind in ('Created', 'Updated', 'SchemaUpdated'), concat('s', event_id % 3), null) schema",
        "if(kind in ('Created', 'Updated', 'Refreshed'), props, null) payload",
        "if(kind in ('TagAdded', 'TagDeleted'), concat('t', event_id % 3), null) tag",
        "if(kind = 'TagAdded', rev - 1, null) target_rev",
    )


def _entity(df: DataFrame, project: str, subject: str, kind: str, links: dict[str, str], literals: dict[str, tuple[str, str]]) -> DataFrame:
    """Triples of one table: rdf type, links to other subjects, literals with their datatype."""
    rows = [f"struct('type' as p, '{kind}' as o, 'iri' as kind, '' as datatype)"]
    rows += [f"struct('{p}' as p, {o} as o, 'iri' as kind, '' as datatype)" for p, o in links.items()]
    rows += [f"struct('{p}' as p, cast({o} as string) as o, 'literal' as kind, '{t}' as datatype)" for p, (o, t) in literals.items()]
    # one pass over the table, whatever the number of predicates
    return df.selectExpr(f"{subject} as s", f"explode(array({', '.join(rows)})) as t").selectExpr("'tpch' org", f"'{project}' project", "s resource", "s", "t.p p", "t.o o", "t.kind kind", "t.datatype datatype")


LINE = "concat_ws('/', 'lineitem', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(cast(l_shipdate as date) as string), cast(l_extendedprice as decimal(12,2)))"


def triples(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Triples of the named tables (all seven without names)."""
    t = lambda n: read(spark, sf_dir, n)
    money = lambda c: (f"cast({c} as decimal(12,2))", "decimal")
    parts = {
        "region": lambda: _entity(t("region"), "geo", "concat('region/', r_regionkey)", "Region", {}, {"name": ("r_name", "string")}),
        "nation": lambda: _entity(t("nation"), "geo", "concat('nation/', n_nationkey)", "Nation", {"region": "concat('region/', n_regionkey)"}, {"name": ("n_name", "string")}),
        "customer": lambda: _entity(t("customer"), "sales", "concat('customer/', c_custkey)", "Customer", {"nation": "concat('nation/', c_nationkey)"}, {"name": ("c_name", "string"), "segment": ("c_mktsegment", "string"), "balance": money("c_acctbal")}),
        "supplier": lambda: _entity(t("supplier"), "supply", "concat('supplier/', s_suppkey)", "Supplier", {"nation": "concat('nation/', s_nationkey)"}, {"name": ("s_name", "string"), "balance": money("s_acctbal")}),
        "part": lambda: _entity(t("part"), "supply", "concat('part/', p_partkey)", "Part", {}, {"name": ("p_name", "string"), "brand": ("p_brand", "string"), "size": ("p_size", "integer")}),
        "orders": lambda: _entity(t("orders"), "sales", "concat('order/', o_orderkey)", "Order", {"customer": "concat('customer/', o_custkey)"}, {"status": ("o_orderstatus", "string"), "total": money("o_totalprice"), "priority": ("o_orderpriority", "string")}),
        "lineitem": lambda: _entity(t("lineitem"), "sales", LINE, "Lineitem", {"order": "concat('order/', l_orderkey)", "part": "concat('part/', l_partkey)", "supplier": "concat('supplier/', l_suppkey)"}, {"quantity": ("cast(l_quantity as int)", "integer"), "price": money("l_extendedprice"), "flag": ("l_returnflag", "string")}),
    }
    out = None
    for name in names or parts:
        out = parts[name]() if out is None else out.unionByName(parts[name]())
    return out


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (org, project, id) -> (target_org, target_project, target_id): orders, customers, suppliers, nations, regions."""
    edge = lambda n, project, source, target_project, target: read(spark, sf_dir, n).selectExpr("'tpch' org", f"'{project}' project", f"{source} id", "'tpch' target_org", f"'{target_project}' target_project", f"{target} target_id")
    return (
        edge("nation", "geo", "concat('nation/', n_nationkey)", "geo", "concat('region/', n_regionkey)")
        .unionByName(edge("customer", "sales", "concat('customer/', c_custkey)", "geo", "concat('nation/', c_nationkey)"))
        .unionByName(edge("supplier", "supply", "concat('supplier/', s_suppkey)", "geo", "concat('nation/', s_nationkey)"))
        .unionByName(edge("orders", "sales", "concat('order/', o_orderkey)", "sales", "concat('customer/', o_custkey)"))
    )


def access_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(address, identity, permission): users of the log may read the projects they wrote to; some hold more."""
    e = read(spark, sf_dir, "events")
    own = e.selectExpr("concat('/o', user_id % 2, '/p', user_id % 5) address", "concat('u', event_id % 4) identity", "if(event_type = 'purchase', 'write', 'read') permission").filter("(identity = 'u1' or identity = 'u2') and address <> '/o0/p0'")
    org = e.filter("event_id % 4 = 3").selectExpr("concat('/o', user_id % 2) address", "'u3' identity", "'read' permission").filter("address = '/o1'")
    root = e.filter("event_id % 4 = 0").selectExpr("'/' address", "'u0' identity", "'read' permission")
    return own.unionByName(org).unionByName(root).distinct()


def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, project, deprecated, doc: an expanded JSON document for every order, its lines nested."""
    o = read(spark, sf_dir, "orders")
    line = F.struct(F.array(F.struct(F.expr("concat('part/', l_partkey)").alias("@id"))).alias("part"), F.array(F.struct(F.col("l_quantity").cast("int").alias("@value"))).alias("quantity"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("items"))
    rows = o.join(lines, "o_orderkey", "left")
    doc = F.struct(
        F.expr("concat('order/', o_orderkey)").alias("@id"),
        F.array(F.lit("Order"), F.concat(F.lit("Order"), "o_orderstatus")).alias("@type"),
        F.array(F.struct(F.expr("concat('customer/', o_custkey)").alias("@id"))).alias("customer"),
        F.array(F.struct(F.col("o_orderpriority").alias("@value"))).alias("priority"),
        F.col("items"),
    )
    return rows.select(F.expr("concat('order/', o_orderkey)").alias("id"), F.lit("sales").alias("project"), (F.col("o_orderkey") % 10 == 0).alias("deprecated"), F.to_json(doc).alias("doc"))

"""Queries over triples, dependencies, references and access lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import deps, eventlog, graph, pipes, quality
from graphloom.plans.log_queries import joined
from graphloom.plans.registry import ACLS, EDGES, LOG, STATES, TRIPLES, query
from graphloom.sources.adapters import access_list, dependencies, events_log, read, triples

KEY = ["org", "project", "id"]
STAR = ["s", "p", "o"]


@query("""SELECT 'customer/' || c_custkey AS customer, n_name AS name, 'region/' || n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def graph_match(spark, sf_dir):
    t = triples(spark, sf_dir, "customer", "nation")
    return graph.match(t, [("?customer", "type", "Customer"), ("?customer", "nation", "?nation"), ("?nation", "name", "?name"), ("?nation", "region", "?region")]).select("customer", "name", "region")


@query("SELECT DISTINCT o.s, 'inRegion' AS p, r.o FROM triples o JOIN triples c ON c.s = o.o AND c.p = 'nation' JOIN triples r ON r.s = c.o AND r.p = 'region' WHERE o.p = 'customer' UNION SELECT DISTINCT r.o, 'type', 'Market' FROM triples o JOIN triples c ON c.s = o.o AND c.p = 'nation' JOIN triples r ON r.s = c.o AND r.p = 'region' WHERE o.p = 'customer'", TRIPLES)
def graph_construct(spark, sf_dir):
    t = triples(spark, sf_dir, "orders", "customer", "nation")
    rows = graph.match(t, [("?order", "customer", "?customer"), ("?customer", "nation", "?nation"), ("?nation", "region", "?region")])
    return graph.construct(rows, [("?order", "inRegion", "?region"), ("?region", "type", "Market")])


@query("""SELECT 'customer/' || c_custkey AS customer, 'order/' || o_orderkey AS "order" FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'""")
def graph_optional(spark, sf_dir):
    t = triples(spark, sf_dir, "customer", "orders")
    return graph.match(t, [("?customer", "type", "Customer")], optional=[[("?order", "customer", "?customer"), ("?order", "priority", "1-URGENT")]]).select("customer", "order")


@query("SELECT s AS \"order\", o::DOUBLE AS total FROM triples WHERE p = 'total' AND o::DECIMAL(12,2) > 450000", TRIPLES)
def graph_filter(spark, sf_dir):
    t = triples(spark, sf_dir, "orders")
    rows = graph.match(t, [("?order", "total", "?text")])
    return rows.withColumn("total", F.col("text").try_cast("double")).filter("total > 450000").select("order", "total")


@query("""SELECT 'nation/' || n_nationkey AS nation, n_name || ' in ' || r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def graph_bind(spark, sf_dir):
    t = triples(spark, sf_dir, "nation", "region")
    rows = graph.match(t, [("?nation", "region", "?region"), ("?nation", "name", "?name"), ("?region", "name", "?where")])
    return rows.withColumn("label", F.concat("name", F.lit(" in "), "where")).select("nation", "label")


@query("""SELECT 'customer/' || c_custkey AS customer, c_mktsegment AS segment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def graph_values(spark, sf_dir):
    t = triples(spark, sf_dir, "customer", "orders")
    ids = graph.match(t, [("?order", "status", "P"), ("?order", "customer", "?customer")]).select("customer").distinct()
    return graph.match(t, [("?customer", "segment", "?segment")], ids=ids)


@query("""SELECT 'region/' || n_regionkey AS region, 'customer/' || c_custkey AS customer FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def graph_inverse_path(spark, sf_dir):
    return graph.path(triples(spark, sf_dir, "nation", "customer"), ["^region", "^nation"], "region", "customer")


@query("SELECT l.o AS \"order\", sum(q.o::BIGINT)::BIGINT AS quantity, count(*) AS lines, count(DISTINCT p.o) AS parts FROM triples l JOIN triples q ON q.s = l.s AND q.p = 'quantity' JOIN triples p ON p.s = l.s AND p.p = 'part' WHERE l.p = 'order' GROUP BY ALL", TRIPLES)
def graph_aggregate(spark, sf_dir):
    rows = graph.match(triples(spark, sf_dir, "lineitem"), [("?line", "order", "?order"), ("?line", "quantity", "?q"), ("?line", "part", "?part")])
    return rows.groupBy("order").agg(F.sum(F.col("q").try_cast("long")).alias("quantity"), F.count("*").alias("lines"), F.countDistinct("part").alias("parts"))


@query("SELECT org || '/' || project AS namespace, count(*) AS n FROM triples GROUP BY ALL", TRIPLES)
def graph_count(spark, sf_dir):
    return triples(spark, sf_dir).groupBy(F.concat_ws("/", "org", "project").alias("namespace")).agg(F.count("*").alias("n"))


@query("SELECT s, p, o FROM triples WHERE (p = 'flag' AND o = 'R') OR s = 'order/7' OR (p = 'region')", TRIPLES)
def graph_filter_triples(spark, sf_dir):
    return graph.filter_triples(triples(spark, sf_dir), [(None, "flag", "R"), ("order/7", None, None), (None, "region", None)]).select(*STAR)


@query("SELECT kind, project, count(*) AS n FROM triples GROUP BY ALL", TRIPLES)
def graph_partition(spark, sf_dir):
    links, others = graph.partition(triples(spark, sf_dir), F.col("kind") == "iri")
    return links.groupBy("kind", "project").count().union(others.groupBy("kind", "project").count()).withColumnRenamed("count", "n")


@query("SELECT DISTINCT s, p, o FROM triples WHERE s LIKE 'nation/%' OR p = 'segment'", TRIPLES)
def graph_union(spark, sf_dir):
    t = triples(spark, sf_dir, "nation", "customer").select(*STAR)
    return graph.union(t.filter("s like 'nation/%'"), t.filter("p = 'segment' or s = 'nation/1'"))


@query("SELECT s, p, o FROM triples WHERE s LIKE 'customer/%' AND NOT (p = 'segment' AND o = 'BUILDING')", TRIPLES)
def graph_minus(spark, sf_dir):
    t = triples(spark, sf_dir, "customer").select(*STAR)
    return graph.minus(t, t.filter("p = 'segment' and o = 'BUILDING'"))


@query("SELECT s, p, o FROM triples WHERE s <> 'nation/3' AND o <> 'nation/3' UNION ALL SELECT DISTINCT CASE WHEN s = 'nation/3' THEN 'nation/x' ELSE s END, p, CASE WHEN o = 'nation/3' THEN 'nation/x' ELSE o END FROM triples WHERE s = 'nation/3' OR o = 'nation/3'", TRIPLES)
def graph_replace_node(spark, sf_dir):
    return graph.replace_node(triples(spark, sf_dir).select(*STAR), "nation/3", "nation/x")


@query("SELECT resource, string_agg(DISTINCT o, ',' ORDER BY o) AS types FROM triples WHERE p = 'type' GROUP BY ALL", TRIPLES)
def graph_root_types(spark, sf_dir):
    return graph.root_types(triples(spark, sf_dir)).withColumns(joined("types"))


@query("SELECT s, min(o) AS o FROM triples WHERE p = 'name' GROUP BY ALL", TRIPLES)
def graph_find(spark, sf_dir):
    return graph.find(triples(spark, sf_dir), "name")


@query("SELECT s, p, o FROM triples WHERE NOT (s = 'nation/5' AND p IN ('name', 'type')) UNION ALL SELECT 'nation/5', 'name', 'patched'", TRIPLES)
def triples_patch(spark, sf_dir):
    t = triples(spark, sf_dir)
    new = triples(spark, sf_dir, "nation").filter("s = 'nation/5' and p = 'name'").withColumn("o", F.lit("patched"))
    return graph.patch(t, "nation/5", new, ["name", "type"], keep=False).select(*STAR)


@query("SELECT s, p, o FROM triples WHERE s LIKE 'customer/%' AND substr(s, 10)::BIGINT % 3 <> 0 AND substr(s, 10)::BIGINT % 3 <> 1 UNION ALL SELECT s, 'renewed', o FROM triples WHERE p = 'name' AND s LIKE 'customer/%' AND substr(s, 10)::BIGINT % 3 = 0", TRIPLES)
def sink_triples_replace(spark, sf_dir):
    t = triples(spark, sf_dir, "customer")
    n = F.substring_index("resource", "/", -1).cast("long") % 3
    batch = t.select(F.col("resource").alias("id"), n.alias("n")).distinct().selectExpr("id", "case n when 0 then 'Success' when 1 then 'Dropped' else 'Failed' end status")
    return graph.replace_graphs(t, batch, t.filter("p = 'name'").withColumn("p", F.lit("renewed"))).select(*STAR)


@query("SELECT t.resource, string_agg(DISTINCT t.p, ',' ORDER BY t.p) AS paths, 'Customer' AS types FROM triples t WHERE t.o = 'nation/4' AND t.resource LIKE 'customer/%' GROUP BY t.resource UNION ALL SELECT t.resource, string_agg(DISTINCT t.p, ',' ORDER BY t.p), 'Supplier' FROM triples t WHERE t.o = 'nation/4' AND t.resource LIKE 'supplier/%' GROUP BY t.resource", TRIPLES)
def links_incoming(spark, sf_dir):
    return graph.links_incoming(triples(spark, sf_dir, "customer", "supplier", "nation"), "nation/4").withColumns(joined("paths", "types"))


@query("SELECT o AS target, p AS paths, CASE WHEN p = 'customer' THEN 'Customer' END AS types FROM triples WHERE s = 'order/3' AND kind = 'iri' AND p <> 'type'", TRIPLES)
def links_outgoing(spark, sf_dir):
    return graph.links_outgoing(triples(spark, sf_dir, "orders", "customer"), "order/3").withColumns(joined("paths", "types"))


@query("SELECT s AS nation, o AS name, NULL::VARCHAR AS segment FROM triples WHERE p = 'name' AND s LIKE 'nation/%' UNION ALL SELECT NULL, NULL, o FROM triples WHERE p = 'segment'", TRIPLES)
def bindings_concat(spark, sf_dir):
    t = triples(spark, sf_dir, "nation", "customer")
    names = graph.match(t, [("?nation", "region", "?r"), ("?nation", "name", "?name")]).select("nation", "name")
    return graph.concat_bindings(names, graph.match(t, [("?c", "segment", "?segment")]).select("segment"))


@query("SELECT org || '/' || project AS namespace, count(*) AS n, CASE WHEN project <> 'geo' THEN 'view of ' || project END AS view FROM triples GROUP BY ALL", TRIPLES)
def triples_per_view(spark, sf_dir):
    t = triples(spark, sf_dir)
    views = t.filter("project <> 'geo'").select(F.concat_ws("/", "org", "project").alias("namespace"), F.concat(F.lit("view of "), "project").alias("view")).distinct()
    return graph.triples_per_view(t, views)


@query("SELECT resource, s, p, o FROM triples WHERE s LIKE 'supplier/%' AND p IN ('name', 'nation') OR s LIKE 'nation/%'", TRIPLES)
def select_predicates(spark, sf_dir):
    return pipes.select_predicates(triples(spark, sf_dir, "supplier", "nation"), ["name", "nation"], ["Nation"]).select("resource", *STAR)


@query("SELECT resource, p, o FROM triples WHERE s LIKE 'part/%' AND p IN ('name', 'type')", TRIPLES)
def default_label_predicates(spark, sf_dir):
    return pipes.default_label_predicates(triples(spark, sf_dir, "part")).select("resource", "p", "o")


@query("SELECT resource, string_agg('<' || s || '> <' || p || '> ' || CASE WHEN kind = 'iri' THEN '<' || o || '>' WHEN datatype = 'string' THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || datatype || '>' END || ' .', chr(10) ORDER BY '<' || s || '> <' || p || '> ' || CASE WHEN kind = 'iri' THEN '<' || o || '>' WHEN datatype = 'string' THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || datatype || '>' END || ' .') AS ntriples FROM triples WHERE s LIKE 'customer/%' GROUP BY ALL", TRIPLES)
def to_ntriples(spark, sf_dir):
    return pipes.to_ntriples(triples(spark, sf_dir, "customer"))


@query(
    """SELECT 'order/' || o_orderkey AS id, 'Success' AS status, '{"@id":"' || CASE WHEN o_orderkey % 2 = 0 THEN 'src/' ELSE 'order/' END || o_orderkey || '","@type":"Order","customer":"customer/' || o_custkey || '","note":{"a":1},"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '","total":"' || o_totalprice::DECIMAL(12,2)::VARCHAR || '"}' AS document FROM orders
       UNION ALL SELECT 'part/' || p_partkey, 'Success', '{"@id":"part/' || p_partkey || '","brand":"' || p_brand || '","name":"' || p_name || '","size":"' || p_size || '","type":"Part"}' FROM part
       UNION ALL SELECT 'supplier/' || s_suppkey, 'Dropped', NULL FROM supplier"""
)
def to_document(spark, sf_dir):
    """Sources merged with compact graphs: orders with a source, parts without one, suppliers with neither."""
    t = triples(spark, sf_dir, "orders", "part")
    typed = pipes.to_documents(t).select(F.col("resource").alias("id"), F.col("document").alias("typed"))
    graphs = typed.join(pipes.to_documents(t.filter("p <> 'type'")).withColumnRenamed("resource", "id"), "id", "left")
    source = """concat('{"@context":{"x":"y"},', if(o_orderkey % 2 = 0, concat('"@id":"src/', o_orderkey, '",'), ''), '"@type":"Order","note":{"a":1,"@context":"z"},"total":"none"}')"""
    elements = read(spark, sf_dir, "orders").selectExpr("concat('order/', o_orderkey) id", "'Success' status", f"{source} source")
    elements = elements.unionByName(read(spark, sf_dir, "part").selectExpr("concat('part/', p_partkey) id", "'Success' status", "'{}' source"))
    elements = elements.unionByName(read(spark, sf_dir, "supplier").selectExpr("concat('supplier/', s_suppkey) id", "'Success' status", "cast(null as string) source"))
    return pipes.resource_documents(elements, graphs).select("id", "status", "document")


# dependencies and references


@query(
    f"""WITH RECURSIVE {EDGES}, reach AS (SELECT org AS start_org, project AS start_project, id AS start_id, target_org AS org, target_project AS project, target_id AS id FROM edges
        UNION SELECT r.start_org, r.start_project, r.start_id, e.target_org, e.target_project, e.target_id FROM reach r JOIN edges e ON e.org = r.org AND e.project = r.project AND e.id = r.id) SELECT * FROM reach"""
)
def dep_closure(spark, sf_dir):
    e = dependencies(spark, sf_dir)
    return deps.closure(e, e.select(*KEY).distinct())


@query("SELECT DISTINCT target_org AS org, target_project AS project, target_id AS id FROM edges WHERE project = 'sales'", EDGES)
def dep_direct(spark, sf_dir):
    e = dependencies(spark, sf_dir)
    return deps.direct(e, e.filter("project = 'sales'").select(*KEY).distinct())


@query("SELECT * FROM edges WHERE target_project = 'geo' AND project <> 'geo'", EDGES)
def dep_external_refs(spark, sf_dir):
    return deps.external_references(dependencies(spark, sf_dir), "tpch", "geo")


@query("SELECT * FROM edges WHERE NOT (project = 'geo') UNION SELECT org, project, id, target_org, target_project, 'region/0' FROM edges WHERE project = 'geo'", EDGES)
def dep_replace(spark, sf_dir):
    e = dependencies(spark, sf_dir)
    own = e.filter("project = 'geo'").withColumn("target_id", F.lit("region/0"))
    return deps.replace_edges(e, own.unionByName(own.withColumn("target_id", F.col("id"))))


REFS = "refs AS (SELECT DISTINCT org, project, CASE WHEN rev % 3 = 0 THEN 'x' || id ELSE id END AS id FROM log)"


def _refs(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.selectExpr("org", "project", "if(rev % 3 = 0, concat('x', id), id) id").distinct(), eventlog.states(log)


@query("SELECT r.org, r.project, r.id, s.rev, s.payload FROM refs r JOIN states s USING (org, project, id) WHERE s.tag = 'latest'", f"{STATES}, {REFS}")
def dep_states(spark, sf_dir):
    refs, states = _refs(spark, sf_dir)
    return deps.with_states(refs, states).select(*KEY, "rev", "payload")


@query("SELECT * FROM refs EXCEPT SELECT org, project, id FROM states WHERE tag = 'latest' AND NOT deprecated", f"{STATES}, {REFS}")
def missing_or_deprecated(spark, sf_dir):
    return deps.missing_or_deprecated(*_refs(spark, sf_dir))


@query("SELECT org, project, id FROM refs EXCEPT ALL SELECT org, project, id FROM states WHERE tag = 'latest'", f"{STATES}, {REFS}")
def requested_minus_found(spark, sf_dir):
    refs, states = _refs(spark, sf_dir)
    return refs.exceptAll(states.filter("tag = 'latest'").select(*KEY))


@query("SELECT org, project, id, type FROM states WHERE tag = 'latest' AND id = 'r14'", STATES)
def find_type(spark, sf_dir):
    return eventlog.states(events_log(spark, sf_dir)).filter("tag = 'latest' and id = 'r14'").select(*KEY, "type")


OPEN = "open AS (SELECT DISTINCT org, project FROM log WHERE EXISTS (SELECT 1 FROM acls WHERE permission = 'read' AND identity IN ('u1', 'u3') AND address IN ('/', '/' || org, '/' || org || '/' || project)))"


@query("SELECT * FROM open", f"{LOG}, {ACLS}, {OPEN}")
def project_scope(spark, sf_dir):
    projects = events_log(spark, sf_dir).select("org", "project").distinct()
    return deps.readable_projects(projects, access_list(spark, sf_dir), ["u1", "u3"])


@query("SELECT DISTINCT '/' || org || '/' || project AS address, 'write' AS permission FROM log WHERE EXISTS (SELECT 1 FROM acls WHERE permission = 'write' AND identity IN ('u2') AND address IN ('/', '/' || org, '/' || org || '/' || project))", f"{LOG}, {ACLS}")
def acl_grant(spark, sf_dir):
    rows = events_log(spark, sf_dir).selectExpr("concat('/', org, '/', project) address", "'write' permission").distinct()
    return deps.granted(rows, access_list(spark, sf_dir), ["u2"])


@query("SELECT DISTINCT '/' || org || '/' || project AS address, 'write' AS permission FROM log WHERE NOT EXISTS (SELECT 1 FROM acls WHERE permission = 'write' AND identity IN ('u2') AND address IN ('/', '/' || org, '/' || org || '/' || project))", f"{LOG}, {ACLS}")
def acl_filter_values(spark, sf_dir):
    rows = events_log(spark, sf_dir).selectExpr("concat('/', org, '/', project) address", "'write' permission").distinct()
    return deps.not_granted(rows, access_list(spark, sf_dir), ["u2"])


@query("SELECT DISTINCT address FROM acls WHERE identity IN ('u1', 'u0') AND permission = 'read' AND (address IN ('/', '/o1') OR address LIKE '/o1/%')", ACLS)
def acl_addresses(spark, sf_dir):
    return deps.acl_addresses(access_list(spark, sf_dir), ["u1", "u0"], "read", "/o1")


@query("SELECT asked, address, identity, permission FROM (SELECT DISTINCT address AS asked FROM acls) JOIN acls ON address IN ('/', '/' || split_part(asked, '/', 2), asked) WHERE identity IN ('u0', 'u1', 'u3')", ACLS)
def acl_self(spark, sf_dir):
    """What a caller holds at every address and at those above it."""
    acls = access_list(spark, sf_dir)
    return deps.acl_self(acls, acls.select("address").distinct(), ["u0", "u1", "u3"])


@query("SELECT DISTINCT address, identity, permission FROM (SELECT address, identity, permission FROM acls UNION ALL SELECT address, 'u9', permission FROM acls) WHERE NOT (permission = 'write' AND identity = 'u1') AND NOT (permission = 'write' AND identity = 'u9')", ACLS)
def acl_change(spark, sf_dir):
    """Entries added for one more identity, then some taken away."""
    acls = access_list(spark, sf_dir)
    more = deps.acl_add(acls, acls.withColumn("identity", F.lit("u9")))
    return deps.acl_subtract(more, more.filter("permission = 'write' and identity in ('u1', 'u9')"))


@query("SELECT r.org, r.project, r.id, rn AS position, CASE WHEN NOT EXISTS (SELECT 1 FROM open o WHERE o.org = r.org AND o.project = r.project) THEN 'AuthorizationFailed' WHEN s.rev IS NULL THEN 'NotFound' ELSE 'Found' END AS status, CASE WHEN EXISTS (SELECT 1 FROM open o WHERE o.org = r.org AND o.project = r.project) THEN s.rev END AS rev FROM (SELECT *, row_number() OVER (ORDER BY org, project, id) AS rn FROM refs) r LEFT JOIN (SELECT * FROM states WHERE tag = 'latest') s USING (org, project, id)", f"{STATES}, {ACLS}, {OPEN}, {REFS}")
def multi_fetch(spark, sf_dir):
    """All references, numbered by their keys over all projects, as one request."""
    refs, states = _refs(spark, sf_dir)
    return deps.multi_fetch(deps.numbered(refs, *KEY), states, access_list(spark, sf_dir), ["u1", "u3"])


RESOLVE = """resolvers AS (SELECT * FROM (VALUES ('a', 1, 0, 'o0', 'p1', ['T1']), ('a', 1, 1, 'o1', 'p1', ['T1']), ('b', 2, 0, 'o0', 'p2', NULL), ('b', 2, 1, 'o1', 'p3', NULL), ('b', 2, 2, 'o0', 'p0', NULL)) t(resolver, priority, place, org, project, types)),
wanted AS (SELECT DISTINCT id FROM refs),
tries AS (SELECT w.id, r.*, s.rev, CASE WHEN s.rev IS NULL THEN 'NotFound' WHEN r.types IS NOT NULL AND NOT list_has_any(s.types, r.types) THEN 'TypeMismatch' WHEN s.deprecated THEN 'Deprecated' ELSE 'Resolved' END AS verdict,
          row_number() OVER (PARTITION BY w.id ORDER BY priority, resolver, place) AS n FROM wanted w CROSS JOIN resolvers r LEFT JOIN (SELECT * FROM states WHERE tag = 'latest') s ON s.id = w.id AND s.org = r.org AND s.project = r.project),
firsts AS (SELECT id, min(n) FILTER (verdict = 'Resolved') AS winner FROM tries GROUP BY id)"""


@query("SELECT t.id, max(resolver) FILTER (n = winner) AS resolver, max(org || '/' || project) FILTER (n = winner) AS found_in, coalesce(string_agg(resolver || ':' || verdict, ',' ORDER BY n) FILTER (verdict <> 'Resolved'), '') AS history FROM tries t JOIN firsts f USING (id) WHERE winner IS NULL OR n <= winner GROUP BY t.id", f"{STATES}, {REFS}, {RESOLVE}")
def resolve_by_priority(spark, sf_dir):
    refs, states = _refs(spark, sf_dir)
    resolvers = spark.sql("select * from values ('a', 1, 0, 'o0', 'p1', array('T1')), ('a', 1, 1, 'o1', 'p1', array('T1')), ('b', 2, 0, 'o0', 'p2', null), ('b', 2, 1, 'o1', 'p3', null), ('b', 2, 2, 'o0', 'p0', null) as t(resolver, priority, place, org, project, types)")
    return deps.resolve_across(refs.select("id").distinct(), resolvers, states)


@query("SELECT org, project, rev AS priority, count(*) AS n FROM states WHERE tag = 'latest' AND NOT deprecated GROUP BY ALL HAVING count(*) > 1", STATES)
def priority_conflict(spark, sf_dir):
    rows = eventlog.latest_states(events_log(spark, sf_dir)).withColumnRenamed("rev", "priority")
    return deps.priority_conflicts(rows)


@query("SELECT r.id, count(s.id) AS n, CASE WHEN count(s.id) = 0 THEN 'NotFound' WHEN count(s.id) = 1 THEN 'SingleResult' ELSE 'MultipleResults' END AS verdict FROM (SELECT DISTINCT id FROM refs) r LEFT JOIN (SELECT s.id FROM states s JOIN open USING (org, project) WHERE tag = 'latest') s USING (id) GROUP BY r.id", f"{STATES}, {ACLS}, {OPEN}, {REFS}")
def id_resolution(spark, sf_dir):
    refs, states = _refs(spark, sf_dir)
    open_ones = deps.readable_projects(states.select("org", "project").distinct(), access_list(spark, sf_dir), ["u1", "u3"])
    return deps.id_resolution(states, refs.select("id").distinct(), open_ones)


@query("SELECT id, source, CASE WHEN source IS NULL THEN 'NotFound' WHEN source = 'resource' AND id NOT IN (SELECT id FROM states WHERE list_contains(types, 'T1')) THEN 'NotAnOntology' END AS rejection FROM (SELECT id, CASE WHEN id IN (SELECT id FROM states WHERE type = 'File') THEN 'schema' WHEN id IN (SELECT id FROM states WHERE type = 'Resource') THEN 'resource' END AS source FROM (SELECT DISTINCT id FROM refs))", f"{STATES}, {REFS}")
def import_closure(spark, sf_dir):
    """Imports of schemas, resources (ontologies only) and of what isn't there, with the reason of each rejection."""
    refs, states = _refs(spark, sf_dir)
    return deps.import_closure(refs.select("id").distinct(), states.filter("type = 'File'"), states.filter("type = 'Resource'"), "T1")


@query(
    f"""WITH RECURSIVE {EDGES}, reach AS (SELECT org AS start_org, project AS start_project, id AS start_id, target_org AS org, target_project AS project, target_id AS id FROM edges WHERE id LIKE 'customer/%'
        UNION SELECT r.start_org, r.start_project, r.start_id, e.target_org, e.target_project, e.target_id FROM reach r JOIN edges e ON e.id = r.id) SELECT * FROM reach WHERE id LIKE 'region/%'"""
)
def view_expand(spark, sf_dir):
    e = dependencies(spark, sf_dir)
    keys = e.select(*KEY).union(e.select("target_org", "target_project", "target_id").toDF(*KEY)).distinct()
    views = keys.filter("id not like 'order/%'").selectExpr(*KEY, "id not like 'region/%' aggregate", "id like 'nation/%' deprecated", "'read' permission")
    acls = keys.selectExpr("'/tpch' address", "'u1' identity", "'read' permission").distinct()
    return deps.expand_views(views, e.filter("id not like 'order/%'"), acls, ["u1"]).filter("start_id like 'customer/%'")


# quality


SHAPES = "shapes AS (SELECT * FROM (VALUES ('Customer', 'nation', 1, 1, ''), ('Customer', 'label', 1, NULL, 'string'), ('Order', 'total', 1, 1, 'string'), ('Part', 'size', 0, 1, 'integer')) t(type, path, min_count, max_count, datatype))"
CHECKED = """checked AS (SELECT t.s AS resource, t.o AS type, h.path, count(x.s) AS n, CASE WHEN count(x.s) < min_count THEN 'minCount' WHEN count(x.s) > max_count THEN 'maxCount' WHEN count(*) FILTER (x.datatype <> h.datatype) > 0 THEN 'datatype' END AS violation
FROM triples t JOIN shapes h ON t.p = 'type' AND t.o = h.type LEFT JOIN triples x ON x.s = t.s AND x.p = h.path GROUP BY t.s, t.o, h.path, min_count, max_count, h.datatype)"""


def _report(spark, sf_dir):
    shapes = spark.sql("select * from values ('Customer', 'nation', 1, 1, ''), ('Customer', 'label', 1, null, 'string'), ('Order', 'total', 1, 1, 'string'), ('Part', 'size', 0, 1, 'integer') as t(type, path, min_count, max_count, datatype)")
    return quality.constraint_check(triples(spark, sf_dir), shapes)


@query("SELECT resource, type, path, n, violation FROM checked", f"{TRIPLES}, {SHAPES}, {CHECKED}")
def constraint_check(spark, sf_dir):
    return _report(spark, sf_dir)


@query("SELECT count(DISTINCT resource) AS targeted, count(violation) AS violations, CASE WHEN count(DISTINCT resource) = 0 THEN 'NoTargetedNode' WHEN count(violation) > 0 THEN 'Invalid' ELSE 'Valid' END AS verdict FROM checked", f"{TRIPLES}, {SHAPES}, {CHECKED}")
def validate_project(spark, sf_dir):
    return quality.conforms(_report(spark, sf_dir))


@query("SELECT s AS id, CASE WHEN number % 10 = 0 OR t NOT IN ('Customer', 'Order', 'Part') THEN 'Dropped' WHEN t = 'Part' THEN 'Success' ELSE 'Failed' END AS status, CASE WHEN number % 10 = 0 THEN NULL WHEN t = 'Customer' THEN 'label:minCount' WHEN t = 'Order' THEN 'total:datatype' END AS violations FROM (SELECT *, split_part(s, '/', 2)::BIGINT AS number FROM subjects)", TRIPLES)
def validate_resources(spark, sf_dir):
    """Each resource of all projects against its shapes; deprecated ones (here: each tenth) and types without a shape are skipped."""
    t = triples(spark, sf_dir).filter("p = 'type'").select(F.col("s").alias("id"), (F.split("s", "/")[1].cast("long") % 10 == 0).alias("deprecated"))
    return quality.validate(t, _report(spark, sf_dir)).select("id", "status", "violations")


@query("SELECT id, CASE WHEN id LIKE 'r1%' THEN 'ReservedId' WHEN list_contains(types, 'T3') THEN 'ReservedType' END AS rejection FROM states WHERE tag = 'latest'", STATES)
def reserved_checks(spark, sf_dir):
    return quality.reserved_checks(eventlog.latest_states(events_log(spark, sf_dir)), "r1", ["T3"]).select("id", "rejection")

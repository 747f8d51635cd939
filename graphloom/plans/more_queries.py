"""Further scans, sinks, resolvers and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from graphloom.functions import iri, json_text, sets
from graphloom.operators import analytics, deps, eventlog, feed, graph, listing, pipes, sinks, stats
from graphloom.plans.listing_queries import ADMITTED, DOCS, STREAMED, _feed, _indexed, _props, _run, _stream
from graphloom.plans.log_queries import joined
from graphloom.plans.registry import ACLS, EDGES, FEED, LOG, STATES, TRIPLES, query
from graphloom.sources.adapters import access_list, dependencies, events_log, nested_orders, read, triples
from graphloom.sources.nquads import parse_nquads, resources_of
from graphloom.streaming import activity, feeds, projections
from graphloom.streaming.index import KeyedIndex
from graphloom.streaming.references import ReferenceIndex

KEY = ["org", "project", "id"]


def _latest(spark, sf_dir) -> DataFrame:
    return eventlog.latest_states(events_log(spark, sf_dir))


# scans


@query("SELECT type, id, rev, ordering FROM states WHERE tag = 'latest' AND ordering > 200", STATES)
def scan_global_states(spark, sf_dir):
    """Unscoped states are the same table without org and project."""
    rows = _latest(spark, sf_dir).drop("org", "project")
    return rows.filter(feed.after(200)).orderBy("ordering").select("type", "id", "rev", "ordering")


@query("SELECT id, ordering FROM log WHERE kind = 'Deprecated' AND ordering > 300 AND ordering % 2 = 1", LOG)
def scan_restarts(spark, sf_dir):
    """Requests (here: deprecations) after an offset that aren't acknowledged."""
    rows = events_log(spark, sf_dir).filter("kind = 'Deprecated'").withColumn("acknowledged", F.col("ordering") % 2 == 0)
    return rows.filter(feed.after(300) & ~F.col("acknowledged")).orderBy("ordering").select("id", "ordering")


@query("""SELECT org, project, 'o' || org AS label, count(*) AS n FROM log WHERE project = 'p1' GROUP BY ALL""", LOG)
def scan_reports(spark, sf_dir):
    """Reports are JSON texts; those of a project by a path into them."""
    log = events_log(spark, sf_dir).groupBy("org", "project").agg(F.count("*").alias("n"))
    reports = log.select(F.to_json(F.struct("org", "project", "n", F.concat(F.lit("o"), "org").alias("label"))).alias("value"))
    rows = reports.filter(F.get_json_object("value", "$.project") == "p1")
    return rows.select(F.from_json("value", "org string, project string, label string, n long").alias("v")).select("v.*")


@query("SELECT 'main' AS projection, max(ordering) AS \"offset\" FROM st", STREAMED)
def scan_progress(spark, sf_dir):
    out = _run(spark, sf_dir, pipes.chain())
    return projections.read_progress(spark, out).select("projection", "offset")


@query("SELECT org, project, id, ordering FROM st", STREAMED)
def scan_continuous(spark, sf_dir):
    """The feed under a processing-time trigger, stopped once all that is there has been read."""
    elements, out = _stream(spark, sf_dir)
    running = projections.run_projection(elements, pipes.chain(), out, name="continuous", checkpoint=f"{out}-checkpoint", continuous="1 second")
    running.processAllAvailable()
    running.stop()
    return spark.read.parquet(f"{out}/elements").select(*KEY, "ordering")


@query("SELECT resource AS id, count(*) AS n, string_agg(DISTINCT o, ',' ORDER BY o) FILTER (p = 'type') AS types FROM triples WHERE project = 'sales' AND s NOT LIKE 'lineitem/%' GROUP BY resource", TRIPLES)
def scan_graph_resources(spark, sf_dir):
    """Resources with their graphs as arrays."""
    rows = sinks.graph_resources(triples(spark, sf_dir, "customer", "orders"))
    return rows.select("id", F.size("graph").cast("long").alias("n"), "types").withColumns(joined("types"))


@query("SELECT id, rev, NULL::VARCHAR AS payload FROM states WHERE tag = 'latest' AND org = 'o0' AND project = 'p2'", STATES)
def scan_composite_source(spark, sf_dir):
    return _latest(spark, sf_dir).filter(feed.scope("o0", "p2")).select("id", "rev", F.lit(None).cast("string").alias("payload"))


@query("SELECT s AS id, 'Success' AS status, 's/' || split_part(s, '/', 2) AS schema, false AS deprecated, 5::BIGINT AS n_data FROM (SELECT 'customer/' || c_custkey AS s FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'customer/' || c_custkey, 'Failed', NULL, NULL, 5 FROM customer WHERE c_custkey % 2 = 1")
def nquads_to_resource(spark, sf_dir):
    t = triples(spark, sf_dir, "customer")
    lines = t.select(F.format_string("<%s> <%s> %s <g> .", "s", "p", F.when(F.col("kind") == "iri", F.format_string("<%s>", "o")).otherwise(F.format_string('"%s"', "o"))).alias("value"))
    even = t.filter("p = 'type'").filter(F.substring_index("s", "/", -1).cast("long") % 2 == 0)
    meta = even.select(F.explode(F.array(F.format_string("<%s> <meta:schema> <s/%s> <g> .", "s", F.substring_index("s", "/", -1)), F.format_string('<%s> <meta:deprecated> "false" <g> .', "s"))).alias("value"))
    return resources_of(parse_nquads(lines.unionByName(meta)), schema="meta:schema", deprecated="meta:deprecated")


# sinks


@query("SELECT org || '/' || project || '_' || id AS key, ordering FROM (SELECT *, row_number() OVER (PARTITION BY org, project, id ORDER BY ordering DESC) AS n FROM st) WHERE n = 1 AND status = 'Success'", STREAMED)
def sink_main_index(spark, sf_dir):
    """The documents of one project's index, by a name that tells projects apart."""
    rows = _indexed(spark, sf_dir).read()
    return rows.select(F.concat_ws("_", F.concat_ws("/", "org", "project"), "id").alias("key"), "ordering")


@query("SELECT count(*) AS n FROM st WHERE ordering % 7 = 0", STREAMED)
def sink_failures(spark, sf_dir):
    out = _run(spark, sf_dir, pipes.generic_pipe(F.when(F.col("ordering") % 7 != 0, 1)))
    return spark.read.parquet(f"{out}/failures").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM log", LOG)
def sink_noop(spark, sf_dir):
    log = events_log(spark, sf_dir)
    log.write.format("noop").mode("overwrite").save()
    return log.agg(F.count("*").alias("n"))


@query("SELECT id, path, ref, CASE WHEN c_custkey % 4 = 0 THEN 'Renamed' WHEN c_custkey IS NOT NULL THEN 'Customer,' || c_mktsegment END AS found_types FROM entries LEFT JOIN customer ON ref = 'customer/' || c_custkey WHERE ref IS NOT NULL", DOCS)
def sink_graph_analytics(spark, sf_dir):
    """Documents with their references over two batches; the second one brings types, and documents of the first are refreshed."""
    index = ReferenceIndex(spark, f"{deps.shared_folder(spark).rstrip('/')}/analytics-{uuid.uuid4().hex}")
    docs = nested_orders(spark, sf_dir).select("project", "id", F.substring_index("id", "/", -1).cast("long").alias("ordering"), F.lit("index").alias("action"), F.array(F.lit("Order")).alias("types"), "deprecated", "doc")
    people = read(spark, sf_dir, "customer").selectExpr("'sales' project", "concat('customer/', c_custkey) id", "c_custkey ordering", "'update' action", "array('Customer', c_mktsegment) types", "false deprecated", "cast(null as string) doc")
    index.handle(docs.unionByName(people.filter("ordering % 2 = 0")), 0)
    renamed = people.filter("ordering % 4 = 0").withColumn("types", F.array(F.lit("Renamed")))
    index.handle(people.filter("ordering % 2 = 1").unionByName(renamed), 1)
    rows = index.read().select("id", F.explode("references").alias("r"))
    return rows.select("id", "r.path", "r.ref", "r.found_types").withColumns(joined("found_types"))


@query("""SELECT 'order/' || o_orderkey AS id, '{"@id":"order/' || o_orderkey || '","nation":"' || n_name || '"}' AS document FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P' AND o_orderkey % 5 <> 0""")
def sink_composite_batch(spark, sf_dir):
    """Chunks of elements through a view's query into an index: one join for a chunk, and its documents as one delta; a later chunk deletes some."""
    t = triples(spark, sf_dir, "orders", "customer", "nation")
    elements = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").selectExpr("concat('order/', o_orderkey) id", "o_orderkey ordering", "'Success' status")
    patterns = [("?id", "customer", "?c"), ("?c", "nation", "?n"), ("?n", "name", "?nation")]
    index = KeyedIndex(spark, f"{deps.shared_folder(spark).rstrip('/')}/view-{uuid.uuid4().hex}", ["id"], buckets=4)
    for batch_id, chunk in enumerate((elements, elements.filter("ordering % 5 = 0").withColumn("status", F.lit("Dropped")))):
        index.write_batch(sinks.composite(chunk, t, patterns, [("?id", "nation", "?nation")], pipes.to_documents), batch_id)
    return index.read().select("id", "document")


@query("SELECT 'orders/' || o_orderkey || '.json' AS path, '{\"status\":\"' || o_orderstatus || '\"}' AS content FROM customer JOIN orders ON o_orderkey = c_custkey")
def archive_bundle(spark, sf_dir):
    """Requested references written as a bundle of parts with a manifest, and read back; missing ones are skipped."""
    asked = read(spark, sf_dir, "customer").selectExpr("concat('order/', c_custkey) id", "'compacted' representation")
    have = read(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("compacted"))
    bundled = sinks.bundle(asked, have, F.concat(F.lit("orders/"), F.substring_index("id", "/", -1), F.lit(".json")))
    out = f"{deps.shared_folder(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    projections.write_bundle(sinks.bundle_contents(bundled, have, ["compacted"]), out)
    return projections.read_bundle(spark, out)


@query("SELECT DISTINCT s, 'label' AS p, o FROM triples WHERE s LIKE 'nation/%' AND p = 'name'", TRIPLES)
def data_construct_query(spark, sf_dir):
    """A construction with each resource's own graph as its scope."""
    t = triples(spark, sf_dir, "nation")
    return graph.construct(graph.match(t, [("?s", "type", "Nation"), ("?s", "name", "?name")]), [("?s", "label", "?name")])


@query("SELECT id, 'Success' AS status, count(*) OVER () AS tapped, max(ordering) OVER () AS last FROM states WHERE tag = 'latest'", STATES)
def tap(spark, sf_dir):
    """The elements pass on; what is observed on the way into a sink is read afterwards, without a second pass."""
    out = f"{deps.shared_folder(spark).rstrip('/')}/tapped-{uuid.uuid4().hex}"
    seen = Observation()
    rows = _latest(spark, sf_dir).select("id", F.lit("Success").alias("status"), "ordering")
    rows.observe(seen, F.count(F.lit(1)).alias("n"), F.max("ordering").alias("last")).write.parquet(out)
    return spark.read.parquet(out).select("id", "status", F.lit(seen.get["n"]).cast("long").alias("tapped"), F.lit(seen.get["last"]).cast("long").alias("last"))


@query("SELECT id, 'Processing ' || id || ' of ' || org || '/' || project || ' at ' || ordering || CASE WHEN deprecated THEN ' (deprecated)' ELSE '' END AS line FROM states WHERE tag = 'latest'", STATES)
def log_element(spark, sf_dir):
    """A line for every element."""
    line = F.concat(F.lit("Processing "), "id", F.lit(" of "), "org", F.lit("/"), "project", F.lit(" at "), F.col("ordering").cast("string"), F.when(F.col("deprecated"), " (deprecated)").otherwise(""))
    return _latest(spark, sf_dir).select("id", line.alias("line"))


# references


@query(
    f"""WITH RECURSIVE {EDGES}, reach AS (SELECT id AS start_id, target_id AS id FROM edges WHERE id LIKE 'order/%' UNION SELECT r.start_id, e.target_id FROM reach r JOIN edges e ON e.id = r.id)
        SELECT start_id, 'nation/' || n_nationkey AS id, n_name AS payload FROM reach JOIN nation ON id = 'nation/' || n_nationkey"""
)
def dep_recursive_states(spark, sf_dir):
    e = dependencies(spark, sf_dir)
    reach = deps.closure(e, e.filter("id like 'order/%'").select(*KEY).distinct())
    states = read(spark, sf_dir, "nation").selectExpr("'tpch' org", "'geo' project", "concat('nation/', n_nationkey) id", "n_name payload", "'latest' tag")
    return deps.with_states(reach, states).select("start_id", "id", "payload")


RESOLVED = "SELECT l.org, l.project, l.id, CASE WHEN s.rev IS NULL THEN 'NotFound' WHEN s.deprecated THEN 'Deprecated' ELSE 'Resolved' END AS verdict FROM (SELECT DISTINCT org, project, CASE WHEN rev % 2 = 0 THEN id ELSE 'y' || id END AS id FROM log) l LEFT JOIN (SELECT * FROM states WHERE tag = 'latest') s USING (org, project, id)"


@query(RESOLVED, STATES)
def resolve_in_project(spark, sf_dir):
    log = events_log(spark, sf_dir)
    refs = log.selectExpr("org", "project", "if(rev % 2 = 0, id, concat('y', id)) id").distinct()
    return deps.resolve_in_project(refs, eventlog.latest_states(log))


@query("SELECT id, max(org || '/' || project) AS found_in FROM states WHERE tag = 'latest' AND NOT deprecated AND (org, project) IN (('o0', 'p0'), ('o1', 'p1'), ('o0', 'p2')) GROUP BY id UNION ALL SELECT id, NULL FROM (SELECT DISTINCT id FROM log) WHERE id NOT IN (SELECT id FROM states WHERE tag = 'latest' AND NOT deprecated AND (org, project) IN (('o0', 'p0'), ('o1', 'p1'), ('o0', 'p2')))", STATES)
def resolve_cross_project(spark, sf_dir):
    log = events_log(spark, sf_dir)
    resolver = spark.sql("select * from values ('x', 1, 0, 'o0', 'p0', cast(null as array<string>)), ('x', 1, 1, 'o1', 'p1', null), ('x', 1, 2, 'o0', 'p2', null) as t(resolver, priority, place, org, project, types)")
    return deps.resolve_across(log.select("id").distinct(), resolver, eventlog.latest_states(log)).select("id", "found_in")


@query("SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rev) AS n FROM log WHERE kind NOT IN ('Created', 'TagDeleted')) WHERE n = 1", LOG)
def first_match(spark, sf_dir):
    order = Window.partitionBy("id").orderBy("rev")
    rows = events_log(spark, sf_dir).filter(~F.col("kind").isin("Created", "TagDeleted"))
    return rows.withColumn("n", F.row_number().over(order)).filter("n = 1").select("id", "kind")


@query("SELECT DISTINCT org, project, id FROM log WHERE ((org = 'o1' AND project IN ('p1', 'p3')) OR (org = 'o0' AND project = 'p4')) AND EXISTS (SELECT 1 FROM acls WHERE permission = 'read' AND identity = 'u2' AND address IN ('/', '/' || org, '/' || org || '/' || project))", f"{LOG}, {ACLS}")
def search_targets(spark, sf_dir):
    """Projections of a suite's projects and one more, as far as the caller may read them."""
    views = events_log(spark, sf_dir).select(*KEY).distinct()
    suite = views.filter("org = 'o1' and project in ('p1', 'p3')").union(views.filter("org = 'o0' and project = 'p4'")).distinct()
    open_ones = deps.readable_projects(suite.select("org", "project").distinct(), access_list(spark, sf_dir), ["u2"])
    return suite.join(open_ones, ["org", "project"], "left_semi").select(*KEY)


@query("SELECT s AS resource, count(DISTINCT p || o)::BIGINT AS n FROM triples WHERE s LIKE 'nation/%' GROUP BY s", TRIPLES)
def ntriples_merge(spark, sf_dir):
    """Two texts of lines as one set of lines, without blank ones."""
    t = triples(spark, sf_dir, "nation")
    left, right = pipes.to_ntriples(t), pipes.to_ntriples(t.filter("p <> 'type'")).withColumnRenamed("ntriples", "other")
    both = left.join(right, "resource")
    lines = F.filter(F.array_union(F.split("ntriples", "\n"), F.split(F.concat("other", F.lit("\n\n")), "\n")), lambda x: x != "")
    return both.select("resource", F.size(lines).cast("long").alias("n"))


# composite projections


@query("SELECT project AS source, org AS target, count(*) AS processed, (SELECT count(*) FROM feed) - count(*) AS remaining FROM feed GROUP BY ALL", FEED)
def composite_statistics(spark, sf_dir):
    log = events_log(spark, sf_dir)
    changes = feed.state_changes(eventlog.states(log), eventlog.tombstones(log))
    done = feed.projection_progress(changes, "project", "org").withColumnsRenamed({"project": "source", "org": "target"})
    n = changes.agg(F.count("*").alias("n"), F.max("instant").alias("last_instant"))
    total = done.select("source", "target").withColumn("n", n.select("n").scalar()).withColumn("last_instant", n.select("last_instant").scalar())
    return feed.progress_statistics(done, total, "source", "target").select("source", "target", "processed", "remaining")


@query("SELECT project AS source, org AS target, max(ordering) AS \"offset\" FROM feed WHERE org = 'o1' GROUP BY ALL", FEED)
def composite_offsets(spark, sf_dir):
    log = events_log(spark, sf_dir)
    done = feed.projection_progress(feed.state_changes(eventlog.states(log), eventlog.tombstones(log)), "project", "org")
    return done.filter("org = 'o1'").select(F.col("project").alias("source"), F.col("org").alias("target"), "offset").orderBy("source", "target")


@query("SELECT 'a' AS source, count(*) AS n FROM st WHERE event_type = 'view' UNION ALL SELECT 'b', count(*) FROM st WHERE event_type = 'click'", STREAMED)
def source_merge(spark, sf_dir):
    """Two streams as one."""
    a, out = _stream(spark, sf_dir)
    b, _ = _stream(spark, sf_dir)
    both = a.filter("event_type = 'view'").withColumn("source", F.lit("a")).unionByName(b.filter("event_type = 'click'").withColumn("source", F.lit("b")))
    projections.run_projection(both, pipes.chain(), out, name="merged", checkpoint=f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/elements").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT org, project, max(instant) + INTERVAL 30 MINUTE > (SELECT max(instant) FROM st) AS active FROM st GROUP BY ALL", STREAMED)
def project_activity_changes(spark, sf_dir):
    """Changes by state and timers on event time; the last one of each project says whether it's active at the end."""
    elements, out = _stream(spark, sf_dir)
    changes = activity.activity_changes(elements, 30 * 60)
    changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return activity.last_changes(spark.read.schema(activity.CHANGE).parquet(out))


@query("SELECT 'even' AS target, count(*) AS kept FROM st WHERE ordering % 2 = 0 UNION ALL SELECT 'odd', count(*) FROM st WHERE ordering % 2 = 1", STREAMED)
def source_broadcast(spark, sf_dir):
    elements, out = _stream(spark, sf_dir)
    targets = {"even": pipes.dropped_if(F.col("ordering") % 2 == 1), "odd": pipes.dropped_if(F.col("ordering") % 2 == 0)}
    projections.run_composite(elements, pipes.chain(), targets, out, source="events", checkpoint=f"{out}-checkpoint").awaitTermination()
    rows = [spark.read.parquet(f"{out}/{t}/elements").filter("status = 'Success'").agg(F.count("*").alias("kept")).select(F.lit(t).alias("target"), "kept") for t in targets]
    return rows[0].union(rows[1])


@query(f"SELECT (event_id - 100) // {ADMITTED} AS batch_id, count(*) AS n, min(event_id + 1) AS first, max(event_id + 1) AS last FROM events WHERE event_id > 99 GROUP BY ALL")
def micro_batch(spark, sf_dir):
    """Batches of so many elements at most, from a given offset on."""
    out = f"{deps.shared_folder(spark).rstrip('/')}/batches-{uuid.uuid4().hex}"
    _feed(spark, sf_dir, feeds.into_batches(out, pipes.chain()), out, start=99)
    rows = spark.read.parquet(out)
    return rows.groupBy(F.col("batch_id").cast("long").alias("batch_id")).agg(F.count("*").alias("n"), F.min("ordering").alias("first"), F.max("ordering").alias("last"))


@query("SELECT 'main' AS projection, count(*) AS processed, max(ordering) AS \"offset\" FROM st", STREAMED)
def projection_reset(spark, sf_dir):
    """A projection that is reset after its run processes everything once more: without its checkpoint from the beginning."""
    elements, out = _stream(spark, sf_dir)
    run = lambda: projections.run_projection(elements, pipes.chain(), out, name="main", checkpoint=f"{out}-checkpoint").awaitTermination()
    run()
    projections.reset(spark, out, f"{out}-checkpoint")
    run()
    return projections.read_progress(spark, out).select("projection", "processed", "offset")


@query("SELECT st.id, ordering, rank FROM st JOIN (SELECT 'r' || user_id AS id, count(*) AS rank FROM events GROUP BY user_id) USING (id)", STREAMED)
def remote_elements(spark, sf_dir):
    """A stream enriched by a table."""
    elements, out = _stream(spark, sf_dir)
    ranks = read(spark, sf_dir, "events").groupBy(F.concat(F.lit("r"), "user_id").alias("id")).agg(F.count("*").alias("rank"))
    projections.run_projection(elements.join(ranks, "id"), pipes.chain(), out, name="remote", checkpoint=f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/elements").select("id", "ordering", "rank")


# deletion, ephemeral states


@query("SELECT id, subject, instant + INTERVAL 1 DAY AS expires FROM states WHERE tag = 'latest' AND instant + INTERVAL 1 DAY > TIMESTAMP '2024-01-25'", STATES)
def ephemeral_get(spark, sf_dir):
    """States that live for a day and haven't expired at a given moment."""
    day = F.expr("interval 1 day")
    rows = eventlog.expire(_latest(spark, sf_dir), "instant", F.expr("timestamp_ntz '2024-01-25'"), day)
    return rows.select("id", "subject", (F.col("instant") + day).alias("expires"))


@query("SELECT target_project AS project, count(*) > 0 AS blocked FROM edges WHERE project <> target_project GROUP BY ALL", EDGES)
def deletion_blocked(spark, sf_dir):
    e = dependencies(spark, sf_dir)
    return deps.external_references(e, "tpch", "geo").groupBy(F.col("target_project").alias("project")).agg((F.count("*") > 0).alias("blocked"))


# functions


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a":1,"x":[1]}' ELSE '{"a":1}' END AS j FROM events""")
def json_add_if_non_empty(spark, sf_dir):
    value = F.when(F.col("event_id") % 2 == 0, "[1]").otherwise("[]")
    return _props(spark, sf_dir).select("event_id", json_text.json_add_if_non_empty(F.lit('{"a":1}'), "x", value).alias("j"))


@query("SELECT DISTINCT 'https://x.org/' || user_id AS iri FROM events")
def ref_strip(spark, sf_dir):
    return read(spark, sf_dir, "events").select(iri.ref_iri(F.concat(F.lit("https://x.org/"), "user_id", F.lit("?rev="), "event_id")).alias("iri")).distinct()


@query("SELECT s_suppkey, s_name || ' / ' || s_nationkey AS path FROM supplier")
def path_join(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", iri.path_join(F.array("s_name", F.col("s_nationkey").cast("string"))).alias("path"))


@query("SELECT id, rev FROM log WHERE instant > TIMESTAMP '2024-01-02 12:00:00'", LOG)
def time_range_parse(spark, sf_dir):
    return events_log(spark, sf_dir).filter(listing.in_range("instant", listing.parse_range("2024-01-02 12:00:00..*"))).select("id", "rev")


@query("SELECT id, floor((epoch_us(max(instant)) - epoch_us(min(instant))) / 1000000)::BIGINT AS delay FROM log GROUP BY id", LOG)
def delay_seconds(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("id").agg(feed.delay_seconds(F.max("instant"), F.min("instant")).alias("delay"))


@query("SELECT id, max(instant) < TIMESTAMP '2024-01-25' AS idle FROM log GROUP BY id", LOG)
def is_idle(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("id").agg((F.max("instant") < F.expr("timestamp_ntz '2024-01-25'")).alias("idle"))


@query("""SELECT 'order/' || o_orderkey AS resource, '{"@id":"order/' || o_orderkey || '","customer":"customer/' || o_custkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '","total":"' || o_totalprice::DECIMAL(12,2)::VARCHAR || '","type":"Order"}' AS document FROM orders""")
def triples_to_document(spark, sf_dir):
    return pipes.to_documents(triples(spark, sf_dir, "orders"))


@query("SELECT id, CASE WHEN deprecated OR NOT list_contains(types, 'T1') THEN 'Dropped' ELSE 'Success' END AS status FROM states WHERE tag = 'latest'", STATES)
def pipe_registry(spark, sf_dir):
    """Pipes named in settings, looked up and chained."""
    settings = [("filterDeprecated", {}), ("filterByType", {"types": ["T1"]})]
    rows = _latest(spark, sf_dir).withColumn("status", F.lit("Success"))
    return rows.transform(pipes.chain(*(pipes.lookup(name, **config) for name, config in settings))).select("id", "status")


CHAINS = {"good": [("filterDeprecated", {}), ("filterByType", {"types": ["T1"]})], "unfit": [("filterDeprecated", {}), ("filterBySchema", {"schemas": ["s1"]})], "unknown": [("filterByNothing", {})]}


@query("SELECT chain, error, CASE WHEN error IS NULL THEN (SELECT count(*) FROM states WHERE tag = 'latest' AND NOT deprecated AND list_contains(types, 'T1')) END AS passed FROM (VALUES ('good', NULL), ('unfit', 'MismatchedPipe: filterBySchema needs [''schema'']'), ('unknown', 'UnknownPipe: ''filterByNothing''')) t(chain, error)", STATES)
def chain_validate(spark, sf_dir):
    """Chains against the feed's columns: those that fit run, others are refused with the reason before any row is read."""
    rows = _latest(spark, sf_dir).withColumn("status", F.lit("Success")).drop("schema")
    out = None
    for name, settings in CHAINS.items():
        error = pipes.validate(rows, settings)
        if error is None:
            one = rows.transform(pipes.chain(*(pipes.lookup(n, **c) for n, c in settings))).agg(F.count_if(F.col("status") == "Success").alias("passed"))
        else:
            one = spark.range(1).select(F.lit(None).cast("long").alias("passed"))
        one = one.select(F.lit(name).alias("chain"), F.lit(error).cast("string").alias("error"), "passed")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, rev, list_has_any(types, ['T1', 'K2']) AS overlap, array_to_string(list_sort(list_filter(types, lambda x: x NOT IN ('T1', 'K2'))), ',') AS removed, array_to_string(list_sort(list_distinct(list_concat(types, ['T1', 'K2']))), ',') AS united FROM log WHERE types IS NOT NULL", LOG)
def types_sets(spark, sf_dir):
    """Overlap, difference and union of the types of each revision with given ones."""
    own, given = F.col("types"), F.array(F.lit("T1"), F.lit("K2"))
    rows = events_log(spark, sf_dir).filter("types is not null")
    return rows.select("id", "rev", sets.types_overlap(own, given).alias("overlap"), sets.types_removed(own, given).alias("removed"), sets.types_union(own, given).alias("united")).withColumns(joined("removed", "united"))


@query(
    """SELECT l.id, coalesce(max(put), '') AS put, coalesce(max(removed), '') AS removed, coalesce(max(merged), '') AS merged FROM (SELECT DISTINCT id FROM log) l
       LEFT JOIN (SELECT id, string_agg(tag || '=' || v, ',' ORDER BY tag) AS put FROM (SELECT id, tag, target_rev AS v FROM tagged WHERE kind = 'TagAdded' AND tag <> 't1' UNION ALL SELECT id, 't1', max(rev) FROM log GROUP BY id) GROUP BY id) USING (id)
       LEFT JOIN (SELECT id, string_agg(tag || '=' || target_rev, ',' ORDER BY tag) AS removed FROM tagged WHERE kind = 'TagAdded' AND tag <> 't1' GROUP BY id) USING (id)
       LEFT JOIN (SELECT id, string_agg(tag || '=' || v, ',' ORDER BY tag) AS merged FROM (SELECT id, tag, target_rev AS v FROM tagged WHERE kind = 'TagAdded' AND tag NOT IN ('t0', 'v') UNION ALL SELECT id, unnest(['t0', 'v']), 0 FROM (SELECT DISTINCT id FROM log)) GROUP BY id) USING (id)
       GROUP BY l.id""",
    STATES,
)
def tags_map(spark, sf_dir):
    """The tags of each resource after a tag is put, removed, and after a merge with given tags."""
    tags, given = F.col("tags"), F.create_map(F.lit("t0"), F.lit(0), F.lit("v"), F.lit(0))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    rows = eventlog.fold_states(events_log(spark, sf_dir))
    return rows.select("id", text(sets.tags_put(tags, "t1", F.col("rev"))).alias("put"), text(sets.tags_remove(tags, "t1")).alias("removed"), text(sets.tags_merge(tags, given)).alias("merged"))


# functions of the user, composite views, graphs of documents


@query("SELECT id, CASE WHEN deprecated THEN 'Dropped' WHEN rev % 5 = 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN NOT deprecated AND rev % 5 <> 0 THEN 100 // (rev % 5) END::BIGINT AS value, CASE WHEN NOT deprecated AND rev % 5 = 0 THEN 'ZeroDivisionError' END AS value_error FROM states WHERE tag = 'latest'", STATES)
def function_pipe(spark, sf_dir):
    """A user's Python function; where it raises, that element alone fails."""
    rows = _latest(spark, sf_dir).withColumn("status", F.lit("Success"))
    return rows.transform(pipes.chain(pipes.lookup("filterDeprecated"), pipes.function_pipe(lambda row: 100 // (row["rev"] % 5), ["rev"], "bigint"))).select("id", "status", "value", "value_error")


@query("""SELECT 'order/' || o_orderkey AS id, CASE WHEN n_name IS NULL THEN 'Dropped' ELSE 'Success' END AS status, '{"@id":"order/' || o_orderkey || '","nation":"' || n_name || '"}' AS document FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P' LEFT JOIN nation ON n_nationkey = c_nationkey""")
def sink_composite_single(spark, sf_dir):
    """Every element through a view's query and transformation; elements are rows, so single ones and chunks are alike."""
    t = triples(spark, sf_dir, "orders", "customer", "nation")
    elements = read(spark, sf_dir, "orders").selectExpr("concat('order/', o_orderkey) id", "'Success' status")
    patterns = [("?id", "status", "P"), ("?id", "customer", "?c"), ("?c", "nation", "?n"), ("?n", "name", "?nation")]
    return sinks.composite(elements, t, patterns, [("?id", "nation", "?nation")], pipes.to_documents)


@query("""SELECT n, 'orders/' || o_orderkey || '.json' AS path, CASE WHEN n % 2 = 0 THEN o_orderpriority ELSE '{"status":"' || o_orderstatus || '"}' END AS content FROM (SELECT c_custkey AS n FROM customer) JOIN orders ON o_orderkey = n""")
def archive_contents(spark, sf_dir):
    """The entries of a bundle with the representation that each request names."""
    asked = read(spark, sf_dir, "customer").selectExpr("c_custkey n", "concat('order/', c_custkey) id", "if(c_custkey % 2 = 0, 'source', 'compacted') representation")
    have = read(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("compacted"))
    bundled = sinks.bundle(asked, have, F.concat(F.lit("orders/"), F.substring_index("id", "/", -1), F.lit(".json")))
    return sinks.bundle_contents(bundled, have, ["source", "compacted"]).select("n", "path", "content")


@query(
    """SELECT resource, s, x[1] AS p, x[2] AS o, x[3] AS kind, x[4] AS datatype, count(*) AS n FROM (
         SELECT 'order/' || o_orderkey AS resource, 'order/' || o_orderkey AS s, unnest([('type', 'Order', 'iri', ''), ('type', 'Order' || o_orderstatus, 'iri', ''), ('customer', 'customer/' || o_custkey, 'iri', ''), ('priority', o_orderpriority, 'literal', 'string')]) AS x FROM orders
         UNION ALL SELECT 'order/' || l_orderkey, '_', unnest([('part', 'part/' || l_partkey, 'iri', ''), ('quantity', l_quantity::INTEGER::VARCHAR, 'literal', 'integer')]) FROM lineitem JOIN orders ON o_orderkey = l_orderkey
         UNION ALL SELECT 'order/' || l_orderkey, 'order/' || l_orderkey, ('items', '_', 'blank', '') FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       GROUP BY ALL"""
)
def jsonld_graph(spark, sf_dir):
    """The whole graph of documents; blank nodes, whose names follow the order of an array, without their names."""
    unnamed = lambda c: F.when(F.col(c).startswith("_:"), "_").otherwise(F.col(c)).alias(c)
    rows = analytics.document_graph(nested_orders(spark, sf_dir)).select("resource", unnamed("s"), "p", F.when(F.col("kind") == "blank", "_").otherwise(F.col("o")).alias("o"), "kind", "datatype")
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query(
    """WITH items AS (SELECT l_orderkey AS k, list_sort(list('{"part":{"@id":"part/' || l_partkey || '"},"quantity":' || l_quantity::INTEGER || '}')) AS v FROM lineitem GROUP BY l_orderkey)
       SELECT 'order/' || o_orderkey AS resource, '{"@id":"order/' || o_orderkey || '","@type":["Order","Order' || o_orderstatus || '"],"customer":{"@id":"customer/' || o_custkey || '"},'
         || CASE WHEN v IS NULL THEN '' WHEN len(v) = 1 THEN '"items":' || v[1] || ',' ELSE '"items":[' || array_to_string(v, ',') || '],' END || '"priority":"' || o_orderpriority || '"}' AS document
       FROM orders LEFT JOIN items ON k = o_orderkey"""
)
def triples_to_nested_document(spark, sf_dir):
    """Documents to triples and back, with nested nodes, references and numbers."""
    return pipes.nested_documents(analytics.document_graph(nested_orders(spark, sf_dir)))


@query("SELECT org, project, count(*) AS n FROM states WHERE tag = 'latest' GROUP BY ALL", STATES)
def scan_state_counts(spark, sf_dir):
    return stats.project_statistics(_latest(spark, sf_dir)).select("org", "project", F.col("resources").alias("n"))

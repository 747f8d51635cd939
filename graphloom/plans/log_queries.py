"""Queries of the event log, the feed, pipes and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.iri import tag_valid
from graphloom.operators import eventlog, feed, pipes, stats
from graphloom.operators.listing import in_range, page, search_after
from graphloom.plans.registry import FEED, LOG, STATES, query
from graphloom.sources.adapters import events_log, read

KEY = ["org", "project", "id"]


def joined(*columns):
    """Arrays as texts, so that engines compare alike."""
    return {c: F.array_join(c, ",") for c in columns}


def _tables(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log, eventlog.states(log), eventlog.tombstones(log)


@query("SELECT *, 'Success' AS status FROM (SELECT org, project, id, type, count(*) AS n FROM log GROUP BY ALL)", LOG, name="list_ids")
def list_ids(spark, sf_dir):
    return events_log(spark, sf_dir).groupBy("org", "project", "id", "type").agg(F.count("*").alias("n")).withColumn("status", F.lit("Success"))


@query(
    """SELECT l.org, l.project, l.id, max(rev) AS rev, max(l.ordering) AS ordering, list_aggregate(arg_max(types, rev) FILTER (kind IN ('Created','Updated','Refreshed')), 'string_agg', ',') AS types,
       arg_max(schema, rev) FILTER (kind IN ('Created','Updated','SchemaUpdated')) AS schema, arg_max(payload, rev) FILTER (kind IN ('Created','Updated','Refreshed')) AS payload,
       arg_max(kind = 'Deprecated', rev) FILTER (kind IN ('Created','Deprecated','Undeprecated')) AS deprecated, min(instant) AS created_at, arg_max(instant, rev) AS updated_at, arg_min(subject, rev) AS created_by, arg_max(subject, rev) AS updated_by,
       coalesce((SELECT string_agg(tag || '=' || target_rev, ',' ORDER BY tag) FROM tagged t WHERE t.id = l.id AND t.kind = 'TagAdded'), '') AS tags, true AS valid
       FROM log l GROUP BY ALL""",
    STATES,
)
def fold_states(spark, sf_dir):
    s = eventlog.fold_states(events_log(spark, sf_dir))
    tags = F.coalesce(F.array_join(F.transform(F.map_entries("tags"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","), F.lit(""))
    return s.withColumns(joined("types") | {"tags": tags}).drop("type")


@query("SELECT org, project, id, rev, kind, instant, subject FROM log WHERE id = 'r1' AND rev <= 20", LOG)
def scan_history(spark, sf_dir):
    return eventlog.history(events_log(spark, sf_dir), "r1", 20).select(*KEY, "rev", "kind", "instant", "subject")


@query("SELECT org, project, id, max(rev) AS rev, CASE WHEN max(rev) = 40 THEN 'Found' ELSE 'InvalidRevision' END AS status, arg_max(kind = 'Deprecated', rev) FILTER (kind IN ('Created','Deprecated','Undeprecated')) AS deprecated FROM log WHERE rev <= 40 GROUP BY ALL", LOG)
def state_at_rev(spark, sf_dir):
    return eventlog.state_at_rev(events_log(spark, sf_dir), 40).select(*KEY, "rev", "status", "deprecated")


@query("SELECT r.org, r.project, r.id, r.tag, s.rev, CASE WHEN s.rev IS NOT NULL THEN 'Found' WHEN r.id IN (SELECT id FROM states) THEN 'TagNotFound' ELSE 'NotFound' END AS status FROM (SELECT DISTINCT org, project, CASE WHEN rev % 2 = 0 THEN id ELSE 'x' || id END AS id, 't' || (rev % 4) AS tag FROM log) r LEFT JOIN states s ON s.id = r.id AND s.tag = r.tag", STATES)
def state_at_tag(spark, sf_dir):
    log, states, _ = _tables(spark, sf_dir)
    asked = log.selectExpr("org", "project", "if(rev % 2 = 0, id, concat('x', id)) id", "concat('t', rev % 4) tag").distinct()
    return eventlog.state_at_tag(states, asked)


@query("SELECT org, project, id, tag, rev, ordering, deprecated, list_aggregate(types, 'string_agg', ',') AS types FROM states WHERE tag <> 'latest'", STATES)
def tag_snapshot(spark, sf_dir):
    return eventlog.tag_snapshots(events_log(spark, sf_dir)).select(*KEY, "tag", "rev", "ordering", "deprecated", "types").withColumns(joined("types"))


@query("SELECT org, project, id, tag, deleted, instant, ordering FROM tombs WHERE deleted", STATES)
def tag_delete(spark, sf_dir):
    return eventlog.tag_tombstones(events_log(spark, sf_dir)).select(*KEY, "tag", "deleted", "instant", "ordering")


@query("SELECT org, project, id, tag, rev, ordering, instant, deprecated, schema, payload, list_aggregate(types, 'string_agg', ',') AS types FROM states WHERE tag = 'latest'", STATES)
def latest_state(spark, sf_dir):
    return eventlog.latest_states(events_log(spark, sf_dir)).select(*KEY, "tag", "rev", "ordering", "instant", "deprecated", "schema", "payload", "types").withColumns(joined("types"))


@query("SELECT org, project, id, ordering, instant, list_aggregate(types, 'string_agg', ',') AS types FROM tombs WHERE NOT deleted", STATES)
def type_tombstones(spark, sf_dir):
    return eventlog.type_tombstones(events_log(spark, sf_dir)).select(*KEY, "ordering", "instant", "types").withColumns(joined("types"))


@query("SELECT id, rev, coalesce(row_number() OVER w = 1 OR lag(types) OVER w IS DISTINCT FROM types OR lag(payload) OVER w IS DISTINCT FROM payload, true) AS changed FROM log WHERE kind IN ('Created','Updated','Refreshed') WINDOW w AS (PARTITION BY id ORDER BY rev)", LOG)
def change_detection(spark, sf_dir):
    return eventlog.change_detection(events_log(spark, sf_dir)).select("id", "rev", "changed")


@query("SELECT type, org, project, id, tag, rev, instant, ordering, status FROM feed WHERE ordering > 100", FEED)
def scan_state_changes(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.state_changes(states, tombs, offset=100)


@query("SELECT id, tag, rev, ordering, 'Success' AS status FROM states WHERE tag = 'latest' AND org = 'o1' AND list_contains(types, 'K1') UNION ALL SELECT id, tag, -1, ordering, 'Dropped' FROM tombs WHERE tag = 'latest' AND org = 'o1' AND (deleted OR list_contains(types, 'K1'))", STATES)
def select_filter(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.state_changes(states, tombs, where=feed.scope("o1"), types=["K1"]).select("id", "tag", "rev", "ordering", "status")


@query("SELECT id, tag, rev, ordering, 'Success' AS status FROM states WHERE tag = 't1' UNION ALL SELECT id, tag, -1, ordering, 'Dropped' FROM tombs WHERE tag = 't1' AND deleted", STATES)
def union_all_feed(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.state_changes(states, tombs, tag="t1").select("id", "tag", "rev", "ordering", "status")


@query("SELECT id, ordering, status, CASE WHEN status = 'Success' THEN (payload->>'k')::BIGINT END AS k FROM (SELECT f.*, s.payload FROM feed f LEFT JOIN states s ON s.id = f.id AND s.tag = f.tag AND s.ordering = f.ordering)", FEED)
def scan_state_values(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.state_values(states, tombs, "k long").select("id", "ordering", "status", F.col("value.k").alias("k"))


@query("SELECT type, org, project, id, rev, instant, ordering, 'Success' AS status FROM log WHERE ordering > 50 AND type = 'Resource' UNION SELECT type, org, project, id, -1, instant, ordering, 'Dropped' FROM tombs WHERE deleted AND ordering > 50 AND type = 'Resource'", STATES)
def scan_events(spark, sf_dir):
    log, _, tombs = _tables(spark, sf_dir)
    return feed.event_feed(log, tombs, offset=50, entities=["Resource"])


@query("SELECT DISTINCT type, org, project, id, rev, ordering FROM (SELECT type, org, project, id, rev, ordering FROM log UNION SELECT type, org, project, id, -1, ordering FROM tombs WHERE deleted)", STATES)
def union_distinct_feed(spark, sf_dir):
    log, _, tombs = _tables(spark, sf_dir)
    return feed.event_feed(log, tombs).select("type", *KEY, "rev", "ordering").distinct()


@query("SELECT org, project, id, rev FROM states WHERE tag = 'latest' AND type = 'File' AND org = 'o0'", STATES)
def scan_current_states(spark, sf_dir):
    _, states, _ = _tables(spark, sf_dir)
    return states.filter(feed.scope("o0") & feed.of_entities(["File"]) & (F.col("tag") == "latest")).select(*KEY, "rev")


@query("SELECT id, rev FROM states WHERE tag = 'latest' AND org = 'o1' AND project = 'p3'", STATES)
def scope_filter(spark, sf_dir):
    _, states, _ = _tables(spark, sf_dir)
    return states.filter(feed.scope("o1", "p3") & (F.col("tag") == "latest")).select("id", "rev")


@query("SELECT id, rev, ordering FROM log WHERE ordering > 500", LOG)
def offset_filter(spark, sf_dir):
    return events_log(spark, sf_dir).filter(feed.after(500)).select("id", "rev", "ordering")


@query("SELECT id, rev FROM log WHERE type IN ('File')", LOG)
def entity_type_filter(spark, sf_dir):
    return events_log(spark, sf_dir).filter(feed.of_entities(["File"])).select("id", "rev")


@query("SELECT id, rev, instant FROM log WHERE instant > TIMESTAMP '2024-01-02' AND instant < TIMESTAMP '2024-01-05'", LOG)
def time_range_filter(spark, sf_dir):
    return events_log(spark, sf_dir).filter(in_range("instant", ("2024-01-02", "2024-01-05"))).select("id", "rev", "instant")


@query("SELECT org, project, id, tag, status, ordering FROM feed QUALIFY row_number() OVER (PARTITION BY org, project, id ORDER BY ordering DESC, status, tag) = 1", FEED)
def last_per_key(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.last_per_key(feed.state_changes(states, tombs)).select(*KEY, "tag", "status", "ordering")


@query("SELECT count(*) AS n, max(instant) AS last_instant FROM states WHERE tag = 'latest' AND ordering > 1000 HAVING count(*) > 0", STATES)
def remaining(spark, sf_dir):
    _, states, _ = _tables(spark, sf_dir)
    return feed.remaining(states, offset=1000)


@query("SELECT type, org, project, id, ordering, status FROM feed ORDER BY ordering LIMIT 30", FEED)
def order_by_offset(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.state_changes(states, tombs).orderBy("ordering").limit(30).select("type", *KEY, "ordering", "status")


PROGRESS = "SELECT org, project, count(*) AS processed, count(*) FILTER (status = 'Dropped') AS discarded, count(*) FILTER (status = 'Failed') AS failed, max(ordering) AS \"offset\", max(instant) AS instant"


@query(f"{PROGRESS} FROM feed GROUP BY ALL", FEED)
def projection_progress(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.projection_progress(feed.state_changes(states, tombs), "org", "project")


@query(
    f"""SELECT org, project, coalesce(processed, 0) AS processed, coalesce(discarded, 0) AS discarded, coalesce(failed, 0) AS failed, coalesce(processed - discarded - failed, 0) AS evaluated, coalesce(n, 0) - coalesce(processed, 0) AS remaining, coalesce(n, 0) AS total,
       floor((epoch_us(last_instant) - epoch_us(p.instant)) / 1000000)::BIGINT AS delay_seconds
       FROM ({PROGRESS} FROM feed WHERE ordering <= 5000 AND org = 'o0' GROUP BY ALL) p FULL JOIN (SELECT org, project, count(*) AS n, max(instant) AS last_instant FROM feed GROUP BY ALL) t USING (org, project)""",
    FEED,
)
def progress_statistics(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    changes = feed.state_changes(states, tombs)
    done = feed.projection_progress(changes.filter("ordering <= 5000 and org = 'o0'"), "org", "project")
    total = changes.groupBy("org", "project").agg(F.count("*").alias("n"), F.max("instant").alias("last_instant"))
    return feed.progress_statistics(done, total, "org", "project")


@query("SELECT org, project, arg_max(instant, ordering) AS last_instant, max(ordering) AS last_ordering FROM feed GROUP BY ALL", FEED)
def sink_last_updates(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.last_updates(feed.state_changes(states, tombs))


@query("SELECT org, project, arg_max(instant, ordering) > TIMESTAMP '2024-01-20' - INTERVAL 3 DAY AS active FROM log GROUP BY ALL", LOG)
def project_activity(spark, sf_dir):
    from graphloom.streaming.projections import project_activity as active

    return active(feed.last_updates(events_log(spark, sf_dir)), F.expr("timestamp_ntz '2024-01-20'"), F.expr("interval 3 days"))


@query("SELECT id, CASE WHEN ordering % 3 = 0 OR ordering % 5 = 0 THEN 'Failed' ELSE status END AS status, CASE WHEN ordering % 3 = 0 THEN 'MissingInResponse' WHEN ordering % 5 = 0 THEN 'IndexingFailure' END AS reason FROM feed WHERE status = 'Success'", FEED)
def mark_outcomes(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    batch = feed.state_changes(states, tombs).filter("status = 'Success'")
    answers = batch.filter("ordering % 3 <> 0").selectExpr("org", "project", "id", "if(ordering % 5 = 0, 'refused', null) error")
    return feed.mark_outcomes(batch, answers).select("id", "status", "reason")


@query("""SELECT CASE WHEN status = 'Dropped' THEN 'Deleted' ELSE 'Indexed' END AS event, ordering AS id, CASE WHEN status = 'Dropped' THEN 'Dropped' ELSE '{"org":"' || org || '","project":"' || project || '","resource":"' || id || '","rev":' || rev || '}' END AS data FROM feed""", FEED)
def feed_encode(spark, sf_dir):
    _, states, tombs = _tables(spark, sf_dir)
    return feed.feed_records(feed.state_changes(states, tombs))


# pipes


def _elements(spark, sf_dir):
    return eventlog.latest_states(events_log(spark, sf_dir)).withColumns({"status": F.lit("Success"), "metadata": F.col("subject")})


@query("SELECT id, CASE WHEN deprecated THEN 'Dropped' ELSE 'Success' END AS status FROM states WHERE tag = 'latest'", STATES)
def filter_deprecated(spark, sf_dir):
    return _elements(spark, sf_dir).transform(pipes.lookup("filterDeprecated")).select("id", "status")


@query("SELECT id, CASE WHEN list_contains(types, 'T1') OR list_contains(types, 'K2') THEN 'Success' ELSE 'Dropped' END AS status FROM states WHERE tag = 'latest'", STATES)
def filter_by_type(spark, sf_dir):
    return _elements(spark, sf_dir).transform(pipes.lookup("filterByType", types=["T1", "K2"])).select("id", "status")


@query("SELECT id, CASE WHEN schema = 's1' THEN 'Success' ELSE 'Dropped' END AS status FROM states WHERE tag = 'latest'", STATES)
def filter_by_schema(spark, sf_dir):
    return _elements(spark, sf_dir).withColumn("schema", F.concat("schema", F.lit("?rev=2"))).transform(pipes.lookup("filterBySchema", schemas=["s1"])).select("id", "status")


@query("SELECT id, NULL::VARCHAR AS metadata, rev FROM states WHERE tag = 'latest'", STATES)
def discard_metadata(spark, sf_dir):
    return _elements(spark, sf_dir).transform(pipes.lookup("discardMetadata")).select("id", "metadata", "rev")


@query("SELECT id, payload AS original_source, NULL::VARCHAR AS payload FROM states WHERE tag = 'latest'", STATES)
def source_as_text(spark, sf_dir):
    return _elements(spark, sf_dir).transform(pipes.lookup("sourceAsText")).select("id", "original_source", "payload")


@query("SELECT id, CASE WHEN schema IN ('s0', 's1') AND list_contains(types, 'T2') AND NOT deprecated THEN 'Success' ELSE 'Dropped' END AS status, NULL::VARCHAR AS metadata FROM states WHERE tag = 'latest'", STATES)
def compile_chain(spark, sf_dir):
    return _elements(spark, sf_dir).transform(pipes.compile_chain(["s0", "s1"], ["T2"])).select("id", "status", "metadata")


@query("SELECT id, CASE WHEN (payload->>'k')::BIGINT % 10 = 0 THEN 'Failed' ELSE 'Success' END AS status, CASE WHEN (payload->>'k')::BIGINT % 10 <> 0 THEN 100 // ((payload->>'k')::BIGINT % 10) END AS value FROM states WHERE tag = 'latest'", STATES)
def error_isolation(spark, sf_dir):
    k = F.get_json_object("payload", "$.k").cast("long") % 10
    # the quotient by zero is null, and so a failure of its element alone
    return _elements(spark, sf_dir).transform(pipes.generic_pipe(F.floor(F.try_divide(F.lit(100), k)))).select("id", "status", "value")


@query("SELECT id, CASE WHEN deprecated THEN 'Dropped' ELSE 'Success' END AS status, CASE WHEN NOT deprecated THEN upper(subject) END AS value FROM states WHERE tag = 'latest'", STATES)
def generic_pipe(spark, sf_dir):
    return _elements(spark, sf_dir).transform(pipes.chain(pipes.lookup("filterDeprecated"), pipes.generic_pipe(F.upper("subject")))).select("id", "status", "value")


# statistics


@query("SELECT org, project, count(*) AS resources, sum(rev)::BIGINT AS events, max(instant) AS last_instant FROM states WHERE tag = 'latest' GROUP BY ALL", STATES)
def project_statistics(spark, sf_dir):
    # the latest state of a resource needs only its last revision: one aggregation, no sort
    last = events_log(spark, sf_dir).groupBy(*KEY).agg(F.max("rev").alias("rev"), F.max_by("instant", "rev").alias("instant"))
    return stats.project_statistics(last)


@query("SELECT id, rev, instant, subject, CASE WHEN kind = 'TagAdded' THEN 'Tagged' ELSE kind END AS action, list_aggregate(types, 'string_agg', ',') AS types FROM running", STATES)
def event_metrics(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return stats.event_metrics(log, eventlog.running_states(log)).select("id", "rev", "instant", "subject", "action", "types").withColumns(joined("action", "types"))


@query("SELECT id, rev, CASE WHEN kind = 'TagAdded' THEN 'Tagged' ELSE kind END AS action FROM running WHERE id = 'r3' AND org = 'o1' ORDER BY rev LIMIT 2000", STATES)
def resource_history(spark, sf_dir):
    log = events_log(spark, sf_dir).filter("id = 'r3' and org = 'o1'")
    return stats.event_metrics(log, eventlog.running_states(log)).orderBy("rev").limit(2000).select("id", "rev", "action").withColumns(joined("action"))


@query("SELECT org, project, count(*) AS n FROM log l WHERE NOT EXISTS (SELECT 1 FROM log d WHERE d.id = l.id AND d.kind = 'Deprecated' AND d.rev = 2) GROUP BY ALL", LOG)
def sink_event_metrics(spark, sf_dir):
    log = events_log(spark, sf_dir)
    metrics = log.select(*KEY, "rev", "kind")
    dropped = log.filter("kind = 'Deprecated' and rev = 2").select(*KEY)
    return stats.append_metrics(metrics.filter("rev <= 30"), metrics.filter("rev >= 20"), dropped).groupBy("org", "project").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT lang AS project, source AS storage, n_chars, doc_id FROM documents), s AS (SELECT DISTINCT lang AS project, source AS storage FROM documents UNION SELECT 'en', 'unknown') SELECT project, storage, count(doc_id) AS files, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM s LEFT JOIN m USING (project, storage) GROUP BY ALL")
def storage_statistics(spark, sf_dir):
    metrics = read(spark, sf_dir, "documents").selectExpr("lang project", "source storage", "n_chars bytes", "1 new_file")
    storages = metrics.select("project", "storage").distinct().union(metrics.limit(1).selectExpr("'en'", "'unknown'"))
    return stats.storage_statistics(metrics, storages)


@query("SELECT count(*) FILTER (NOT deleted) AS types, count(*) FILTER (deleted) AS tags FROM tombs", STATES)
def tombstone_count(spark, sf_dir):
    return _tables(spark, sf_dir)[2].agg(F.count_if(~F.col("deleted")).alias("types"), F.count_if("deleted").alias("tags"))


@query("SELECT project AS source, CASE WHEN org = 'o0' THEN 'main' ELSE 'rebuild' END AS run, min(o) AS \"offset\" FROM (SELECT project, org, id, max(ordering) AS o FROM log GROUP BY ALL) GROUP BY ALL", LOG)
def composite_source_offset(spark, sf_dir):
    branches = events_log(spark, sf_dir).groupBy("project", "org", "id").agg(F.max("ordering").alias("offset")).selectExpr("project source", "if(org = 'o0', 'main', 'rebuild') run", "id target", "offset")
    return stats.composite_source_offsets(branches)


@query("WITH b AS (SELECT 'p' || (user_id % 5) AS source, max(event_id) FILTER (user_id % 2 = 0) AS main, max(event_id) FILTER (user_id % 2 = 1) AS rebuild FROM events GROUP BY ALL) SELECT bool_or(main IS NOT NULL AND (main <> main - 1 OR coalesce(rebuild, -1) <> main)) AND bool_and(source <> 'p4') AS rebuild FROM b")
def rebuild_condition(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    branches = e.groupBy(F.expr("concat('p', user_id % 5)").alias("source"), F.expr("if(user_id % 2 = 0, 'main', 'rebuild')").alias("run")).agg(F.max("event_id").alias("offset"))
    checked = branches.filter("run = 'main'").select("source", (F.col("offset") - 1).alias("offset"))
    left = branches.select("source", F.expr("if(source = 'p4', 5, 0)").alias("n")).distinct()
    return stats.rebuild_condition(branches, checked, left)


@query("SELECT project AS source, CASE WHEN org = 'o0' THEN 'main' ELSE 'rebuild' END AS run, id AS target, CASE WHEN org = 'o1' THEN 0 ELSE max(ordering) END AS \"offset\", CASE WHEN org = 'o1' THEN 0 ELSE count(*) END AS processed FROM log GROUP BY project, org, id", LOG)
def composite_restart(spark, sf_dir):
    rows = events_log(spark, sf_dir).groupBy("project", "org", "id").agg(F.max("ordering").alias("offset"), F.count("*").alias("processed"))
    rows = rows.selectExpr("project source", "if(org = 'o0', 'main', 'rebuild') run", "id target", "offset", "processed", "0L discarded", "0L failed")
    return stats.restart_branches(rows, "rebuild").select("source", "run", "target", "offset", "processed")


@query("SELECT id, instant FROM log WHERE rev = 1 AND instant + INTERVAL 20 DAY > TIMESTAMP '2024-01-21'", LOG)
def expire(spark, sf_dir):
    rows = events_log(spark, sf_dir).filter("rev = 1").select("id", "instant")
    return eventlog.expire(rows, "instant", F.expr("timestamp_ntz '2024-01-21'"), F.expr("interval 20 days"))


@query("SELECT org, project, id, rev FROM log WHERE NOT (org = 'o1' AND project = 'p2')", LOG)
def delete_project(spark, sf_dir):
    return eventlog.delete_project(events_log(spark, sf_dir), "o1", "p2").select(*KEY, "rev")


@query("SELECT org, project, id, tag, true AS deleted, -1 AS ordering FROM states WHERE id IN (SELECT id FROM states WHERE tag = 'latest' AND deprecated)", STATES)
def delete_resource(spark, sf_dir):
    _, states, _ = _tables(spark, sf_dir)
    gone = eventlog.delete_resources(states, states.filter("tag = 'latest' and deprecated").select(*KEY), F.lit(-1), F.col("instant"))[1]
    return gone.select(*KEY, "tag", "deleted", "ordering")


@query("SELECT org, project FROM (SELECT org, project, max(instant) AS last_event, min(instant) AS updated_at FROM log GROUP BY ALL) WHERE org = 'o0' AND project <> 'p3' AND last_event < TIMESTAMP '2030-01-01' AND updated_at < TIMESTAMP '2030-01-01'", LOG)
def projects_to_delete(spark, sf_dir):
    rows = events_log(spark, sf_dir).groupBy("org", "project").agg(F.max("instant").alias("last_event"), F.min("instant").alias("updated_at")).withColumns({"deprecated": F.lit(False), "marked": F.lit(False)})
    return eventlog.projects_to_delete(rows, include="o0/.*", exclude=".*/p3", idle_before=F.expr("timestamp_ntz '2030-01-01'")).select("org", "project")


@query("SELECT id, tag, regexp_full_match(tag, '[\\x20-\\x7E]{1,64}') AND tag <> 'latest' AS valid FROM states", STATES)
def tag_check(spark, sf_dir):
    return _tables(spark, sf_dir)[1].select("id", "tag", tag_valid(F.col("tag")).alias("valid"))


@query("SELECT id, rev FROM log WHERE (id, rev) > ('r2', 5) ORDER BY id, rev LIMIT 50", LOG)
def page_search_after(spark, sf_dir):
    return search_after(events_log(spark, sf_dir).select("id", "rev"), {"id": "r2", "rev": 5}, 50)


@query("SELECT id, rev, ordering FROM log WHERE kind = 'Deprecated' ORDER BY rev DESC, ordering LIMIT 20 OFFSET 10", LOG)
def failure_page(spark, sf_dir):
    return page(events_log(spark, sf_dir).filter("kind = 'Deprecated'").select("id", "rev", "ordering"), 10, 20, "-rev", "ordering")


@query("SELECT project, count(*) AS n FROM log WHERE kind = 'Deprecated' AND instant > TIMESTAMP '2024-01-03' GROUP BY ALL", LOG)
def failure_count(spark, sf_dir):
    return events_log(spark, sf_dir).filter((F.col("kind") == "Deprecated") & in_range("instant", ("2024-01-03", None))).groupBy("project").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT org, project FROM log WHERE kind = 'Deprecated' AND value > 90", LOG)
def projects_with_errors(spark, sf_dir):
    return events_log(spark, sf_dir).filter("kind = 'Deprecated' and value > 90").select("org", "project").distinct()

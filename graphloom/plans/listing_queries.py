"""Queries of listings, full text, analytics, JSON and IRI functions, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import iri, json_text
from graphloom.operators import analytics, deps, eventlog, listing, pipes
from graphloom.operators.search_index import Field, SearchIndex, build_index
from graphloom.plans.log_queries import joined
from graphloom.plans.registry import LOG, STATES, query
from graphloom.sources.adapters import events_log, nested_orders, read
from graphloom.streaming import feeds, projections
from graphloom.streaming.composite import CompositeView, Source
from graphloom.streaming.index import KeyedIndex

INDEX = f"{STATES}, idx AS (SELECT r.*, c.instant AS created_at, c.subject AS created_by, r.instant AS updated_at, r.subject AS updated_by FROM states r JOIN running c ON c.id = r.id AND c.rev = 1 WHERE r.tag = 'latest')"


def _index(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return eventlog.fold_states(log).withColumn("tag", F.lit("latest"))


def _sql_listing(where: str) -> str:
    return f"SELECT org, project, id, rev FROM idx WHERE {where}"


@query(_sql_listing("NOT deprecated AND created_by = 'u1' AND updated_at > TIMESTAMP '2024-01-05' AND (list_contains(types, 'T1') OR list_contains(types, 'T2')) AND NOT (list_contains(types, 'K0') AND list_contains(types, 'T1'))"), INDEX)
def listing_filter(spark, sf_dir):
    s = listing.Search(deprecated=False, created_by="u1", updated_at=listing.parse_range("2024-01-05..*"), types=["T1", "T2"], not_types=["K0", "T1"])
    return listing.search(_index(spark, sf_dir), s).select("org", "project", "id", "rev")


@query(_sql_listing("updated_by = 'u3' AND schema = 's1'") + " ORDER BY updated_at DESC, id LIMIT 15", INDEX)
def entity_list(spark, sf_dir):
    rows = listing.search(_index(spark, sf_dir), listing.Search(updated_by="u3", schema="s1"))
    return listing.page(rows, 0, 15, "-updated_at", "id").select("org", "project", "id", "rev")


@query("SELECT id, rev, schema FROM idx ORDER BY schema NULLS LAST, rev DESC NULLS LAST, id LIMIT 40", INDEX)
def sort_list(spark, sf_dir):
    return _index(spark, sf_dir).orderBy(*listing.sort_keys("schema", "-rev", "+id")).limit(40).select("id", "rev", "schema")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 100")
def page_from_size(spark, sf_dir):
    return listing.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, 25, "-o_totalprice", "o_orderkey", total=True)


@query("SELECT key, n, (SELECT sum(n) FROM (SELECT count(*) AS n FROM idx GROUP BY org, project)) - (sum(n) OVER ())::BIGINT AS other FROM (SELECT org || '/' || project AS key, count(*) AS n FROM idx GROUP BY ALL ORDER BY n DESC, key LIMIT 4)", INDEX)
def listing_terms(spark, sf_dir):
    return listing.terms(_index(spark, sf_dir), F.concat_ws("/", "org", "project"), 4)


@query("SELECT key, count(*) AS n, 0::BIGINT AS other FROM (SELECT unnest(types) AS key FROM idx) GROUP BY key", INDEX)
def top_terms(spark, sf_dir):
    return listing.type_terms(_index(spark, sf_dir), 500)


@query("SELECT l_returnflag AS flag, count(DISTINCT l_orderkey) AS orders, count(*) AS lines FROM lineitem WHERE l_quantity > 25 GROUP BY ALL")
def nested_terms(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    items = rows.select("l_orderkey", F.explode("items").alias("i")).filter("i.l_quantity > 25")
    return items.groupBy(F.col("i.l_returnflag").alias("flag")).agg(F.countDistinct("l_orderkey").alias("orders"), F.count("*").alias("lines"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY ALL")
def index_count(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents),
    size AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM w), hits AS (SELECT doc_id, len(words) AS length, unnest(words) AS word FROM w),
    tf AS (SELECT doc_id, length, word, count(*) AS tf FROM hits WHERE word IN ('thing', 'worthless', 'reation') GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS n_words FROM tf JOIN df USING (word), size GROUP BY doc_id"""
)
def full_text_match(spark, sf_dir):
    return listing.full_text(read(spark, sf_dir, "documents"), "thing worthless reation")


def _search_index(spark, sf_dir, fields):
    path = f"{deps.shared_folder(spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    build_index(read(spark, sf_dir, "documents"), fields, path)
    return SearchIndex(spark, path)


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words, list_filter(string_split_regex(lower(coalesce(source, '')), '[/#?&=:]+'), lambda x: x <> '') AS parts FROM documents),
    f AS (SELECT doc_id, 'text' AS field, 1.0 AS boost, words FROM w UNION ALL SELECT doc_id, 'source', 2.0, parts FROM w),
    size AS (SELECT field, count(*) AS n, avg(len(words)) AS mean FROM f GROUP BY field), hits AS (SELECT doc_id, field, boost, len(words) AS length, unnest(words) AS word FROM f),
    tf AS (SELECT doc_id, field, boost, length, word, count(*) AS tf FROM hits WHERE word IN ('src1', 'token', 'worthless') GROUP BY ALL), df AS (SELECT field, word, count(*) AS df FROM tf GROUP BY ALL)
    SELECT doc_id, round(sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS n_words
    FROM tf JOIN df USING (field, word) JOIN size USING (field) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""
)
def full_text_top(spark, sf_dir):
    """The best documents over two fields, by bounds of ranges."""
    return _search_index(spark, sf_dir, [Field("text"), Field("source", "iri", 2.0)]).top("src1 token worthless", 20)


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'es')")
def search_select(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(F.col("lang").isin("de", "es")).select("doc_id", "lang")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def exclude_source_column(spark, sf_dir):
    return read(spark, sf_dir, "documents").drop("text")


@query("SELECT DISTINCT org, project FROM log WHERE org = 'o0' OR (org = 'o1' AND project IN ('p1', 'p2'))", LOG)
def suite_union(spark, sf_dir):
    log = events_log(spark, sf_dir).select("org", "project")
    return log.filter("org = 'o0'").union(log.filter("org = 'o1' and project in ('p1', 'p2')")).distinct()


# analytics


DOCS = """lines AS (SELECT l_orderkey AS k, l_partkey, l_quantity::INTEGER AS q, count(*) OVER (PARTITION BY l_orderkey) > 1 AS in_array FROM lineitem),
entries AS (SELECT 'order/' || o_orderkey AS id, 'customer' AS path, false AS in_array, 'object' AS data_type, 'customer/' || o_custkey AS ref, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT 'order/' || o_orderkey, 'priority', false, 'string', NULL, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT DISTINCT 'order/' || k, 'items', in_array, 'object', NULL, o_orderstatus FROM lines JOIN orders ON o_orderkey = k WHERE k % 10 <> 0
  UNION ALL SELECT DISTINCT 'order/' || k, 'items / part', in_array, 'object', 'part/' || l_partkey, o_orderstatus FROM lines JOIN orders ON o_orderkey = k WHERE k % 10 <> 0
  UNION ALL SELECT DISTINCT 'order/' || k, 'items / quantity', in_array, 'numeric', NULL, o_orderstatus FROM lines JOIN orders ON o_orderkey = k WHERE k % 10 <> 0)"""


def _nodes(spark, sf_dir):
    """Types of orders and customers; other referenced ids aren't resources."""
    orders = nested_orders(spark, sf_dir).select("project", "id", F.from_json("doc", "`@type` array<string>")["@type"].alias("types"))
    customers = read(spark, sf_dir, "customer").selectExpr("'sales' project", "concat('customer/', c_custkey) id", "array('Customer', c_mktsegment) types")
    return orders.unionByName(customers)


@query("SELECT id, path, in_array, data_type, ref FROM entries", DOCS)
def jsonld_flatten(spark, sf_dir):
    return analytics.flatten_documents(nested_orders(spark, sf_dir)).select("id", "path", "in_array", "data_type", "ref")


@query("SELECT DISTINCT id AS resource, id AS s, path AS p, ref AS o FROM entries WHERE ref IS NOT NULL UNION SELECT id, id, 'type', unnest(['Order', 'Order' || status]) FROM entries", DOCS)
def jsonld_to_triples(spark, sf_dir):
    return analytics.documents_to_triples(nested_orders(spark, sf_dir))


@query("SELECT id, path, ref, CASE WHEN c_custkey IS NOT NULL THEN 'Customer,' || c_mktsegment END AS found_types FROM entries LEFT JOIN customer ON ref = 'customer/' || c_custkey WHERE ref IS NOT NULL", DOCS)
def resolve_references(spark, sf_dir):
    entries = analytics.flatten_documents(nested_orders(spark, sf_dir))
    return analytics.resolve_references(entries, _nodes(spark, sf_dir)).select("id", "path", "ref", "found_types").withColumns(joined("found_types"))


@query("SELECT id, path, ref, CASE WHEN c_custkey % 2 = 0 THEN 'Renamed' WHEN c_custkey IS NOT NULL THEN 'Customer,' || c_mktsegment END AS found_types FROM entries LEFT JOIN customer ON ref = 'customer/' || c_custkey WHERE ref IS NOT NULL", DOCS)
def refresh_references(spark, sf_dir):
    entries = analytics.flatten_documents(nested_orders(spark, sf_dir))
    resolved = analytics.resolve_references(entries, _nodes(spark, sf_dir))
    changed = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").selectExpr("'sales' project", "concat('customer/', c_custkey) id", "array('Renamed') types")
    return analytics.refresh_references(resolved, changed).select("id", "path", "ref", "found_types").withColumns(joined("found_types"))


@query("SELECT s AS source, 'customer' AS path, t AS target, count(*) AS n FROM (SELECT unnest(['Order', 'Order' || status]) AS s, c_mktsegment FROM entries JOIN customer ON ref = 'customer/' || c_custkey), (SELECT unnest([1, 2]) AS i) x, LATERAL (SELECT CASE WHEN i = 1 THEN 'Customer' ELSE c_mktsegment END AS t) GROUP BY ALL", DOCS)
def relationship_graph(spark, sf_dir):
    entries = analytics.flatten_documents(nested_orders(spark, sf_dir))
    nodes = _nodes(spark, sf_dir)
    resolved = analytics.resolve_references(entries, nodes)
    return analytics.relationship_edges(resolved, analytics.relationship_nodes(nodes))


@query("SELECT type, count(*) AS n FROM (SELECT unnest(['Order', 'Order' || o_orderstatus]) AS type FROM orders UNION ALL SELECT unnest(['Customer', c_mktsegment]) FROM customer) GROUP BY ALL ORDER BY n DESC, type LIMIT 200")
def relationship_nodes(spark, sf_dir):
    return analytics.relationship_nodes(_nodes(spark, sf_dir))


@query("SELECT path, CASE WHEN path LIKE '% / %' THEN 'items' ELSE '' END AS parent, split_part(path, ' / ', CASE WHEN path LIKE '% / %' THEN 2 ELSE 1 END) AS name, count(*) AS n FROM entries WHERE NOT in_array AND status = 'F' GROUP BY ALL", DOCS)
def property_statistics(spark, sf_dir):
    return analytics.property_statistics(analytics.flatten_documents(nested_orders(spark, sf_dir)), "OrderF")


# functions


@query(r"""SELECT page_id, CASE WHEN url LIKE '%#%' THEN regexp_extract(url, '#(.+)$', 1) WHEN regexp_extract(url, '/([^/?#]+)/?([?#].*)?$', 1) <> '' THEN regexp_extract(url, '/([^/?#]+)/?([?#].*)?$', 1) ELSE url END AS name FROM pages""")
def iri_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", iri.iri_name(F.col("url")).alias("name"))


@query("""WITH r AS (SELECT event_id, event_id % 4 AS m, 'https://x.org/' || user_id AS base FROM events) SELECT event_id, base AS iri, CASE m WHEN 0 THEN 'Latest' WHEN 1 THEN 'Revision' WHEN 2 THEN 'Tag' ELSE 'Revision' END AS kind, CASE WHEN m IN (1, 3) THEN (event_id + 1)::INTEGER END AS rev, CASE WHEN m = 2 THEN 'v1' END AS tag FROM r""")
def ref_parse(spark, sf_dir):
    ref = F.expr("concat('https://x.org/', user_id, case event_id % 4 when 0 then '' when 1 then concat('?rev=', event_id + 1) when 2 then '?tag=v1' else concat('?tag=v1&rev=', event_id + 1) end)")
    rows = read(spark, sf_dir, "events").select("event_id", ref.alias("r"))
    r = F.col("r")
    return rows.select("event_id", iri.ref_iri(r).alias("iri"), iri.ref_kind(r).alias("kind"), iri.ref_rev(r).alias("rev"), iri.ref_tag(r).alias("tag"))


@query("SELECT c_custkey, c_name || ' / ' || c_mktsegment AS path, 2 AS n FROM customer")
def path_split(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select("c_custkey", iri.path_join(F.array("c_name", "c_mktsegment")).alias("path"))
    return rows.withColumn("n", F.size(iri.path_split(F.col("path"))))


@query("SELECT DISTINCT org, project, md5(org || '/' || project) AS hash FROM log", LOG)
def label_hash(spark, sf_dir):
    return events_log(spark, sf_dir).select("org", "project").distinct().withColumn("hash", iri.project_hash(F.col("org"), F.col("project")))


@query("SELECT DISTINCT org, project, '/,/' || org || ',/' || org || '/' || project AS above FROM log", LOG)
def acl_ancestors(spark, sf_dir):
    from graphloom.operators.deps import ancestors

    rows = events_log(spark, sf_dir).select("org", "project").distinct()
    return rows.select("org", "project", F.array_join(ancestors(F.concat(F.lit("/"), "org", F.lit("/"), "project")), ",").alias("above"))


def _props(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit('{"b":{"k":1,"_m":"'), "event_type", F.lit('"},"a":['), (F.col("event_id") % 5).cast("string"), F.lit('],"_rev":2}')).alias("j"))


def _json(name: str, sql: str, fn):
    @query(f"SELECT event_id, {sql} AS j FROM events", name=name)
    def run(spark, sf_dir):
        return _props(spark, sf_dir).select("event_id", fn(F.col("j")).alias("j"))

    return run


_json("json_remove_keys", """'{"a":[' || (event_id % 5) || '],"_rev":2}'""", lambda j: json_text.json_remove_keys(j, "b"))
_json("json_remove_metadata_keys", """'{"b":{"k":1,"_m":"' || event_type || '"},"a":[' || (event_id % 5) || ']}'""", json_text.json_remove_metadata_keys)
_json("json_sort_keys", """'{"_rev":2,"a":[' || (event_id % 5) || '],"b":{"_m":"' || event_type || '","k":1}}'""", json_text.json_sort_keys)
_json("json_remove_all", """'{"b":{"k":1},"a":[' || (event_id % 5) || ']}'""", lambda j: json_text.json_remove_all(j, keys=("_m", "_rev")))
_json("json_replace", """'{"b":{"k":7,"_m":"' || event_type || '"},"a":[' || (event_id % 5) || '],"_rev":2}'""", lambda j: json_text.json_replace(j, "k", 1, 7))
_json("json_map_all_keys", """'{"b":{"k":1,"_m":"' || upper(event_type) || '"},"a":[' || (event_id % 5) || '],"_rev":2}'""", lambda j: json_text.json_map_all_keys(j, "_m", str.upper))
_json("json_extract_values", """'["' || event_type || '",2]'""", lambda j: json_text.json_extract_values(j, "_m", "_rev"))
_json("json_deep_merge", """'{"b":{"k":5,"_m":"' || event_type || '","z":true},"a":[' || (event_id % 5) || '],"_rev":2}'""", lambda j: json_text.json_deep_merge(j, F.lit('{"b":{"k":5,"z":true}}')))
_json("json_is_empty", "false", json_text.json_is_empty)
_json("json_unwrap_single", "(event_id % 5)::VARCHAR", lambda j: json_text.json_unwrap_single(F.get_json_object(j, "$.a")))
_json("json_add_if_exists", """'{"a":1' || CASE WHEN event_id % 2 = 0 THEN ',"t":"' || event_type || '"' ELSE '' END || '}'""", lambda j: json_text.json_add_if_exists(F.lit('{"a":1}'), "t", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), "event_type", F.lit('"')))))


# streams: each reads the events table as a stream and ends when it has read what is there


def _stream(spark, sf_dir):
    # a pattern, so that the table may be one file as well as a folder
    raw = projections.log_stream(spark, f"{sf_dir}/events.parque[t]", read(spark, sf_dir, "events").schema)
    elements = raw.selectExpr(*ELEMENT)
    return elements, f"{deps.shared_folder(spark).rstrip('/')}/projection-{uuid.uuid4().hex}"


ELEMENT = ["concat('o', user_id % 2) org", "concat('p', user_id % 5) project", "concat('r', user_id) id", "event_id + 1 ordering", "ts instant", "event_type", "get_json_object(props, '$.k') k", "'Success' status", "event_type = 'error' deprecated"]
#: Elements of a batch in the queries over positions, and of the batches that a trigger takes at once.
ADMITTED, AHEAD = 2500, 4_000_000


def _feed(spark, sf_dir, handle, out, **settings):
    """The events in batches of so many positions."""
    feeds.finish(feeds.run_feed(spark, f"{sf_dir}/events.parquet", "event_id", lambda df: df.selectExpr(*ELEMENT, feeds.BATCH), handle, checkpoint=f"{out}-checkpoint", max_elements=ADMITTED, at_once=AHEAD // ADMITTED, **settings))


def _indexed(spark, sf_dir):
    """An index of the events' resources after all batches; deltas are folded as they come."""
    out = f"{deps.shared_folder(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index = KeyedIndex(spark, out, ["org", "project", "id"], buckets=8)
    _feed(spark, sf_dir, feeds.into_index(index, pipes.lookup("filterDeprecated"), compact_every=3), out)
    return index


def _run(spark, sf_dir, pipe):
    elements, out = _stream(spark, sf_dir)
    projections.run_projection(elements, pipe, out, name="main", checkpoint=f"{out}-checkpoint").awaitTermination()
    return out


STREAMED = "st AS (SELECT 'o' || (user_id % 2) AS org, 'p' || (user_id % 5) AS project, 'r' || user_id AS id, event_id + 1 AS ordering, ts AS instant, event_type, CASE WHEN event_type = 'error' THEN 'Dropped' ELSE 'Success' END AS status FROM events)"


@query("SELECT 'main' AS projection, count(*) AS processed, count(*) FILTER (status = 'Dropped') AS discarded, 0::BIGINT AS failed, max(ordering) AS \"offset\", max(instant) AS instant FROM st", STREAMED)
def run_projection(spark, sf_dir):
    return projections.read_progress(spark, _run(spark, sf_dir, pipes.lookup("filterDeprecated")))


@query("SELECT org, project, id, ordering, event_type FROM (SELECT *, row_number() OVER (PARTITION BY org, project, id ORDER BY ordering DESC) AS n FROM st) WHERE n = 1 AND status = 'Success'", STREAMED)
def sink_document_upsert(spark, sf_dir):
    """Many batches into an index; reading costs its base and the open deltas."""
    return _indexed(spark, sf_dir).read().select("org", "project", "id", "ordering", "event_type")


@query("SELECT org, project, arg_max(instant, ordering) AS last_instant, max(ordering) AS last_ordering FROM st GROUP BY ALL", STREAMED)
def scan_last_updates(spark, sf_dir):
    return projections.read_updates(spark, _run(spark, sf_dir, pipes.chain()))


@query("SELECT id, ordering FROM st WHERE ordering % 10 = 0", STREAMED)
def scan_failures(spark, sf_dir):
    out = _run(spark, sf_dir, pipes.generic_pipe(F.when(F.col("ordering") % 10 != 0, F.col("ordering"))))
    return spark.read.parquet(f"{out}/failures").select("id", "ordering")


@query(
    """WITH b AS (SELECT 'events' AS source, event_id AS ordering, event_type = 'error' AS dropped FROM events UNION ALL SELECT 'orders', o_orderkey, o_orderstatus = 'P' FROM orders)
    SELECT 'main' AS run, source, 'all' AS target, count(*) AS processed, 0::BIGINT AS discarded, max(ordering) AS "offset" FROM b GROUP BY source UNION ALL SELECT 'main', source, 'live', count(*), count(*) FILTER (dropped), max(ordering) FROM b GROUP BY source
    UNION ALL SELECT 'rebuild', source, target, count(*), count(*) FILTER (dropped AND target = 'live'), max(ordering) FROM b, (VALUES ('all'), ('live')) t(target) WHERE source = 'orders' GROUP BY source, target"""
)
def composite_projection(spark, sf_dir):
    """Two sources with offsets of their own into two targets, and a rebuild of one source beside the main run."""
    element = lambda key, dropped: lambda df: df.selectExpr("'o' org", "'p' project", f"cast({key} as string) id", f"{key} ordering", "cast(null as timestamp_ntz) instant", "'Success' status", f"{dropped} deprecated", feeds.BATCH)
    sources = {"events": Source(f"{sf_dir}/events.parquet", "event_id", element("event_id", "event_type = 'error'")), "orders": Source(f"{sf_dir}/orders.parquet", "o_orderkey", element("o_orderkey", "o_orderstatus = 'P'"))}
    view = CompositeView(spark, f"{deps.shared_folder(spark).rstrip('/')}/view-{uuid.uuid4().hex}", sources, {"all": pipes.chain(), "live": pipes.lookup("filterDeprecated")})
    admitted = {"max_elements": 4 * ADMITTED, "at_once": AHEAD // (4 * ADMITTED)}
    view.run(**admitted)
    view.run_source("orders", run="rebuild", **admitted)
    rows = view.progress().withColumn("run", F.lit("main")).unionByName(view.progress(run="rebuild").withColumn("run", F.lit("rebuild")))
    return rows.select("run", "source", "target", "processed", "discarded", "offset")


@query("SELECT id, rev, kind, ordering, lpad((min(ordering) OVER (PARTITION BY f))::VARCHAR, 12, '0') || '.json' AS file FROM (SELECT *, (row_number() OVER (ORDER BY ordering) - 1) // 150 AS f FROM log WHERE ordering > 100 AND org = 'o1' AND project IN ('p1', 'p3'))", LOG)
def export_events(spark, sf_dir):
    """Two projects' events in files of 150 lines, read back with the name of the file of each."""
    out = f"{deps.shared_folder(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    log = events_log(spark, sf_dir).select("org", "project", "id", "rev", "kind", "ordering")
    projections.export_events(log, out, offset=100, projects=[("o1", "p1"), ("o1", "p3")], lines=150)
    rows = spark.read.schema(log.schema).json(out)
    return rows.select("id", "rev", "kind", "ordering", F.col("_metadata.file_name").alias("file"))

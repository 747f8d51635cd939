"""Names, functions and SQL of queries, and the SQL of the mapped tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The log, the state after every revision, states and tombstones, as the adapters and the event-log operators define them.
LOG = """
e AS (SELECT 'o' || (user_id % 2) AS org, 'p' || (user_id % 5) AS project, 'r' || user_id AS id, CASE WHEN user_id % 7 = 0 THEN 'File' ELSE 'Resource' END AS type, event_id + 1 AS ordering,
      (row_number() OVER (PARTITION BY user_id ORDER BY event_id))::INTEGER AS rev, event_id, event_type, ts AS instant, 'u' || (event_id % 4) AS subject, value, props FROM events),
k AS (SELECT *, CASE WHEN rev = 1 THEN 'Created' WHEN event_id % 11 = 0 THEN 'TagDeleted' WHEN event_id % 13 = 0 THEN 'Refreshed' WHEN event_type = 'view' THEN 'Updated'
      WHEN event_type = 'purchase' THEN 'SchemaUpdated' WHEN event_type = 'click' THEN 'TagAdded' WHEN event_type = 'error' THEN 'Deprecated' ELSE 'Undeprecated' END AS kind FROM e),
log AS (SELECT org, project, id, type, ordering, rev, kind, instant, subject, value,
        CASE WHEN kind IN ('Created', 'Updated', 'Refreshed') THEN ['K' || (event_id % 3), 'T' || (event_id % 4)] END AS types,
        CASE WHEN kind IN ('Created', 'Updated', 'SchemaUpdated') THEN 's' || (event_id % 3) END AS schema,
        CASE WHEN kind IN ('Created', 'Updated', 'Refreshed') THEN props END AS payload,
        CASE WHEN kind IN ('TagAdded', 'TagDeleted') THEN 't' || (event_id % 3) END AS tag, CASE WHEN kind = 'TagAdded' THEN rev - 1 END AS target_rev FROM k)"""
STATES = f"""{LOG},
running AS (SELECT org, project, id, type, rev, ordering, instant, subject, kind,
            last_value(types IGNORE NULLS) OVER w AS types, last_value(schema IGNORE NULLS) OVER w AS schema, last_value(payload IGNORE NULLS) OVER w AS payload,
            last_value(CASE kind WHEN 'Created' THEN false WHEN 'Undeprecated' THEN false WHEN 'Deprecated' THEN true END IGNORE NULLS) OVER w AS deprecated
            FROM log WINDOW w AS (PARTITION BY id ORDER BY rev ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tagged AS (SELECT org, project, id, tag, arg_max(kind, rev) AS kind, arg_max(coalesce(target_rev, 0), rev) AS target_rev, arg_max(ordering, rev) AS ordering FROM log WHERE tag IS NOT NULL GROUP BY ALL),
states AS (SELECT org, project, id, type, rev, ordering, instant, subject, types, schema, payload, deprecated, 'latest' AS tag FROM running QUALIFY row_number() OVER (PARTITION BY id ORDER BY rev DESC) = 1
           UNION ALL SELECT r.org, r.project, r.id, r.type, r.rev, t.ordering, r.instant, r.subject, r.types, r.schema, r.payload, r.deprecated, t.tag FROM tagged t JOIN running r ON r.id = t.id AND r.rev = t.target_rev WHERE t.kind = 'TagAdded'),
tombs AS (SELECT org, project, id, type, 'latest' AS tag, false AS deleted, list_filter(before, lambda x: NOT list_contains(types, x)) AS types, schema, instant, ordering
          FROM (SELECT *, lag(types) OVER (PARTITION BY id ORDER BY rev) AS before FROM running) WHERE len(list_filter(before, lambda x: NOT list_contains(types, x))) > 0
          UNION ALL SELECT org, project, id, type, tag, true, []::VARCHAR[], NULL, instant, ordering FROM (SELECT *, lag(kind) OVER (PARTITION BY id, tag ORDER BY rev) AS before FROM log WHERE tag IS NOT NULL) WHERE kind = 'TagDeleted' AND before = 'TagAdded')"""
FEED = f"""{STATES},
feed AS (SELECT type, org, project, id, tag, rev, instant, ordering, 'Success' AS status FROM states WHERE tag = 'latest'
         UNION ALL SELECT type, org, project, id, tag, -1, instant, ordering, 'Dropped' FROM tombs WHERE tag = 'latest' AND deleted)"""
TRIPLES = """
geo AS (SELECT 'region/' || r_regionkey AS s, 'Region' AS t, [('name', r_name, 'literal', 'string')] AS l FROM region
        UNION ALL SELECT 'nation/' || n_nationkey, 'Nation', [('region', 'region/' || n_regionkey, 'iri', ''), ('name', n_name, 'literal', 'string')] FROM nation),
sales AS (SELECT 'customer/' || c_custkey AS s, 'Customer' AS t, [('nation', 'nation/' || c_nationkey, 'iri', ''), ('name', c_name, 'literal', 'string'), ('segment', c_mktsegment, 'literal', 'string'), ('balance', c_acctbal::DECIMAL(12,2)::VARCHAR, 'literal', 'decimal')] AS l FROM customer
          UNION ALL SELECT 'order/' || o_orderkey, 'Order', [('customer', 'customer/' || o_custkey, 'iri', ''), ('status', o_orderstatus, 'literal', 'string'), ('total', o_totalprice::DECIMAL(12,2)::VARCHAR, 'literal', 'decimal'), ('priority', o_orderpriority, 'literal', 'string')] FROM orders
          UNION ALL SELECT concat_ws('/', 'lineitem', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate::DATE::VARCHAR, l_extendedprice::DECIMAL(12,2)::VARCHAR), 'Lineitem', [('order', 'order/' || l_orderkey, 'iri', ''), ('part', 'part/' || l_partkey, 'iri', ''), ('supplier', 'supplier/' || l_suppkey, 'iri', ''), ('quantity', l_quantity::INTEGER::VARCHAR, 'literal', 'integer'), ('price', l_extendedprice::DECIMAL(12,2)::VARCHAR, 'literal', 'decimal'), ('flag', l_returnflag, 'literal', 'string')] FROM lineitem),
supply AS (SELECT 'supplier/' || s_suppkey AS s, 'Supplier' AS t, [('nation', 'nation/' || s_nationkey, 'iri', ''), ('name', s_name, 'literal', 'string'), ('balance', s_acctbal::DECIMAL(12,2)::VARCHAR, 'literal', 'decimal')] AS l FROM supplier
           UNION ALL SELECT 'part/' || p_partkey, 'Part', [('name', p_name, 'literal', 'string'), ('brand', p_brand, 'literal', 'string'), ('size', p_size::VARCHAR, 'literal', 'integer')] FROM part),
subjects AS (SELECT 'geo' AS project, * FROM geo UNION ALL SELECT 'sales', * FROM sales UNION ALL SELECT 'supply', * FROM supply),
triples AS (SELECT 'tpch' AS org, project, s AS resource, s, x[1] AS p, x[2] AS o, x[3] AS kind, x[4] AS datatype FROM (SELECT project, s, unnest(list_concat([('type', t, 'iri', '')], l)) AS x FROM subjects))"""
EDGES = """
edges AS (SELECT 'tpch' AS org, 'geo' AS project, 'nation/' || n_nationkey AS id, 'tpch' AS target_org, 'geo' AS target_project, 'region/' || n_regionkey AS target_id FROM nation
          UNION ALL SELECT 'tpch', 'sales', 'customer/' || c_custkey, 'tpch', 'geo', 'nation/' || c_nationkey FROM customer
          UNION ALL SELECT 'tpch', 'supply', 'supplier/' || s_suppkey, 'tpch', 'geo', 'nation/' || s_nationkey FROM supplier
          UNION ALL SELECT 'tpch', 'sales', 'order/' || o_orderkey, 'tpch', 'sales', 'customer/' || o_custkey FROM orders)"""
ACLS = """
acls AS (SELECT DISTINCT * FROM (SELECT '/o' || (user_id % 2) || '/p' || (user_id % 5) AS address, 'u' || (event_id % 4) AS identity, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS permission FROM events WHERE event_id % 4 IN (1, 2)) WHERE address <> '/o0/p0'
         UNION SELECT DISTINCT '/o1', 'u3', 'read' FROM events WHERE event_id % 4 = 3 AND user_id % 2 = 1
         UNION SELECT DISTINCT '/', 'u0', 'read' FROM events WHERE event_id % 4 = 0)"""


def query(sql: str | None = None, tables: str = "", name: str | None = None):
    """Register a function as a query; tables: the CTEs that its SQL builds on."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = f"WITH {tables} {sql}" if tables else sql
        return fn

    return add


def load_queries() -> dict[str, Query]:
    """All registered queries; importing their modules registers them."""
    from graphloom.plans import graph_queries, listing_queries, log_queries, more_queries  # noqa: F401

    return dict(QUERIES)

"""Operators on small inputs with known results."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import iri, json_text, merge, sets
from graphloom.operators import analytics, deps, eventlog, feed, graph, listing, pipes, quality, sinks, stats

KEY = "org string, project string, id string"


def keys(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_closure_stops_on_cycles_and_returns_a_start_on_one(spark):
    edges = spark.createDataFrame([("o", "p", f"id{a}", "o", "q" if b == 4 else "p", f"id{b}") for a, b in ((1, 2), (1, 3), (2, 4), (3, 1))] + [("o", "q", "id4", "o", "p", "id5"), ("o", "p", "id5", "o", "p", "id1")], f"{KEY}, target_org string, target_project string, target_id string")
    starts = spark.createDataFrame([("o", "p", "id1")], KEY)
    assert keys(deps.closure(edges, starts), "id") == {("id1",), ("id2",), ("id3",), ("id4",), ("id5",)}


def test_closure_tells_projects_apart(spark):
    edges = spark.createDataFrame([("o", "p", "a", "o", "q", "a"), ("o", "q", "a", "o", "q", "b")], f"{KEY}, target_org string, target_project string, target_id string")
    assert keys(deps.closure(edges, spark.createDataFrame([("o", "p", "a")], KEY)), "project", "id") == {("q", "a"), ("q", "b")}


def test_listing_of_index_documents(spark):
    rows = [
        ("lab", "proj1", ["Organization"], 2, False, "1970-01-01 00:00:05", "1970-01-01 00:00:10", "alice"),
        ("school", "proj1", ["Organization"], 1, False, "1970-01-01 00:00:10", "1970-01-01 00:00:10", "default"),
        ("trace", "proj2", ["Dataset", "Trace"], 3, False, "1970-01-01 00:00:15", "1970-01-01 00:00:30", "default"),
        ("cell", "proj2", ["Dataset", "Cell"], 3, True, "1970-01-01 00:00:20", "1970-01-01 00:00:40", "alice"),
    ]
    docs = spark.createDataFrame(rows, "id string, project string, types array<string>, rev int, deprecated boolean, created string, updated string, created_by string")
    docs = docs.withColumns({"created_at": F.col("created").cast("timestamp_ntz"), "updated_at": F.col("updated").cast("timestamp_ntz"), "org": F.lit("org")})
    found = lambda **q: {r.id for r in listing.search(docs, listing.Search(**q)).collect()}
    assert found(created_at=("1970-01-01 00:00:08", "1970-01-01 00:00:16")) == {"school", "trace"}
    assert found(created_at=("1970-01-01 00:00:11", None)) == {"trace", "cell"}
    assert found(updated_at=(None, "1970-01-01 00:00:12")) == {"lab", "school"}
    assert found(deprecated=True) == {"cell"}
    assert found(created_by="alice") == {"lab", "cell"}
    assert found(types=["Dataset", "Cell"], all_types=True) == {"cell"}
    assert found(types=["Dataset"], not_types=["Cell", "Trace"]) == {"trace", "cell"}
    assert found(not_types=["Dataset", "Cell"], all_types=True) == {"lab", "school"}


def test_analytics_of_persons(spark):
    person = lambda i, **p: ("p", f"person{i}", False, '{"@id":"person%d","@type":["Person"],"givenName":[{"@value":"x"}]%s}' % (i, "".join(f',"{k}":[{{"@id":"{v}"}}]' for k, v in p.items())))  # noqa: E731, UP031
    rows = [person(1, colleague="person4", worksFor="school"), person(2, worksFor="school"), person(3, alumniOf="school"), ("p", "school", False, '{"@id":"school","@type":["Organization"],"address":[{"street":[{"@value":"y"}]}]}')]
    docs = spark.createDataFrame(rows, "project string, id string, deprecated boolean, doc string")
    entries = analytics.flatten_documents(docs)
    nodes = docs.select("project", "id", F.from_json("doc", "`@type` array<string>")["@type"].alias("types"))
    resolved = analytics.resolve_references(entries, nodes)
    kinds = analytics.relationship_nodes(nodes)
    assert keys(kinds, "type", "n") == {("Person", 3), ("Organization", 1)}
    assert keys(analytics.relationship_edges(resolved, kinds), "source", "path", "target", "n") == {("Person", "worksFor", "Organization", 2), ("Person", "alumniOf", "Organization", 1)}
    assert keys(analytics.property_statistics(entries, "Person"), "path", "n") == {("givenName", 3), ("worksFor", 2), ("alumniOf", 1), ("colleague", 1)}
    changed = spark.createDataFrame([("p", "school", ["EducationalOrganization"])], "project string, id string, types array<string>")
    assert keys(analytics.refresh_references(resolved, changed).filter("ref = 'school'").withColumn("t", F.col("found_types")[0]), "t") == {("EducationalOrganization",)}


def test_arrays_are_inherited_and_single_ones_unwrapped(spark):
    doc = '{"@type":["T"],"a":[{"b":[{"@value":1}]}],"c":[{"d":[{"@value":1}]},{"d":[{"@value":2}]}]}'
    docs = spark.createDataFrame([("p", "x", False, doc), ("p", "y", True, doc), ("p", "z", False, "no json")], "project string, id string, deprecated boolean, doc string")
    assert keys(analytics.flatten_documents(docs), "id", "path", "in_array") == {("x", "a", False), ("x", "a / b", False), ("x", "c", True), ("x", "c / d", True)}


def test_links(spark):
    t = spark.createDataFrame(
        [("radar", "radar", "type", "Person", "iri"), ("radar", "radar", "actor", "mash", "iri"), ("hawkeye", "hawkeye", "type", "Person", "iri"), ("hawkeye", "hawkeye", "knows", "radar", "iri"), ("hawkeye", "hawkeye", "actor", "mash", "iri")],
        "resource string, s string, p string, o string, kind string",
    )
    assert keys(graph.links_incoming(t, "radar"), "resource") == {("hawkeye",)}
    assert keys(graph.links_outgoing(t, "hawkeye"), "target") == {("radar",), ("mash",)}
    assert keys(graph.links_outgoing(t, "hawkeye", external=False), "target") == {("radar",)}


def test_patterns_need_a_common_variable(spark):
    t = spark.createDataFrame([("a", "b", "c")], "s string, p string, o string")
    with pytest.raises(ValueError):
        graph.match(t, [("?x", "b", "?y"), ("?z", "b", "?w")])


def test_storage_statistics_of_an_unknown_storage(spark):
    m = spark.createDataFrame([("proj1", "s", 1, 10), ("proj1", "s", 1, 20), ("proj1", "s", None, None), ("proj2", "s", 1, 20)], "project string, storage string, new_file int, bytes long")
    s = spark.createDataFrame([("proj1", "s"), ("proj2", "s"), ("proj1", "unknown")], "project string, storage string")
    assert keys(stats.storage_statistics(m, s), "project", "storage", "files", "bytes") == {("proj1", "s", 2, 30), ("proj2", "s", 1, 20), ("proj1", "unknown", 0, 0)}


def test_pipes_by_name(spark):
    rows = spark.createDataFrame([("a", "Success", True), ("b", "Success", False), ("c", "Failed", True)], "id string, status string, deprecated boolean")
    assert keys(rows.transform(pipes.lookup("filterDeprecated")), "id", "status") == {("a", "Dropped"), ("b", "Success"), ("c", "Failed")}
    with pytest.raises(pipes.UnknownPipe):
        pipes.lookup("nothing")
    with pytest.raises(pipes.MismatchedPipe):
        rows.transform(pipes.lookup("filterByType", types=["T"]))


def test_a_tombstone_passes_a_type_filter_only_for_its_types(spark):
    schema = f"{KEY}, type string, tag string, deleted boolean, types array<string>, instant timestamp_ntz, ordering long, rev int"
    gone = spark.createDataFrame([("o", "p", "a", "R", "latest", False, ["T1"], None, 1, 0), ("o", "p", "b", "R", "latest", False, ["T2"], None, 2, 0), ("o", "p", "c", "R", "latest", True, [], None, 3, 0)], schema)
    states = gone.limit(0)
    assert keys(feed.state_changes(states, gone, types=["T1"]), "id", "rev") == {("a", -1), ("c", -1)}
    assert keys(feed.state_changes(states, gone), "id") == {("c",)}


def test_updates_do_not_clear_the_deprecation(spark):
    schema = "org string, project string, id string, type string, rev int, ordering long, kind string, instant timestamp_ntz, subject string, types array<string>, schema string, payload string, tag string, target_rev int"
    row = lambda rev, kind, **x: ("o", "p", "a", "R", rev, rev, kind, None, "u", x.get("types"), x.get("schema"), x.get("payload"), x.get("tag"), x.get("target"))
    log = spark.createDataFrame([row(1, "Created", types=["T"], schema="s", payload="{}"), row(2, "Deprecated"), row(3, "Updated", types=["U"], schema="s", payload="1"), row(4, "TagAdded", tag="t", target=1), row(5, "Refreshed", types=["V"], payload="2")], schema)
    state = eventlog.fold_states(log).first()
    assert (state.deprecated, state.types, state.schema, state.payload, state.tags, state.valid) == (True, ["V"], "s", "2", {"t": 1}, True)
    assert keys(eventlog.tag_snapshots(log), "tag", "rev", "deprecated") == {("t", 1, False)}


def test_no_targeted_node_is_an_error(spark):
    t = spark.createDataFrame([("a", "type", "X", "")], "s string, p string, o string, datatype string")
    shapes = spark.createDataFrame([("Y", "p", 1, None, "string")], "type string, path string, min_count int, max_count int, datatype string")
    assert quality.conforms(quality.constraint_check(t, shapes)).first().verdict == "NoTargetedNode"


def test_acl_ancestors(spark):
    rows = spark.createDataFrame([("/",), ("/o",), ("/o/p",)], "a string").select("a", F.array_distinct(deps.ancestors(F.col("a"))).alias("up"))
    assert {r.a: r.up for r in rows.collect()} == {"/": ["/"], "/o": ["/", "/o"], "/o/p": ["/", "/o", "/o/p"]}


def test_json_functions_on_odd_input(spark):
    j = spark.createDataFrame([("{}",), ("no json",), (None,), ('{"a":{"_k":[1,{"_k":2}]}}',)], "j string")
    got = [r[0] for r in j.select(json_text.json_remove_all(F.col("j"), keys=("_k",))).collect()]
    assert got == ["{}", None, None, '{"a":{}}']
    got = [r[0] for r in j.select(json_text.json_extract_values(F.col("j"), "_k")).collect()]
    assert got[3] in ('[2,[1,{"_k":2}]]',) and got[0] == "[]"


def test_references(spark):
    r = spark.createDataFrame([("https://x/a?rev=0",), ("https://x/a?tag=t&rev=3",), ("https://x/a#b",)], "r string")
    c = F.col("r")
    assert [tuple(x) for x in r.select(iri.ref_kind(c), iri.ref_rev(c), iri.ref_tag(c)).collect()] == [("Latest", None, None), ("Revision", 3, None), ("Latest", None, None)]


def test_a_function_that_raises_fails_its_element_alone(spark):
    rows = spark.createDataFrame([("a", "Success", 2), ("b", "Success", 0), ("c", "Dropped", 0)], "id string, status string, n int")
    got = rows.transform(pipes.function_pipe(lambda row: 10 // row["n"], ["n"], "bigint"))
    assert keys(got, "id", "status", "value", "value_error") == {("a", "Success", 5, None), ("b", "Failed", None, "ZeroDivisionError"), ("c", "Dropped", None, None)}


def test_documents_to_a_graph_and_back(spark):
    doc = '{"@id":"x","@type":["T"],"knows":[{"@id":"y","name":[{"@value":"q\\"uote"}]}],"part":[{"size":[{"@value":1.5}],"ok":[{"@value":true}]}],"when":[{"@value":"2024","@type":"date"}]}'
    docs = spark.createDataFrame([("x", doc), ("z", "no json"), ("n", None), ("l", "[1]"), ("d", "[" * 100_000)], "id string, doc string")
    g = analytics.document_graph(docs)
    assert keys(g, "s", "p", "o", "kind", "datatype") == {
        ("x", "type", "T", "iri", ""),
        ("x", "knows", "y", "iri", ""),
        ("y", "name", 'q"uote', "literal", "string"),
        ("x", "part", "_:x/part/0", "blank", ""),
        ("_:x/part/0", "size", "1.5", "literal", "double"),
        ("_:x/part/0", "ok", "true", "literal", "boolean"),
        ("x", "when", "2024", "literal", "date"),
    }
    assert [r.document for r in pipes.nested_documents(g).collect()] == ['{"@id":"x","@type":"T","knows":{"@id":"y"},"part":{"ok":true,"size":1.5},"when":"2024"}']


def test_nested_nodes_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([("x", '{"part":{"size":1}}')], "id string, doc string").write.parquet(f"{tmp_path}/docs")
    got = pipes.nested_documents(analytics.document_graph(spark.read.parquet(f"{tmp_path}/docs")))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r.document for r in got.collect()] == ['{"@id":"x","part":{"size":1}}']


def test_sets_of_types_and_maps_of_tags(spark):
    rows = spark.createDataFrame([(["B", "A"], {"t": 1, "u": 2}), (None, {})], "types array<string>, tags map<string,int>")
    given = F.array(F.lit("A"), F.lit("C"))
    got = rows.select(sets.types_overlap(F.col("types"), given), sets.types_removed(F.col("types"), given), sets.types_union(F.col("types"), given), sets.tags_put(F.col("tags"), "t", F.lit(5)), sets.tags_remove(F.col("tags"), "t"), sets.tags_merge(F.col("tags"), F.create_map(F.lit("u"), F.lit(9)))).collect()
    assert [tuple(r) for r in got] == [(True, ["B"], ["A", "B", "C"], {"t": 5, "u": 2}, {"u": 2}, {"t": 1, "u": 9}), (False, [], ["A", "C"], {"t": 5}, {}, {"u": 9})]


def test_tags_of_an_untagged_resource(spark):
    tags, more = F.col("tags"), F.create_map(F.lit("u"), F.lit(9))
    row = spark.sql("select cast(null as map<string,int>) tags, 3 rev")
    put, removed, merged, kept = row.select(sets.tags_put(tags, "t", F.col("rev")), sets.tags_remove(tags, "t"), sets.tags_merge(tags, more), sets.tags_merge(more, tags)).first()
    assert (put, removed, merged, kept) == ({"t": 3}, {}, {"u": 9}, {"u": 9})



def test_composite_drops_elements_without_a_result(spark):
    t = spark.createDataFrame([("a", "a", "name", "n")], "resource string, s string, p string, o string")
    elements = spark.createDataFrame([("a", "Success"), ("b", "Success"), ("c", "Failed")], "id string, status string")
    got = sinks.composite(elements, t, [("?id", "name", "?n")], [("?id", "label", "?n")], pipes.to_documents)
    assert keys(got, "id", "status", "document") == {("a", "Success", '{"@id":"a","label":"n"}'), ("b", "Dropped", None), ("c", "Failed", None)}


def test_validation_skips_deprecated_and_unconstrained(spark):
    resources = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", None)], "id string, deprecated boolean")
    report = spark.createDataFrame([("a", "p", None), ("b", "p", "minCount"), ("b", "q", "datatype"), ("c", "p", "minCount")], "resource string, path string, violation string")
    assert keys(quality.validate(resources, report), "id", "status", "violations") == {("a", "Success", None), ("b", "Failed", "p:minCount,q:datatype"), ("c", "Dropped", None), ("d", "Dropped", None)}


def test_arrays_in_arrays_are_kept_in_a_document_graph(spark):
    docs = spark.createDataFrame([("x", '{"m":[[1,{"a":"b"}],[]],"j":{"@value":[1,2]}}')], "id string, doc string")
    assert keys(analytics.document_graph(docs), "s", "p", "o", "kind", "datatype") == {
        ("x", "m", "1", "literal", "integer"),
        ("x", "m", "_:x/m/0/1", "blank", ""),
        ("_:x/m/0/1", "a", "b", "literal", "string"),
        ("x", "j", "[1, 2]", "literal", "json"),
    }


def test_terms_are_expanded_by_a_context_and_compacted_by_the_longest_prefix(spark):
    context = spark.createDataFrame([("p", "@vocab", "http://v/"), ("p", "s", "http://schema/"), ("p", "person", "http://schema/Person/"), ("p", "name", "http://schema/name"), ("q", "s", "http://other/")], "project string, term string, iri string")
    rows = [("p", "s:age", "12", "literal"), ("p", "name", "s:Bob", "iri"), ("p", "knows", "http://y/z", "iri"), ("p", "x:y", "plain", "iri"), ("p", "type", "Cat", "iri"), ("q", "s:a", None, "literal"), ("p", "_:b", "_:c", "blank")]
    t = spark.createDataFrame(rows, "project string, p string, o string, kind string")
    full = analytics.expand_terms(t, context)
    assert keys(full, "project", "p", "o") == {("p", "http://schema/age", "12"), ("p", "http://schema/name", "http://schema/Bob"), ("p", "http://v/knows", "http://y/z"), ("p", "x:y", "plain"), ("p", "type", "http://v/Cat"), ("q", "http://other/a", None), ("p", "_:b", "_:c")}
    more = spark.createDataFrame([("p", "http://schema/Person/age"), ("p", "http://none"), ("p", None)], "project string, p string").unionByName(full.select("project", "p"))
    assert keys(analytics.compact_iris(more, context, "p"), "project", "p") == {("p", "person:age"), ("p", "http://none"), ("p", None), ("p", "s:age"), ("p", "name"), ("p", "knows"), ("p", "x:y"), ("p", "type"), ("q", "s:a"), ("p", "_:b")}


def test_documents_merged_from_source_and_graph(spark):
    elements = spark.createDataFrame([("a", "Success", '{"@id":"z","@type":"T","@context":{},"n":{"x":1,"@context":2}}'), ("b", "Success", "{}"), ("c", "Success", None), ("d", "Failed", '{"q":1}'), ("e", "Success", '{"only":[1]}')], "id string, status string, source string")
    graphs = spark.createDataFrame([("a", '{"@id":"a","n":{"y":2}}', '{"@id":"a","type":"T"}'), ("b", '{"@id":"b"}', '{"@id":"b","type":"T"}')], "id string, document string, typed string")
    rows = lambda **s: {r.id: (r.status, r.document) for r in pipes.resource_documents(elements, graphs, **s).collect()}
    assert rows() == {"a": ("Success", '{"@id":"z","@type":"T","n":{"x":1,"y":2}}'), "b": ("Success", '{"@id":"b","type":"T"}'), "c": ("Dropped", None), "d": ("Failed", None), "e": ("Success", '{"@id":"e","only":[1]}')}
    assert rows(context='{"@context":"c"}')["b"] == ("Success", '{"@context":"c","@id":"b","type":"T"}')


def test_deep_merging_in_the_jvm(spark):
    pairs = [('{"a":{"b":1,"c":{"d":1}},"x":1}', '{"a":{"b":2,"c":{"e":[1]}},"y":null}'), (None, '{"a":1}'), ("{}", '{"q":"w\\"z"}'), ('{"k":1}', "nope"), ('{"a":[1]}', '{"a":[2]}'), (None, None)]
    got = [r[0] for r in spark.createDataFrame(pairs, "l string, r string").select(merge.deep_merge(F.col("l"), F.col("r"))).collect()]
    assert got == ['{"a":{"b":2,"c":{"d":1,"e":[1]}},"x":1,"y":null}', '{"a":1}', '{"q":"w\\"z"}', '{"k":1}', '{"a":[2]}', None]


def test_imports_are_rejected_with_a_reason(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    resources = spark.createDataFrame([("o", ["Ontology", "X"]), ("r", ["X"]), ("n", None), ("s", ["X"])], "id string, types array<string>")
    got = deps.import_closure(ids("s", "o", "r", "n", "gone"), ids("s", "s"), resources)
    assert keys(got, "id", "source", "rejection") == {("s", "schema", None), ("o", "resource", None), ("r", "resource", "NotAnOntology"), ("n", "resource", "NotAnOntology"), ("gone", None, "NotFound")}


def test_access_lists_of_ancestors_added_and_subtracted(spark):
    acl = lambda *x: spark.createDataFrame(x, "address string, identity string, permission string")
    acls = acl(("/", "u", "read"), ("/o", "v", "read"), ("/o/p", "u", "write"), ("/o/q", "u", "write"))
    got = deps.acl_self(acls, spark.createDataFrame([("/o/p",), ("/o",)], "address string"), ["u"])
    assert keys(got, "asked", "address", "permission") == {("/o/p", "/", "read"), ("/o/p", "/o/p", "write"), ("/o", "/", "read")}
    more = deps.acl_add(acls, acl(("/", "u", "read"), ("/", "w", "read")))
    assert more.count() == 5
    assert keys(deps.acl_subtract(more, acl(("/", "w", "read"), ("/o", "v", "write"))), *acls.columns) == keys(acls, *acls.columns)


def test_one_graph_is_patched_and_one_node_renamed(spark):
    t = spark.createDataFrame([("g", "a", "p", "b"), ("g", "a", "q", "c"), ("h", "x", "p", "b"), ("h", "x", "p", "b"), (None, "n", "p", "b")], "resource string, s string, p string, o string")
    new = spark.createDataFrame([("g", "a", "p", "new"), ("g", "a", "q", "c")], t.schema)
    got = sorted((r.s, r.p, r.o) for r in graph.patch(t, "g", new, ["p"], keep=False).collect())
    assert got == [("a", "p", "new"), ("a", "q", "c"), ("n", "p", "b"), ("x", "p", "b"), ("x", "p", "b")]  # other graphs aren't touched
    star = t.select("s", "p", "o").distinct().unionByName(spark.createDataFrame([("a", "p", "z")], "s string, p string, o string"))
    assert keys(graph.replace_node(star, "b", "z"), "s", "p", "o") == {("a", "p", "z"), ("a", "q", "c"), ("x", "p", "z"), ("n", "p", "z")}
    assert graph.replace_node(star, "b", "z").count() == 4


def test_no_payload_isnt_a_broken_one(spark):
    schema = f"{KEY}, type string, tag string, types array<string>, instant timestamp_ntz, ordering long, rev int, payload string"
    states = spark.createDataFrame([("o", "p", i, "R", "latest", None, None, n, 1, j) for n, (i, j) in enumerate((("a", '{"k":1}'), ("b", None), ("c", "{")))], schema)
    gone = states.limit(0).withColumn("deleted", F.lit(True))
    assert keys(feed.state_values(states, gone, "k long"), "id", "status", "value.k") == {("a", "Success", 1), ("b", "Success", None), ("c", "Failed", None)}


def test_numbers_run_over_all_ranges_with_a_hot_project_and_nulls(spark):
    names = [("o", "hot", f"r{i}") for i in range(400)] + [("o", f"p{i}", "r") for i in range(20)] + [("n", "p", "r"), ("o", "hot", None), ("o", None, "r"), (None, None, None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that such few rows have several ranges
    try:
        got = deps.numbered(spark.createDataFrame(names, KEY), "org", "project", "id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(names, key=lambda r: [(c is None, c or "") for c in r])
    assert sorted((r.position, tuple(r)[:3]) for r in got) == list(enumerate(order, 1))
    assert deps.numbered(spark.createDataFrame([], KEY), "id", name="n").collect() == []

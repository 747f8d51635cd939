"""Streams: admission and restarts, the keyed index and its compaction."""

import datetime
import json
import time
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.operators import deps, pipes
from graphloom.plans import listing_queries
from graphloom.plans.registry import SQL
from graphloom.sources import files
from graphloom.streaming import activity, feeds, projections
from graphloom.streaming.composite import CompositeView, Source
from graphloom.streaming.index import KeyedIndex
from graphloom.streaming.references import ReferenceIndex
from tests.compare import connection, rows

ELEMENT = "org string, project string, id string, ordering long, status string, value string"


@pytest.fixture
def folder(spark):
    return f"{deps.shared_folder(spark).rstrip('/')}/t-{uuid.uuid4().hex}"


def elements(spark, *rows):
    return spark.createDataFrame([("o", "p", *r) for r in rows], ELEMENT)


def values(df):
    return {r.id: r.value for r in df.collect()}


def test_index_of_deltas_and_after_compaction(spark, folder):
    index = KeyedIndex(spark, folder, ["org", "project", "id"], buckets=4)
    assert index.write_batch(elements(spark, ("a", 1, "Success", "a1"), ("a", 2, "Success", "a2"), ("b", 3, "Success", "b"), ("c", 4, "Failed", "c"), (None, 5, "Success", "x")), 0)
    assert index.write_batch(elements(spark, ("b", 6, "Dropped", None), ("d", 7, "Success", "d"), ("a", 1, "Success", "old but in a later batch")), 1)
    assert values(index.read()) == {"a": "old but in a later batch", "d": "d"}
    assert index.compact() and index.manifest().deltas == [] and index.manifest().folded == 1
    assert values(index.read()) == {"a": "old but in a later batch", "d": "d"}
    assert index.write_batch(elements(spark, ("d", 8, "Dropped", None), ("e", 9, "Success", "e")), 2)
    assert values(index.read()) == {"a": "old but in a later batch", "e": "e"}


def test_a_replayed_batch_changes_nothing(spark, folder):
    index = KeyedIndex(spark, folder, ["id"], buckets=4)
    first = elements(spark, ("a", 1, "Success", "a1"))
    index.write_batch(first, 0)
    before = index.manifest()
    assert not index.write_batch(elements(spark, ("a", 1, "Success", "other")), 0) and index.manifest() == before
    index.write_batch(elements(spark, ("a", 2, "Success", "a2")), 1)
    index.compact()
    before = index.manifest()
    assert not index.write_batch(first, 0) and index.manifest() == before and values(index.read()) == {"a": "a2"}
    assert index.compact() == [] and index.manifest() == before


def test_what_no_commit_names_is_never_read(spark, folder):
    index = KeyedIndex(spark, folder, ["id"], buckets=2)
    index.write_batch(elements(spark, ("a", 1, "Success", "a1")), 0)
    m = index.manifest()
    index.write_batch(elements(spark, ("a", 2, "Success", "lost")), 1)
    files.delete(spark, f"{folder}/manifest/{m.version + 1:012d}.json")  # as if the writer had died before its commit
    assert values(index.read()) == {"a": "a1"}
    assert index.write_batch(elements(spark, ("a", 2, "Success", "again")), 1) and values(index.read()) == {"a": "again"}
    index.write_batch(elements(spark, ("b", 3, "Success", "b")), 2)
    with pytest.raises(files.Exists):
        index._commit(m)
    with pytest.raises(ValueError):
        KeyedIndex(spark, folder, ["id"], buckets=3).read()


def test_compaction_rewrites_touched_buckets_and_opens_no_old_batch(spark, folder):
    index = KeyedIndex(spark, folder, ["id"], buckets=8)
    index.write_batch(elements(spark, *((f"k{i}", i, "Success", "v") for i in range(200))), 0)
    assert index.compact() == list(range(8))
    before = set(index.read().inputFiles())
    index.write_batch(elements(spark, ("k7", 300, "Success", "new")), 1)
    touched = index.compact()
    after = set(index.read().inputFiles())
    assert len(touched) == 1 and len(before - after) == 1 and len(after - before) == 1
    assert not any("/delta/" in f for f in after)
    index.vacuum()
    assert files.names(spark, f"{folder}/delta") == [] and len(files.names(spark, f"{folder}/manifest")) == 1
    assert values(index.read())["k7"] == "new" and index.read().count() == 200
    one = index.lookup(spark.createDataFrame([("k7",), ("none",)], "id string"))
    assert values(one) == {"k7": "new"} and len(one.inputFiles()) <= 2


def test_a_bucket_that_empties_leaves_the_base(spark, folder):
    index = KeyedIndex(spark, folder, ["id"], buckets=1)
    index.write_batch(elements(spark, ("a", 1, "Success", "a")), 0)
    index.compact()
    index.write_batch(elements(spark, ("a", 2, "Dropped", None)), 1)
    index.compact()
    assert index.manifest().base == {} and index.read().count() == 0
    index.write_batch(elements(spark), 2)
    assert index.read().count() == 0 and index.read().columns == ["org", "project", "id", "ordering", "status", "value"]
    assert index.write_batch(elements(spark, ("a", 3, "Success", "back")), 3)
    assert index.read().select(F.first("value")).first()[0] == "back"


def read_batches(spark, path):
    return {b: sorted(r.position for r in rows) for b, rows in groups(spark.read.parquet(path).collect())}


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.batch_id, []).append(r)
    return sorted(out.items())


def append(spark, path, *positions):
    spark.createDataFrame([(p, f"v{p}") for p in positions], "position long, value string").coalesce(1).write.mode("append").parquet(path)


def feed(spark, folder, out="out", elements=lambda df: df, **settings):
    return feeds.run_feed(spark, f"{folder}/log", "position", elements, feeds.into_batches(f"{folder}/{out}", lambda df: df), checkpoint=f"{folder}/{out}-checkpoint", **settings)


def test_no_batch_is_larger_than_admitted_and_a_restart_goes_on(spark, folder):
    append(spark, f"{folder}/log", *range(10))
    feeds.finish(feed(spark, folder, max_elements=4))
    assert read_batches(spark, f"{folder}/out") == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9]}
    append(spark, f"{folder}/log", *range(10, 13), *range(1000, 1003))
    append(spark, f"{folder}/log", *range(5000, 5003))
    feeds.finish(feed(spark, folder, max_elements=4))
    got = read_batches(spark, f"{folder}/out")
    assert sorted(p for b in got.values() for p in b) == [*range(13), 1000, 1001, 1002, 5000, 5001, 5002] and max(map(len, got.values())) <= 4
    assert read_batches(spark, f"{folder}/out")[0] == [0, 1, 2, 3]


def test_a_batch_that_failed_comes_again_as_it_was(spark, folder):
    append(spark, f"{folder}/log", *range(6))
    seen = []

    def fail_once(batch, batch_id):
        seen.append((batch_id, sorted(r.position for r in batch.collect())))
        if len(seen) == 2:
            raise RuntimeError("sink")

    run = lambda: feeds.run_feed(spark, f"{folder}/log", "position", lambda df: df, fail_once, checkpoint=f"{folder}/c", max_elements=2)
    with pytest.raises(Exception, match="sink"):
        feeds.finish(run())
    append(spark, f"{folder}/log", 6, 7)
    feeds.finish(run())
    assert seen == [(0, [0, 1]), (1, [2, 3]), (1, [2, 3]), (2, [4, 5]), (3, [6, 7])]


def test_an_index_over_many_batches(spark, folder):
    append(spark, f"{folder}/log", *range(30))
    index = KeyedIndex(spark, f"{folder}/index", ["id"], buckets=2)
    shape = lambda df: df.selectExpr("concat('k', position % 7) id", "position ordering", "value", "if(position % 7 = 3, 'Dropped', 'Success') status")
    feeds.finish(feeds.run_feed(spark, f"{folder}/log", "position", shape, feeds.into_index(index, lambda df: df, compact_every=3), checkpoint=f"{folder}/c", max_elements=4, start=2))
    assert {r.id: r.ordering for r in index.read().collect()} == {f"k{p % 7}": p for p in range(23, 30) if p % 7 != 3}
    assert len(index.manifest().deltas) < 3 and index.manifest().folded >= 5


def test_a_trigger_takes_several_batches_that_stay_as_they_were(spark, folder):
    append(spark, f"{folder}/log", *range(10))
    append(spark, f"{folder}/log", 1000, 1001, 1002)
    calls = []
    sink = feeds.into_batches(f"{folder}/out", lambda df: df)

    def handle(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 2:
            raise RuntimeError("sink")
        sink(batch, batch_id)

    run = lambda: feeds.run_feed(spark, f"{folder}/log", "position", lambda df: df, handle, checkpoint=f"{folder}/c", max_elements=4, at_once=3)
    with pytest.raises(Exception, match="sink"):
        feeds.finish(run())
    append(spark, f"{folder}/log", 1003, 1004)
    feeds.finish(run())
    feeds.finish(feed(spark, folder, out="single", max_elements=4))
    assert calls == [2, 3, 3, 4]  # the batch that failed comes again, without what has been added since
    assert read_batches(spark, f"{folder}/out") == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9], 3: [1000, 1001, 1002], 4: [1003, 1004]}
    assert read_batches(spark, f"{folder}/single") == {0: [0, 1, 2, 3], 1: [4, 5, 6, 7], 2: [8, 9], 3: [1000, 1001, 1002, 1003], 4: [1004]}


RESOURCE = "project string, id string, ordering long, action string, types array<string>, deprecated boolean, doc string"


def found(index):
    return {(r.id, x.path, x.ref): x.found_types for r in index.read().collect() for x in r.references}


def test_referrers_are_refreshed_when_types_change(spark, folder):
    index = ReferenceIndex(spark, folder, buckets=8, parts=2, compact_every=2)
    doc = lambda *ids: '{"knows":[' + ",".join(f'{{"@id":"{i}"}}' for i in ids) + "]}"
    batch = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], RESOURCE)
    first = batch(("a", 1, "index", ["A"], False, doc("b", "x")), ("c", 2, "index", ["C"], False, doc("b")), ("d", 3, "index", ["D"], False, None), ("n", 4, "none", ["N"], False, doc("b")))
    index.handle(first, 0)
    assert found(index) == {("a", "knows", "b"): None, ("a", "knows", "x"): None, ("c", "knows", "b"): None}
    index.handle(batch(("b", 5, "update", ["B"], False, None), ("c", 6, "index", ["C"], False, doc("d"))), 1)
    want = {("a", "knows", "b"): ["B"], ("a", "knows", "x"): None, ("c", "knows", "d"): ["D"]}
    assert found(index) == want
    index.handle(batch(("b", 5, "update", ["wrong"], False, None)), 1)  # a batch that comes again
    assert found(index) == want
    before = {f for f in index.documents.read().inputFiles()}
    index.handle(batch(("b", 7, "index", ["B2"], True, doc("a")), ("d", 8, "update", ["D2"], False, None)), 2)
    assert found(index) == {("a", "knows", "b"): ["B2"], ("a", "knows", "x"): None, ("c", "knows", "d"): ["D2"]}
    assert before - set(index.documents.read().inputFiles()) == set()  # what no change touches stays
    assert {r.id for r in index.read().collect()} == {"a", "b", "c", "d"}


def test_exports_are_numbered_and_named_by_offset(spark, folder):
    log = spark.range(0, 1000, 1, 7).selectExpr("'o' org", "if(id % 2 = 0, 'p', 'q') project", "id * 3 ordering").repartition(5)
    for partitions in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            out = f"{folder}/export{partitions}"
            projections.export_events(log, out, offset=10, projects=[("o", "p")], lines=64)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = [i * 3 for i in range(0, 1000, 2) if i * 3 > 10]
        *names, marker = files.names(spark, out)
        assert marker == "_SUCCESS" and names == [f"{want[i]:012d}.json" for i in range(0, len(want), 64)]
        text = [json.loads(line)["ordering"] for n in names for line in files.read_text(spark, f"{out}/{n}").splitlines()]
        assert text == want
        assert json.loads(files.read_text(spark, f"{out}/_SUCCESS")) == {"offset": 10, "projects": ["o/p"], "lines": 64, "files": 8, "rows": len(want), "bytes": sum(len(json.dumps({"org": "o", "project": "p", "ordering": w}, separators=(",", ":"))) + 1 for w in want)}
    projections.export_events(log.limit(0), f"{folder}/none", lines=5)
    assert files.names(spark, f"{folder}/none") == ["_SUCCESS"]


def test_a_strict_bundle_fails_before_anything_is_visible(spark, folder):
    entries = spark.createDataFrame([(f"a/{i}.json", f"{{{i}}}\n") for i in range(20)] + [("gone.json", None)], "path string, content string").repartition(4)
    projections.write_bundle(entries, f"{folder}/loose")
    got = {r.path: r.content for r in projections.read_bundle(spark, f"{folder}/loose").collect()}
    assert got == {f"a/{i}.json": f"{{{i}}}\n" for i in range(20)}
    manifest = json.loads(files.read_text(spark, f"{folder}/loose/manifest.json"))
    assert manifest["rows"] == 20 and len(files.names(spark, f"{folder}/loose")) == manifest["files"] + 1
    with pytest.raises(Exception, match="gone.json"):
        projections.write_bundle(entries, f"{folder}/strict", strict=True)
    assert files.names(spark, f"{folder}/strict") == []


def test_a_project_turns_inactive_without_new_input(spark, folder):
    now = spark.sql("select current_timestamp() t").first().t
    row = [("o", "p", now), ("o", "old", now - datetime.timedelta(days=1))]
    spark.createDataFrame(row, "org string, project string, instant timestamp").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("org string, project string, instant timestamp").parquet(f"{folder}/in")
    changes = activity.activity_changes(stream, 25, by_event=False)
    query = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            got = [tuple(r) for r in spark.read.schema(activity.CHANGE).parquet(f"{folder}/out").select("project", "active").collect()] if files.exists(spark, f"{folder}/out/_spark_metadata") else []
            if ("p", False) in got:
                break
    finally:
        query.stop()
    assert sorted(got) == [("old", False), ("p", False), ("p", True)]
    assert {r.project: r.active for r in activity.last_changes(spark.read.parquet(f"{folder}/out")).collect()} == {"p": False, "old": False}


def test_a_composite_view_goes_on_where_its_branches_are(spark, folder):
    append(spark, f"{folder}/a", *range(12))
    append(spark, f"{folder}/b", *range(100, 107))
    shape = lambda df: df.selectExpr("'o' org", "'p' project", "value id", "position ordering", "cast(null as timestamp) instant", "'Success' status", "position % 2 = 0 deprecated")
    sources = {n: Source(f"{folder}/{n}", "position", shape) for n in "ab"}
    broken = []

    def fails_once(rows):
        if rows.filter("ordering = 9").count() and not broken:
            broken.append(1)
            raise RuntimeError("target")
        return rows.transform(pipes.lookup("filterDeprecated"))

    view = CompositeView(spark, f"{folder}/view", sources, {"all": pipes.chain(), "odd": fails_once})
    with pytest.raises(Exception, match="target"):
        view.run_source("a", max_elements=5)
    assert (view.offset("main", "a", "all"), view.offset("main", "a", "odd"), view.start("main", "a")) == (9, 4, 4)
    append(spark, f"{folder}/a", 12)
    view.run(max_elements=5)
    assert sorted(r.ordering for r in view.elements("all").collect()) == [*range(13), *range(100, 107)]
    assert sorted((r.ordering, r.status) for r in view.elements("odd").collect()) == [(i, "Success" if i % 2 else "Dropped") for i in (*range(13), *range(100, 107))]
    done = {(r.source, r.target): (r.processed, r.discarded, r.offset) for r in view.progress().collect()}
    assert done == {("a", "all"): (13, 0, 12), ("a", "odd"): (13, 7, 12), ("b", "all"): (7, 0, 106), ("b", "odd"): (7, 4, 106)}
    assert view.progress(run="rebuild").count() == 0 and view.start("rebuild", "a") == -1


def test_a_branch_takes_several_batches_and_knows_each(spark, folder):
    append(spark, f"{folder}/a", *range(12))
    shape = lambda df: df.selectExpr("'o' org", "'p' project", "value id", "position ordering", "cast(null as timestamp) instant", "'Success' status", "position % 2 = 0 deprecated", feeds.BATCH)
    view = CompositeView(spark, f"{folder}/view", {"a": Source(f"{folder}/a", "position", shape)}, {"all": pipes.chain(), "odd": pipes.lookup("filterDeprecated")})
    view.run(max_elements=5, at_once=2)
    assert files.names(spark, f"{folder}/view/main/a/odd/elements") == ["upto=11", "upto=9"]
    each = spark.read.parquet(f"{folder}/view/main/a/odd/progress").collect()
    assert sorted((r.processed, r.discarded, r.offset) for r in each) == [(2, 1, 11), (5, 2, 9), (5, 3, 4)]
    done = {r.target: (r.processed, r.discarded, r.offset) for r in view.progress().collect()}
    assert done == {"all": (12, 0, 11), "odd": (12, 6, 11)} and view.elements("all").count() == 12


def test_of_several_batches_in_an_index_the_later_one_counts(spark, folder):
    append(spark, f"{folder}/log", *range(30))
    index = KeyedIndex(spark, f"{folder}/index", ["id"], buckets=2)
    shape = lambda df: df.selectExpr("concat('k', position % 7) id", "-position ordering", "position", "if(position = 28, 'Dropped', 'Success') status", feeds.BATCH)
    feeds.finish(feeds.run_feed(spark, f"{folder}/log", "position", shape, feeds.into_index(index, lambda df: df, compact_every=3), checkpoint=f"{folder}/c", max_elements=4, at_once=6))
    m = index.manifest()
    assert (m.deltas, m.folded) == ([7], 5)  # as many writes as triggers, numbered by their last batch; the first one held enough batches to be folded
    assert {r.id: r.position for r in index.read().collect()} == {"k1": 29, "k2": 23, "k3": 24, "k4": 25, "k5": 26, "k6": 27}
    assert index.read().columns == ["id", "ordering", "position", "status"]
    assert not index.write_batch(spark.createDataFrame([("k1", 99, 99, "Success")], "id string, ordering long, position long, status string"), 7)


def test_the_upsert_query_writes_its_batches_by_the_trigger(spark, sf_dir, monkeypatch):
    writes, write = [], KeyedIndex.write_batch
    monkeypatch.setattr(KeyedIndex, "write_batch", lambda index, rows, batch_id: writes.append(batch_id) or write(index, rows, batch_id))
    monkeypatch.setattr(listing_queries, "ADMITTED", 50)
    got = listing_queries.sink_document_upsert(spark, sf_dir).toPandas()
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert writes == [(n - 1) // 50] and writes[0] > 10  # batches by number, from 0 on
    assert rows(got) == rows(connection(sf_dir).sql(SQL["sink_document_upsert"]).df())


def test_open_deltas_without_a_base_are_read_once(spark, folder):
    index = KeyedIndex(spark, folder, ["id"], buckets=2)
    index.write_batch(elements(spark, ("a", 1, "Success", "a1"), ("b", 2, "Success", "b")), 0)
    assert "Exchange" not in index.read()._jdf.queryExecution().executedPlan().toString()  # one delta holds a key once
    index.write_batch(elements(spark, ("b", 3, "Dropped", None)), 1)
    scans = index.read()._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans == 1 and values(index.read()) == {"a": "a1"}


def test_a_refreshed_document_is_read_once_and_keeps_the_rest(spark, folder):
    index = ReferenceIndex(spark, folder, buckets=4, parts=2)
    batch = lambda *rows: spark.createDataFrame([("p", *r) for r in rows], RESOURCE)
    index.handle(batch(("a", 1, "index", ["A"], False, '{"knows":[{"@id":"b"},{"@id":"b","@type":"X"},{"@id":"c"}],"name":"n"}'), ("e", 2, "index", ["E"], False, "{}")), 0)
    changed = spark.createDataFrame([("p", "b", ["B"])], "project string, id string, types array<string>")
    rows = index._refreshed(changed, spark.createDataFrame([("p", "a")], "project string, id string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    index.handle(batch(("b", 3, "update", ["B"], False, None)), 1)
    got = {r.id: r for r in index.read().collect()}
    assert [(x.path, x.in_array, x.ref, x.found_types) for x in got["a"].references] == [("knows", True, "b", ["B"]), ("knows", True, "b", ["B"]), ("knows", True, "c", None)]
    assert (got["a"].ordering, got["a"].types, got["a"].deprecated, got["e"].references) == (1, ["A"], False, [])

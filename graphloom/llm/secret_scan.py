"""Secrets in all versions of all texts, by an incremental ledger of blobs.

A version of a path is addressed by the SHA-256 of its text: its blob.  The ledger, a folder of Parquet tables, says which
rules, each with its version, have been applied to which blob, and what they found.  A scan

1. counts the blobs of the given versions by their addresses alone and takes from each the pairs (blob, rule version) that
   the ledger holds already;
2. reads the texts of blobs with pairs left: a blob that only one row has, and the ledger doesn't know, is scanned where
   its row stands; of others, and of rows that a bounded filter can't tell from them, one row per blob is kept (before the
   shuffle, too), so no text is scanned twice by the same rule;
3. appends the pairs and their findings as one table, which counts from the moment when it is complete.

Findings are joined back to all paths by address, so one scan answers for every copy.  A rule that gets a new version, or is
new, is applied to all blobs that are asked for again; the others stay as they are.  One scan writes to a ledger at a time.

Defined cases: a null text is an empty one; a null path stays null; repeated rows each get their findings; equal texts share
one blob; very long texts are scanned whole; matches of one rule don't overlap, those of different rules may; positions count
code points, the end is exclusive; without rows nothing is scanned and the result is empty; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, id_bucket, maybe_in, shared_dir, stored


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches are findings if their group is long enough; a change of any of it needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, (re.IGNORECASE if self.any_case else 0) | re.ASCII)


#: Assignments, access keys and hexadecimal keys: what every scan must find.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}", least=24),
)
#: Further kinds: private keys, signed tokens, names and passwords in URLs.
MORE = (
    Rule("private", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("login", r"://[^\x00-\x20/:@]{1,200}:[^\x00-\x20/:@]{1,200}@"),
)
RULES = (*BASE, *MORE)

FINDING = "struct<rule:string,kind:string,start:int,end:int>"
LEDGER = f"blob string, rules array<string>, findings array<{FINDING}>"


def spans(text: str, rule: Rule, pattern: re.Pattern | None = None) -> list[tuple[int, int]]:
    """Leftmost matches, then those whose group is long enough: a short one still uses up its characters."""
    return [m.span() for m in (pattern or rule.compiled()).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scanned(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """LEDGER rows of (blob, text, todo)."""

    def run(batches):
        patterns = {r.key: (r, r.compiled()) for r in rules}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = []
            for text, todo in zip(batch.column(1), batch.column(2), strict=True):
                text, own = text.as_py(), []
                for key in todo.as_py():
                    rule, pattern = patterns[key]
                    own += [{"rule": key, "kind": rule.kind, "start": a, "end": b} for a, b in spans(text, rule, pattern)]
                found.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], ["blob", "rules", "findings"])

    bounded_batches(rows)
    return rows.select("blob", "text", "todo").mapInArrow(run, LEDGER)


class BlobLedger:
    """What has been scanned, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _scans(self) -> list[str]:
        """The tables of finished scans."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = sorted(str(s.getPath().getName()) for s in fs.listStatus(folder))
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return [f"{self.path}/{n}" for n in names if n.startswith("scan-") and fs.exists(done(f"{self.path}/{n}/_SUCCESS"))]

    def read(self) -> DataFrame:
        """blob, rules, findings: a row for each blob and scan that applied rules to it."""
        scans = self._scans()
        return self.spark.read.schema(LEDGER).parquet(*scans) if scans else self.spark.createDataFrame([], LEDGER)

    def pending(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, n_rows, known, todo: the given versions' blobs, with the rules that are left to apply to each."""
        blobs = versions.select(address().alias("blob")).groupBy("blob").agg(F.count("*").alias("n_rows"))
        keys = F.array(*(F.lit(r.key) for r in rules))
        if not self._scans():
            return blobs.withColumns({"known": F.lit(False), "todo": keys})
        done = self.read().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        rows = blobs.join(done, "blob", "left").withColumn("known", F.col("done").isNotNull())
        return rows.withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))).drop("done")

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is unseen of versions (text); the rows that this added to the ledger."""
        keys = F.array(*(F.lit(r.key) for r in rules))
        done = self._scans()
        blobs = self.pending(versions, rules)
        rows = versions.select(address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        moved = blobs.filter("n_rows > 1 or known")
        if done:
            blobs = stored(blobs)
            left = blobs.filter("size(todo) > 0").select(id_bucket(F.col("blob")).alias("left_bucket")).distinct()
            # bucket numbers of blobs with pairs left: ID_BUCKETS at most
            near = lambda df: df.join(F.broadcast(left), id_bucket(F.col("blob")) == F.col("left_bucket"), "left_semi")
            rows, moved = near(rows), near(blobs.filter("n_rows > 1 or known"))
        moved = stored(moved.select("blob", "todo"))
        alone = maybe_in(rows, moved, "blob", "left_anti").withColumn("todo", keys)
        several = maybe_in(rows, moved, "blob").groupBy("blob").agg(F.first("text").alias("text")).join(moved, "blob", "left")
        several = several.withColumn("todo", F.coalesce("todo", keys)).filter("size(todo) > 0")
        path = f"{self.path}/scan-{len(done):06d}"
        _scanned(alone.unionByName(several), rules).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path)

    def findings(self, versions: DataFrame, path: Column, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """path, blob, findings of every version, in order of start and of the rules; a version without findings has an empty array.

        Rule versions that aren't asked for don't count, nor do blobs that haven't been scanned: scan() first.
        """
        keys = [r.key for r in rules]
        own = self.read().select("blob", F.filter("findings", lambda f: f["rule"].isin(keys)).alias("findings")).filter("size(findings) > 0")
        order = F.array(*(F.lit(k) for k in keys))
        placed = F.transform(F.flatten(F.collect_list("findings")), lambda f: F.struct(f["start"].alias("start"), F.array_position(order, f["rule"]).alias("place"), f["end"].alias("end"), f["kind"].alias("kind"), f["rule"].alias("rule")))
        # stored: the join's sides are plain shuffles then, so that Spark splits a blob which many paths share
        view = stored(own.groupBy("blob").agg(F.array_sort(placed).alias("findings")))
        rows = versions.select(path.alias("path"), address().alias("blob")).join(view, "blob", "left")
        out = F.transform("findings", lambda f: F.struct(f["kind"].alias("kind"), f["rule"].alias("rule"), f["start"].alias("start"), f["end"].alias("end")))
        return rows.select("path", "blob", F.coalesce(out, F.array().cast("array<struct<kind:string,rule:string,start:int,end:int>>")).alias("findings"))


def address() -> Column:
    """The blob of a row's text."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def ledger_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}"


def as_spans(findings: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def secrets_of(ledger: BlobLedger, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, blob: documents as paths, after a scan of what is new."""
    ledger.scan(docs, rules)
    rows = ledger.findings(docs, F.col("doc_id").cast("long"), rules)
    of = lambda *kinds: F.filter("findings", lambda f: f["kind"].isin(*kinds))
    base = of(*(r.kind for r in BASE))
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return rows.select(F.col("path").alias("doc_id"), *counts, F.sha2(as_spans(base), 256).alias("base_sha256"), as_spans(F.col("findings")).alias("spans"), "blob")

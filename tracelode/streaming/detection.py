"""Standing patterns as streams: each batch's new edges meet all edges so far; a ledger keeps firings single.

A pattern fires once for a key, on the write that completes it, whatever order the writes come in. Every
micro-batch appends its edges to a log and joins its own edges with the log on each side of the pattern. Keys
that the ledger doesn't hold yet are appended to it under the batch's number, so a batch that runs again after a
failure overwrites its own firings and repeats none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators import history, patterns
from tracelode.sources import work
from tracelode.sources.domain import Domain


class Ledger:
    """Edges and firings by batch, in folders that a repeated batch overwrites."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def put(self, kind: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")

    def until(self, kind: str, batch: int, schema, inclusive: bool) -> DataFrame:
        last = batch if inclusive else batch - 1
        if last < 0:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{kind}/batch={k}" for k in range(last + 1)]
        return self.spark.read.schema(schema).parquet(*paths)


def replay(spark: SparkSession, edges: DataFrame, pattern: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], files: int = 3) -> DataFrame:
    """Streams ``edges`` file by file and returns all firings of ``pattern(new edges, edges so far)``."""
    folder = work.folder(spark)
    edges.repartition(files).write.parquet(f"{folder}/in")
    ledger = Ledger(spark, f"{folder}/state")
    fired_schema: list = []

    def batch(rows: DataFrame, number: int) -> None:
        ledger.put("edges", number, rows)
        new = spark.read.schema(edges.schema).parquet(f"{ledger.folder}/edges/batch={number}")
        hits = pattern(new, ledger.until("edges", number, edges.schema, True)).dropDuplicates(key)
        if not fired_schema:
            fired_schema.append(hits.schema)
        ledger.put("fired", number, hits.join(ledger.until("fired", number, hits.schema, False).select(*key), key, "left_anti"))

    stream = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    run = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    done = run.lastProgress["batchId"] if run.lastProgress else -1
    if not fired_schema:
        empty = spark.createDataFrame([], edges.schema)
        return pattern(empty, empty)
    return ledger.until("fired", max(done, 0), fired_schema[0], True)


def _typed(etype: str, df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select("project", F.lit(etype).alias("etype"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))


def actionable(new: DataFrame, every: DataFrame) -> DataFrame:
    """(project, ticket_id): ticket -> error <- known issue -> fix, where one edge at least is new."""
    hits = []
    for fresh in ("TICKET_ERROR", "ISSUE_ERROR", "ISSUE_FIX"):
        side = {e: (new if e == fresh else every).where(F.col("etype") == e) for e in ("TICKET_ERROR", "ISSUE_ERROR", "ISSUE_FIX")}
        tickets = side["TICKET_ERROR"].select("project", F.col("a").alias("ticket_id"), F.col("b").alias("error"))
        issues = side["ISSUE_ERROR"].select("project", F.col("a").alias("issue"), F.col("b").alias("error"))
        fixes = side["ISSUE_FIX"].select("project", F.col("a").alias("issue"))
        hits.append(tickets.join(issues, ["project", "error"]).join(fixes, ["project", "issue"]).select("project", "ticket_id"))
    return hits[0].union(hits[1]).union(hits[2]).distinct()


def replay_actionable(d: Domain) -> DataFrame:
    edges = _typed("TICKET_ERROR", d.ticket_errors, "ticket_id", "error").union(_typed("ISSUE_ERROR", d.issue_errors, "issue", "error")).union(_typed("ISSUE_FIX", d.issue_fixes, "issue", "fix"))
    return replay(d.spark, edges, actionable, ["project", "ticket_id"])


def replay_new_bug(d: Domain) -> DataFrame:
    writes = patterns.new_bug(d).select("project", "source_system", "ticket_id")
    return replay(d.spark, writes, lambda new, every: new.distinct(), ["project", "ticket_id"])


def replay_error_flagged(d: Domain) -> DataFrame:
    return replay(d.spark, d.ticket_errors, lambda new, every: new.select("project", "ticket_id").distinct(), ["project", "ticket_id"])


def corroborated(new: DataFrame, every: DataFrame) -> DataFrame:
    """(event_id, error): failures whose error a ticket reports, where one of the two is new."""
    hits = []
    for fresh in ("TICKET_ERROR", "FAILURE"):
        side = {e: (new if e == fresh else every).where(F.col("etype") == e) for e in ("TICKET_ERROR", "FAILURE")}
        failures = side["FAILURE"].select(F.col("a").alias("event_id"), F.col("b").alias("error"))
        hits.append(failures.join(side["TICKET_ERROR"].select(F.col("b").alias("error")).distinct(), "error", "left_semi").select("event_id", "error"))
    return hits[0].union(hits[1]).distinct()


def replay_ci_corroboration(d: Domain) -> DataFrame:
    failed = _typed("FAILURE", history.failures(d).withColumn("project", F.lit("")), "event_id", "error")
    return replay(d.spark, failed.union(_typed("TICKET_ERROR", d.ticket_errors, "ticket_id", "error")), corroborated, ["event_id"])


def crowded(new: DataFrame, every: DataFrame, least: int = 3) -> DataFrame:
    """(project, feature): features with new edges that ``least`` tickets affect by now."""
    met = every.join(new.select("project", "feature").distinct(), ["project", "feature"], "left_semi")
    return met.groupBy("project", "feature").agg(F.countDistinct("ticket_id").alias("n")).where(F.col("n") >= least).select("project", "feature")


def replay_root_cause(d: Domain) -> DataFrame:
    open_ones = d.tickets.where("status = 'open'").select("project", "ticket_id")
    return replay(d.spark, d.affects.join(open_ones, ["project", "ticket_id"], "left_semi"), crowded, ["project", "feature"])


def replay_file_escalation(d: Domain, least: int = 3) -> DataFrame:
    """Flags stream in; the latest commits are read from the graph when a pattern is looked up."""
    last = patterns.last_touches(d)

    def pattern(new: DataFrame, every: DataFrame) -> DataFrame:
        met = every.join(new.select("project", "path").distinct(), ["project", "path"], "left_semi")
        return patterns.escalated(met, last, least).select("project", "path", "since_commit")

    return replay(d.spark, patterns.dated_flags(d).select("project", "ticket_id", "path", "created_on"), pattern, ["project", "path", "since_commit"])

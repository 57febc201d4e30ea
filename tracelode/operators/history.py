"""Snapshots and their differences, continuous-integration facts, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.sources.domain import Domain


def prior_snapshots(d: Domain) -> DataFrame:
    """Each manifest's snapshots with the one before, if any (a backward as-of join as one window)."""
    days = d.snapshots.select("manifest", "captured").distinct()
    order = Window.partitionBy("manifest").orderBy("captured")
    return days.withColumn("prior", F.lag("captured").over(order))


def manifest_changes(d: Domain) -> DataFrame:
    """Packages added, removed or changed between neighbouring snapshots; a first snapshot changes nothing."""
    pairs = prior_snapshots(d).where("prior is not null")
    now = d.snapshots.join(pairs, ["manifest", "captured"]).select("manifest", "captured", "package", F.col("version").alias("to_version"))
    before = d.snapshots.withColumnRenamed("captured", "prior").join(pairs, ["manifest", "prior"]).select("manifest", "captured", "package", F.col("version").alias("from_version"))
    both = now.join(before, ["manifest", "captured", "package"], "full_outer")
    kind = F.when(F.col("from_version").isNull(), "added").when(F.col("to_version").isNull(), "removed").when(F.col("from_version") != F.col("to_version"), "changed")
    return both.withColumn("change_kind", kind).where("change_kind is not null")


def change_counts(d: Domain) -> DataFrame:
    return manifest_changes(d).groupBy("manifest", "change_kind").agg(F.count("*").alias("n"))


def dependency_evidence(d: Domain) -> DataFrame:
    """Changes whose month a commit of the same manifest lies in, by package."""
    commits = d.touches.select(F.regexp_extract("sha", r"^c([0-9]+)-", 1).cast("long").alias("manifest"), F.col("committed").alias("captured"), "sha").distinct()
    return manifest_changes(d).join(commits, ["manifest", "captured"]).groupBy("package").agg(F.countDistinct("sha").alias("commits"), F.count("*").alias("changes"))


def successful_prefix(d: Domain) -> DataFrame:
    """Per user: how far a cursor may move, which is up to the first error."""
    order = Window.partitionBy("user_id").orderBy("occurred", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = d.executions.withColumn("ok", F.min((F.col("event_type") != "error").cast("int")).over(order))
    return seen.groupBy("user_id").agg(F.sum("ok").alias("processed"), F.count("*").alias("events"))


def failures(d: Domain) -> DataFrame:
    return d.executions.where("event_type = 'error'").select("run", "event_id", "error")


def run_summary(d: Domain) -> DataFrame:
    """Per run: executions, failures, whether any and whether all failed."""
    failed = F.col("event_type") == "error"
    return d.executions.groupBy("run").agg(F.count("*").alias("executions"), F.count_if(failed).alias("failures"), F.bool_or(failed).cast("int").alias("any_failed"), F.bool_and(failed).cast("int").alias("all_failed"))


def test_path_resolution(d: Domain) -> DataFrame:
    """Executions' class names resolved to test files by path suffix: the longest candidate with a match decides."""
    names = d.parts.where("role = 'test'").select("part", F.concat(F.lit("tests.test_"), F.col("part").cast("string"), F.lit(".TestCase")).alias("classname"))
    asked = names.select("classname", F.posexplode(text.candidate_paths(F.col("classname"))).alias("rank", "candidate"))
    known = d.parts.where("role = 'test'").select("path", F.explode(text.path_suffixes(F.col("path"))).alias("candidate"))
    met = asked.join(known, "candidate").groupBy("classname", "rank").agg(F.countDistinct("path").alias("matches"), F.min("path").alias("path"))
    best = met.groupBy("classname").agg(F.min_by(F.struct("matches", "path"), "rank").alias("m"))
    state = F.when(F.col("m.matches") == 1, "resolved").when(F.col("m.matches") > 1, "ambiguous").otherwise("unresolved")
    return names.join(best, "classname", "left").select("classname", state.alias("link_state"), F.when(F.col("m.matches") == 1, F.col("m.path")).alias("path"))


def test_failure_evidence(d: Domain, worth: float = 9.0) -> DataFrame:
    """Test files whose executions failed: one piece of evidence for each failure."""
    tests = d.parts.where("role = 'test'").select(F.col("part").alias("error"), "path")
    failed = failures(d).dropDuplicates(["event_id"])
    return failed.join(tests, "error").select("path", "event_id", F.lit("recent_test_failure").alias("type"), F.lit(worth).alias("score"), F.col("run").alias("why"))

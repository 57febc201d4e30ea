"""Multi-hop and threshold patterns over the graph in their batch form, and the ledgers around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.operators import graph, history
from tracelode.sources.domain import Domain

KEY = ["project", "ticket_id"]


def actionable(d: Domain) -> DataFrame:
    """Tickets that share an error with a resolved known issue."""
    return graph.known_issue_fixes(d)


def new_bug(d: Domain) -> DataFrame:
    return d.tickets.where("kind = 'bug'").select("project", "source_system", "ticket_id")


def error_flagged(d: Domain) -> DataFrame:
    return d.tickets.join(d.ticket_errors, KEY, "left_semi").select("project", "source_system", "ticket_id")


def ci_corroboration(d: Domain) -> DataFrame:
    """Failures whose error some ticket reports, with the number of such tickets by project."""
    reporting = d.ticket_errors.groupBy("project", "error").agg(F.count("*").alias("tickets"))  # tickets are distinct
    return history.failures(d).join(reporting, "error").select("event_id", "run", "project", "tickets")


def root_cause(d: Domain, least: int = 3) -> DataFrame:
    """Features that ``least`` open tickets affect."""
    near = d.affects.join(d.tickets.where("status = 'open'").select(*KEY), KEY, "left_semi")
    return near.groupBy("project", "feature").agg(F.count("*").alias("open_tickets")).where(F.col("open_tickets") >= least)


def file_escalation(d: Domain, least: int = 3) -> DataFrame:
    """Files that ``least`` tickets flag after the file's latest commit."""
    return escalated(dated_flags(d), last_touches(d), least)


def last_touches(d: Domain) -> DataFrame:
    last = d.touches.groupBy("project", "path").agg(F.max(F.struct("committed", "sha")).alias("m"))
    return last.select("project", "path", F.col("m.sha").alias("since_commit"), F.col("m.committed").alias("committed"))


def dated_flags(d: Domain) -> DataFrame:
    return d.flags.join(d.tickets.select(*KEY, "created_on"), KEY)


def escalated(flags: DataFrame, last: DataFrame, least: int) -> DataFrame:
    later = flags.join(last, ["project", "path"]).where("created_on > committed")
    return later.groupBy("project", "path", "since_commit").agg(F.countDistinct("ticket_id").alias("tickets")).where(F.col("tickets") >= least)


def first_milestones(d: Domain) -> DataFrame:
    """The first failure of each run and error: one milestone each."""
    order = Window.partitionBy("run", "error").orderBy("occurred", "event_id")
    own = d.executions.where("event_type = 'error'").withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return own.select("run", "error", "event_id")


def escalation_sequence(d: Domain) -> DataFrame:
    """Escalations of a feature numbered by month of their tickets; the latest is open."""
    own = d.affects.join(d.tickets.select(*KEY, "created_on"), KEY)
    months = own.groupBy("project", "feature", F.trunc("created_on", "month").alias("month")).agg(F.countDistinct("ticket_id").alias("tickets")).where("tickets >= 3")
    whole = Window.partitionBy("project", "feature")
    seq = F.row_number().over(whole.orderBy("month"))
    return months.withColumn("sequence", seq).withColumn("is_open", (F.col("sequence") == F.count("*").over(whole)).cast("int"))


def deleted_tickets(d: Domain) -> DataFrame:
    """Tickets not deleted that the source's present list (orders with a line) no longer has."""
    present = d.table("lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01'").select(F.col("l_orderkey").alias("ticket_id")).distinct()
    return d.tickets.where("status <> 'deleted'").join(present, "ticket_id", "left_anti").select(*KEY)


def backfill_created(d: Domain) -> DataFrame:
    """A ticket's creation date, or else its first shipment (the earliest trace of it)."""
    first = d.lines.groupBy(*KEY).agg(F.min(F.col("l_shipdate").cast("date")).alias("first_seen"))
    dated = d.tickets.select(*KEY, F.when(F.col("status") != "closed", F.col("created_on")).alias("created_on"))
    return dated.join(first, KEY, "left").select(*KEY, F.coalesce("created_on", "first_seen").alias("created_on"))


def unflagged(d: Domain) -> DataFrame:
    return d.tickets.where("status = 'open'").join(d.flags, KEY, "left_anti").select(*KEY)

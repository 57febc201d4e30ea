"""The driver's tables projected onto the engine's graph: vertices and edges keyed by (project, natural key)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def project_path(part: Column, kind: Column, size: Column) -> Column:
    """Where a part's file lies: tests, docs or source by its size."""
    return (
        F.when(size % 5 == 0, F.concat(F.lit("tests/test_"), part.cast("string"), F.lit(".py")))
        .when(size % 7 == 0, F.concat(F.lit("docs/"), part.cast("string"), F.lit(".md")))
        .otherwise(F.concat(F.lit("src/"), kind, F.lit("/"), part.cast("string"), F.lit(".py")))
    )


#: Words that the tables' made-up texts and names are put together from.
WORDS = ("socket", "parser", "cache", "index", "buffer", "timer", "queue", "mutex", "schema", "router", "cursor")


def word(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WORDS)), (number % len(WORDS) + 1).cast("int"))


class Domain:
    """Lazy frames over one folder of tables. Every frame is distinct in its key."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def projects(self) -> DataFrame:
        return self.table("region").select(F.col("r_name").alias("project"))

    @cached_property
    def tickets(self) -> DataFrame:
        """project, source_system, ticket_id, status, kind, created_on"""
        people = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        people = people.select("c_custkey", F.col("r_name").alias("project"), F.col("c_mktsegment").alias("source_system"))
        status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("deleted")
        kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "bug").when(F.col("o_orderpriority") == "3-MEDIUM", "feature_request")
        joined = self.table("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
        return joined.select("project", "source_system", F.col("o_orderkey").alias("ticket_id"), status.alias("status"), kind.alias("kind"), F.col("o_orderdate").cast("date").alias("created_on"))

    @cached_property
    def parts(self) -> DataFrame:
        path = project_path(F.col("p_partkey"), F.col("p_type"), F.col("p_size"))
        role = F.when(F.col("p_size") % 5 == 0, "test").when(F.col("p_size") % 7 == 0, "doc").otherwise("source")
        module = F.concat_ws("-", "p_brand", "p_type")
        return self.table("part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("feature"), module.alias("module"), path.alias("path"), role.alias("role"), (F.col("p_size") <= 25).alias("is_primary"))

    @cached_property
    def files(self) -> DataFrame:
        """project, feature, module, part, path, role, is_primary: every project has the whole catalogue."""
        return self.parts.crossJoin(F.broadcast(self.projects))  # one row a project

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their ticket's project; tickets are found once for all edges."""
        keys = self.tickets.select(F.col("ticket_id").alias("l_orderkey"), "project", "status", "created_on")
        return self.table("lineitem").join(keys, "l_orderkey").withColumnRenamed("l_orderkey", "ticket_id")

    @cached_property
    def affects(self) -> DataFrame:
        """project, ticket_id, feature"""
        own = self.lines.where("l_returnflag = 'R'").join(self.parts, F.col("l_partkey") == F.col("part"))
        return own.select("project", "ticket_id", "feature").distinct()

    @cached_property
    def ticket_errors(self) -> DataFrame:
        """project, ticket_id, error"""
        return self.lines.where("l_linestatus = 'F'").select("project", "ticket_id", F.col("l_suppkey").alias("error")).distinct()

    @cached_property
    def issue_errors(self) -> DataFrame:
        """project, issue, error: known issues of every third supplier."""
        own = self.table("supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").cast("long").alias("issue"), F.col("s_suppkey").alias("error"))
        return own.crossJoin(F.broadcast(self.projects)).distinct()

    @cached_property
    def issue_fixes(self) -> DataFrame:
        """project, issue, fix: known issues with an even key are resolved."""
        return self.issue_errors.where("issue % 2 = 0").select("project", "issue", (F.col("issue") % 5).alias("fix")).distinct()

    @cached_property
    def flags(self) -> DataFrame:
        """project, ticket_id, path"""
        own = self.lines.where("l_quantity >= 40").join(self.parts, F.col("l_partkey") == F.col("part"))
        return own.select("project", "ticket_id", "path").distinct()

    @cached_property
    def touches(self) -> DataFrame:
        """project, sha, committed (a month's first day), path: distinct before texts are made, as a path names its part"""
        month = F.trunc(F.col("l_shipdate").cast("date"), "month")
        own = self.lines.select("project", F.when(month.isNotNull(), F.col("l_suppkey")).alias("by"), month.alias("committed"), F.col("l_partkey").alias("part")).distinct()
        sha = F.concat(F.lit("c"), F.col("by").cast("string"), F.lit("-"), F.date_format("committed", "yyyyMM"))
        return own.join(self.parts.select("part", "path").distinct(), "part").select("project", sha.alias("sha"), "committed", "path")

    @cached_property
    def snapshots(self) -> DataFrame:
        """manifest, captured (month), package, version: the versions a manifest pins in a month."""
        month = F.trunc(F.col("l_shipdate").cast("date"), "month")
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("manifest"), month.alias("captured"), F.col("l_partkey").alias("package")).agg(F.max("l_quantity").cast("long").alias("version"))

    @cached_property
    def mentions(self) -> DataFrame:
        """project, ticket_id, said: sentences of tickets that name a file"""
        own = self.lines.where("l_tax >= 0.07 and l_quantity >= 45").join(self.parts, F.col("l_partkey") == F.col("part"))
        return own.select("project", "ticket_id", F.concat(F.lit("It broke in "), "path", F.lit(" again")).alias("said")).distinct()

    @cached_property
    def module_anchors(self) -> DataFrame:
        """project, ticket_id, module"""
        own = self.lines.where("l_returnflag = 'N' and l_tax <= 0.01").join(self.parts, F.col("l_partkey") == F.col("part"))
        return own.select("project", "ticket_id", "module").distinct()

    @cached_property
    def signatures(self) -> DataFrame:
        """project, ticket_id, errors, symptoms: what a ticket says went wrong, as arrays of texts"""
        name = F.concat_ws("_", word(F.col("error")), F.concat(F.lit("E"), F.col("error").cast("string")))
        errors = self.ticket_errors.groupBy("project", "ticket_id").agg(F.collect_set(name).alias("errors"))
        symptoms = F.array(F.concat(F.lit("slow "), word(F.col("ticket_id")))).alias("symptoms")
        none = F.array().cast("array<string>")
        return self.tickets.join(errors, ["project", "ticket_id"], "left").select("project", "ticket_id", F.coalesce("errors", none).alias("errors"), symptoms)

    @cached_property
    def elements(self) -> DataFrame:
        """module, feature, elements: names that a module's registry entry lists"""
        number = F.regexp_extract("feature", "([0-9]+)$", 1).cast("int") + F.length("module")
        names = F.array(F.concat(word(number), F.lit("Panel")), F.concat(word(number + 5), F.lit("_view"))).alias("elements")
        return self.parts.select("module", "feature").distinct().select("module", "feature", names)

    @staticmethod
    def described(touches: DataFrame) -> DataFrame:
        """Touches with the commit's message and the definitions that they change."""
        author, month = F.regexp_extract("sha", "^c([0-9]+)-", 1).cast("long"), F.substring("sha", -2, 2).cast("int")
        message = F.concat(F.lit("Rework "), word(author + month), F.lit(" handling"))
        defs = F.array(F.concat(F.lit("load_"), word(author + F.length("path"))), F.lit("saveItem"))
        return touches.select("*", message.alias("message"), defs.alias("defs"))

    @cached_property
    def uses(self) -> DataFrame:
        """path, package: every tenth part's file uses the package of its number"""
        return self.parts.where("part % 10 = 0").select("path", F.col("part").alias("package"))

    @cached_property
    def executions(self) -> DataFrame:
        """run (user and day), event_id, occurred, event_type, error (key of the props)"""
        error = F.get_json_object("props", "$.k").cast("long")
        run = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))
        return self.table("events").select(run.alias("run"), "event_id", F.col("ts").alias("occurred"), "event_type", error.alias("error"), "user_id", "value")


#: The same frames for DuckDB, written on their own.
SQL = """
WITH ticket AS (
  SELECT r_name AS project, c_mktsegment AS source_system, o_orderkey AS ticket_id,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'deleted' END AS status,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'bug' WHEN o_orderpriority = '3-MEDIUM' THEN 'feature_request' END AS kind,
    CAST(o_orderdate AS DATE) AS created_on
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cat AS (
  SELECT p_partkey AS part, p_brand AS feature, p_brand || '-' || p_type AS module, p_size <= 25 AS is_primary,
    CASE WHEN p_size % 5 = 0 THEN 'tests/test_' || p_partkey || '.py' WHEN p_size % 7 = 0 THEN 'docs/' || p_partkey || '.md'
      ELSE 'src/' || p_type || '/' || p_partkey || '.py' END AS path,
    CASE WHEN p_size % 5 = 0 THEN 'test' WHEN p_size % 7 = 0 THEN 'doc' ELSE 'source' END AS role
  FROM part),
file AS (SELECT r_name AS project, cat.* FROM cat, region),
line AS (SELECT t.project, t.status, t.created_on, t.ticket_id, l.* FROM lineitem l JOIN ticket t ON l.l_orderkey = t.ticket_id),
affects AS (SELECT DISTINCT project, ticket_id, feature FROM line JOIN cat ON l_partkey = part WHERE l_returnflag = 'R'),
ticket_error AS (SELECT DISTINCT project, ticket_id, l_suppkey AS error FROM line WHERE l_linestatus = 'F'),
issue_error AS (SELECT DISTINCT r_name AS project, CAST(s_nationkey AS BIGINT) AS issue, s_suppkey AS error FROM supplier, region WHERE s_suppkey % 3 = 0),
issue_fix AS (SELECT DISTINCT project, issue, issue % 5 AS fix FROM issue_error WHERE issue % 2 = 0),
flags AS (SELECT DISTINCT project, ticket_id, path FROM line JOIN cat ON l_partkey = part WHERE l_quantity >= 40),
touches AS (
  SELECT DISTINCT project, 'c' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m') AS sha, CAST(date_trunc('month', l_shipdate) AS DATE) AS committed, path
  FROM line JOIN cat ON l_partkey = part),
snapshot AS (
  SELECT l_suppkey AS manifest, CAST(date_trunc('month', l_shipdate) AS DATE) AS captured, l_partkey AS package, CAST(max(l_quantity) AS BIGINT) AS version
  FROM lineitem GROUP BY ALL),
execution AS (
  SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS run, event_id, ts AS occurred, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS error, user_id, value
  FROM events)
"""

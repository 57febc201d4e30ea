"""Traversals over typed edges, the store's write semantics, and exploration of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.sources.domain import Domain

KEY = ["project", "ticket_id"]


def latest(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last writer wins: each key's last record of an append-only log."""
    names = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*")


def replaced(edges: DataFrame, new: DataFrame, source: list[str]) -> DataFrame:
    """Edges of every source that ``new`` names are replaced by those of ``new``; its others stay."""
    return edges.join(new.select(*source).distinct(), source, "left_anti").unionByName(new.distinct())


def existing(edges: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    return edges.join(vertices.select(*keys).distinct(), keys, "left_semi")


def dangling(edges: DataFrame, vertices: DataFrame, keys: list[str]) -> DataFrame:
    return edges.join(vertices.select(*keys).distinct(), keys, "left_anti")


def feature_files(d: Domain) -> DataFrame:
    return d.files.where("role <> 'test'").select("project", "feature", "module", "path").distinct()


def feature_tests(d: Domain) -> DataFrame:
    return d.files.where("role = 'test'").select("project", "feature", "path").distinct()


def module_fallback_tests(d: Domain) -> DataFrame:
    """Modules without a primary source file get their feature's test files."""
    plain = d.files.where("role = 'source' and is_primary").select("project", "module").distinct()
    bare = d.files.select("project", "module", "feature").distinct().join(plain, ["project", "module"], "left_anti")
    return bare.join(feature_tests(d), ["project", "feature"], "left").select("project", "module", "feature", "path").distinct()


def error_known_issues(d: Domain) -> DataFrame:
    return d.ticket_errors.join(d.issue_errors, ["project", "error"]).select(*KEY, "error", "issue")


def known_issue_fixes(d: Domain) -> DataFrame:
    return error_known_issues(d).join(d.issue_fixes, ["project", "issue"]).select(*KEY, "issue", "fix").distinct()


def similarity_matches(d: Domain) -> DataFrame:
    """(project, ticket_id, issue, similarity, review): known issues that a ticket resembles, of matches not rejected."""
    issues = d.table("supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("issue"))
    review = F.when(F.col("l_returnflag") == "R", "confirmed").otherwise("candidate")
    return d.lines.where("l_discount >= 0.05 and l_returnflag in ('R', 'N')").join(issues, "l_suppkey").select(*KEY, "issue", F.col("l_discount").alias("similarity"), review.alias("review"))


def rank_known_issues(d: Domain, cap: int = 10) -> DataFrame:
    """One point for each error that leads to an issue, two for a confirmed likeness and one for a candidate."""
    similar = similarity_matches(d).select(*KEY, "issue", F.when(F.col("review") == "confirmed", 2).otherwise(1).alias("weight"))
    paths = error_known_issues(d).select(*KEY, "issue", F.lit(1).alias("weight")).unionByName(similar)
    counted = paths.groupBy(*KEY, "issue").agg(F.sum("weight").alias("match_count"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("match_count"), "issue")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def rank_fixes(d: Domain, cap: int = 10) -> DataFrame:
    """One count for each path over an error and a known issue."""
    counted = error_known_issues(d).join(d.issue_fixes, ["project", "issue"]).groupBy(*KEY, "fix").agg(F.count("*").alias("match_count"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("match_count"), "fix")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def recent_commits(d: Domain, cap: int = 10, flags: DataFrame | None = None) -> DataFrame:
    """A ticket's latest commits among those that touch the files it flags.

    A ticket's ``cap`` latest are among the ``cap`` latest of each of its files, so only these meet the tickets.
    """
    late = Window.partitionBy("project", "path").orderBy(F.desc("committed"), "sha")
    touches = d.touches.withColumn("late", F.row_number().over(late)).where(F.col("late") <= cap)
    near = (d.flags if flags is None else flags).join(touches, ["project", "path"]).select(*KEY, "sha", "committed")
    near = near.repartition(*KEY).distinct()  # once for this and the order
    order = Window.partitionBy(*KEY).orderBy(F.desc("committed"), "sha")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def neighbours(d: Domain) -> DataFrame:
    """All edges of tickets as (project, ticket_id, etype, other), untyped at the far end."""
    parts = [
        d.affects.select(*KEY, F.lit("AFFECTS").alias("etype"), F.col("feature").alias("other")),
        d.ticket_errors.select(*KEY, F.lit("HAS_ERROR").alias("etype"), F.col("error").cast("string").alias("other")),
        d.flags.select(*KEY, F.lit("FLAGS").alias("etype"), F.col("path").alias("other")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def degrees(d: Domain) -> DataFrame:
    """Out-degree of tickets and in-degree of what they point at, by edge type."""
    e = neighbours(d)
    out = e.groupBy("project", F.col("ticket_id").cast("string").alias("node"), "etype").agg(F.count("*").alias("n")).withColumn("direction", F.lit("out"))
    into = e.groupBy("project", F.col("other").alias("node"), "etype").agg(F.count("*").alias("n")).withColumn("direction", F.lit("in"))
    return out.unionByName(into)


def status_counts(d: Domain) -> DataFrame:
    kinds = [
        d.tickets.select(F.lit("customer-issue").alias("node_type")),
        d.files.select("project", "feature").distinct().select(F.lit("feature").alias("node_type")),
        d.files.select("project", "module").distinct().select(F.lit("module").alias("node_type")),
        d.files.select("project", "path", "role").distinct().select(F.when(F.col("role") == "test", "test-file").otherwise("file").alias("node_type")),
        d.issue_errors.select("project", "issue").distinct().select(F.lit("known-issue").alias("node_type")),
        d.touches.select("project", "sha").distinct().select(F.lit("commit").alias("node_type")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.groupBy("node_type").agg(F.count("*").alias("n"))


def recall_module(d: Domain) -> DataFrame:
    """Per module: its features, files and test files, as sorted lists."""
    return d.files.groupBy("project", "module").agg(
        F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") != "test", F.col("path")))), ",").alias("files"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") == "test", F.col("path")))), ",").alias("tests"),
    )


def search(d: Domain, wanted: str) -> DataFrame:
    """Vertices of any type whose name holds the wanted text, whatever its case."""
    nodes = d.files.select("project", F.lit("file").alias("node_type"), F.col("path").alias("name")).unionByName(d.files.select("project", F.lit("module").alias("node_type"), F.col("module").alias("name")))
    nodes = nodes.unionByName(d.touches.select("project", F.lit("commit").alias("node_type"), F.col("sha").alias("name")))
    return nodes.where(F.lower("name").contains(wanted.lower())).distinct()


def diagnose(d: Domain, cap: int = 5) -> DataFrame:
    """Per feature: known issues met by its tickets' errors, ranked by the number of paths."""
    paths = d.affects.join(error_known_issues(d), KEY).groupBy("project", "feature", "issue").agg(F.count("*").alias("paths"))
    order = Window.partitionBy("project", "feature").orderBy(F.desc("paths"), "issue")
    return paths.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def ambiguous_tokens(d: Domain) -> DataFrame:
    """Tokens that more than one module uses, with their number."""
    named = d.parts.select("module").distinct().select("module", F.explode(text.tokenize(F.col("module"))).alias("token"))
    return named.groupBy("token").agg(F.countDistinct("module").alias("modules")).where("modules > 1")


def recall_feature(d: Domain) -> DataFrame:
    """Everything that one edge of any type joins to a feature."""
    kind = F.when(F.col("role") == "test", "test-file").otherwise("file")
    near = F.array(F.struct(F.lit("module").alias("node_type"), F.col("module").alias("name")), F.struct(kind.alias("node_type"), F.col("path").alias("name")))
    own = d.files.select("project", "feature", F.inline(near)).distinct()
    return own.unionByName(d.affects.select("project", "feature", F.lit("customer-issue").alias("node_type"), F.col("ticket_id").cast("string").alias("name")))


def registry_list(d: Domain) -> DataFrame:
    """Features with the numbers of their modules, files and test files."""
    test = F.col("role") == "test"
    return d.files.groupBy("project", "feature").agg(F.countDistinct("module").alias("modules"), F.count_if(~test).alias("files"), F.count_if(test).alias("tests"))


def fix_commits(d: Domain) -> DataFrame:
    """Each fix with the short name of the first commit that implements it, if there is one."""
    own = d.touches.select("project", (F.regexp_extract("sha", r"^c([0-9]+)-", 1).cast("long") % 5).alias("fix"), "committed", "sha")
    first = own.groupBy("project", "fix").agg(F.substring(F.min_by("sha", F.struct("committed", "sha")), 1, 7).alias("commit"))
    return d.issue_fixes.select("project", "fix").distinct().join(first, ["project", "fix"], "left")


def similar_issues(d: Domain, cap: int = 10) -> DataFrame:
    """Known issues that a ticket's similarity matches lead to; the most alike come first."""
    counted = similarity_matches(d).groupBy(*KEY, "issue").agg(F.count("*").alias("matches"), F.max("similarity").alias("similarity"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("similarity"), F.desc("matches"), "issue")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)

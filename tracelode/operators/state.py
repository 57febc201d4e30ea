"""Reads and writes of the store, traversals chosen by the caller, linkers of tickets, and escalations as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.operators import graph, patterns
from tracelode.sources.domain import Domain

KEY = ["project", "ticket_id"]
OUT, IN, BOTH = "out", "in", "both"


def node(vertices: DataFrame, **key: object) -> DataFrame:
    """The vertex of a key; none where there is none of this type."""
    for name, value in key.items():
        vertices = vertices.where(F.col(name) == F.lit(value))
    return vertices


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with those of ``new``; an edge that is there already is one."""
    return edges.unionByName(new.select(*edges.columns)).distinct()


def edges(d: Domain) -> DataFrame:
    """All edges as (project, source, etype, target), each vertex named by its type and key."""
    named = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    parts = [
        d.affects.select("project", named("ticket", "ticket_id").alias("source"), F.lit("AFFECTS").alias("etype"), named("feature", "feature").alias("target")),
        d.ticket_errors.select("project", named("ticket", "ticket_id").alias("source"), F.lit("HAS_ERROR").alias("etype"), named("error", "error").alias("target")),
        d.issue_errors.select("project", named("issue", "issue").alias("source"), F.lit("HAS_ERROR").alias("etype"), named("error", "error").alias("target")),
        d.issue_fixes.select("project", named("issue", "issue").alias("source"), F.lit("RESOLVED_BY").alias("etype"), named("fix", "fix").alias("target")),
        d.files.select("project", named("module", "module").alias("source"), F.lit("PART_OF").alias("etype"), named("feature", "feature").alias("target")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traverse(start: DataFrame, all_edges: DataFrame, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """(project, start, node): where steps of (edge type, out, in or both) lead from each start (project, node)."""
    at = start.select("project", F.col("node").alias("start"), "node")
    for etype, direction in steps:
        own = all_edges.where(F.col("etype") == etype)
        forward = own.select("project", F.col("source").alias("node"), F.col("target").alias("next"))
        back = own.select("project", F.col("target").alias("node"), F.col("source").alias("next"))
        hop = {OUT: forward, IN: back, BOTH: forward.unionByName(back)}[direction]
        at = at.join(hop, ["project", "node"]).select("project", "start", F.col("next").alias("node")).distinct()
    return at


def fixes_by_traversal(d: Domain) -> DataFrame:
    """From each known issue over its errors to all issues that share one, and on to their fixes."""
    start = d.issue_errors.select("project", F.concat(F.lit("issue:"), F.col("issue").cast("string")).alias("node")).distinct()
    # A ticket has errors too: only issues have fixes, so the last step leaves tickets behind.
    return traverse(start, edges(d), [("HAS_ERROR", OUT), ("HAS_ERROR", IN), ("RESOLVED_BY", OUT)])


def modules_near_features(d: Domain) -> DataFrame:
    """Both directions of one edge type twice: the modules that share a feature with a module, itself among them."""
    start = d.files.select("project", F.concat(F.lit("module:"), F.col("module")).alias("node")).distinct()
    return traverse(start, edges(d), [("PART_OF", BOTH), ("PART_OF", BOTH)])


def asked(d: Domain, sql: str, **values: object) -> DataFrame:
    """An ad-hoc query over the domain's frames, named as in braces, with parameters as in :name."""
    frames = {"ticket": d.tickets, "affects": d.affects, "ticket_error": d.ticket_errors, "file": d.files, "flags": d.flags}
    return d.spark.sql(sql, args=values, **{k: v for k, v in frames.items() if "{" + k + "}" in sql})


def module_files(d: Domain) -> DataFrame:
    """Modules without a primary source file, with all their files; a module without any has none."""
    primary = d.files.where("role = 'source' and is_primary").select("project", "module").distinct()
    bare = d.files.select("project", "module").distinct().join(primary, ["project", "module"], "left_anti")
    return bare.join(d.files.where("role <> 'test'").select("project", "module", "path"), ["project", "module"], "left")


def commit_files(d: Domain, cap: int = 10) -> DataFrame:
    """A ticket's latest commits with the files that they touch, in order, and the day."""
    files = d.touches.groupBy("project", "sha").agg(F.array_join(F.array_sort(F.collect_set("path")), ",").alias("files"), F.min("committed").alias("committed"))
    return graph.recent_commits(d, cap).select(*KEY, "sha", "rank").join(files, ["project", "sha"])


def touching_commits(d: Domain) -> DataFrame:
    """Files with how many commits touch them, by the kind that their path says; files without any have none."""
    kind = F.when(F.col("role") == "test", "test-file").otherwise("file")
    own = d.files.select("project", "path", kind.alias("node_type")).distinct()
    return own.join(d.touches.select("project", "path", "sha"), ["project", "path"], "left").groupBy("project", "path", "node_type").agg(F.count("sha").alias("commits"))


def feature_links(texts: DataFrame, features: DataFrame) -> DataFrame:
    """(id, slug): features whose slug or name shares a token with a text that no other feature has.

    ``texts``: (id, text); ``features``: (slug, name). Only distinguishing tokens meet the texts' tokens.
    """
    own = features.select("slug", F.explode(F.array_union(text.tokenize(F.col("slug")), text.tokenize(F.col("name")))).alias("token")).distinct()
    telling = own.groupBy("token").agg(F.min("slug").alias("slug"), F.max("slug").alias("other")).where("slug = other").select("token", "slug")
    said = texts.select("id", F.explode(text.text_tokens(F.coalesce("text", F.lit("")))).alias("token"))
    return said.join(telling, "token").select("id", "slug").distinct()


def linked_documents(d: Domain) -> DataFrame:
    """Documents as tickets, and features named by the longest word of each benchmark text and its first."""
    words = F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) > 2)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    features = d.table("benchmark").where("text is not null").select(F.concat_ws("-", F.lit("item"), F.col("item_id").cast("string"), longest).alias("slug"), F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("name"))
    found = feature_links(d.table("documents").select(F.col("doc_id").alias("id"), "text"), features)
    return found.select(F.col("id").alias("doc_id"), "slug")


#: Fields that may name an error, the first that does counts.
FIELDS = ("title", "body", "explicit_error_text", "failure_type", "message", "assertion_text", "stack_trace", "stderr")


def field_matches(records: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term, source_field, fragment): for each record and registered term the first field that holds it as a whole.

    ``records``: id and any of FIELDS; ``terms``: (term), whose keys are its first words, so not every pair is tried.
    """
    there = [f for f in FIELDS if f in records.columns]
    own = records.select("id", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("said")) for f in there])).alias("nth", "f"))
    own = own.select("id", "nth", "f.field", "f.said").where("said is not null and said <> ''")
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    keyed = terms.where("term <> ''").select("term", F.get(words(F.col("term")), F.lit(0)).alias("word"))
    spots = own.withColumn("word", F.explode(F.array_distinct(words(F.col("said")))))
    near = spots.join(keyed, "word").select("id", "nth", "field", "said", "term").distinct()
    literal = F.concat(F.lit(r"(\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    quoted = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), literal, F.lit(r"(?![\p{L}\p{N}_])"))
    hit = near.where(F.rlike("said", quoted)).withColumn("fragment", F.regexp_substr("said", quoted))
    first = hit.groupBy("id", "term").agg(F.min_by(F.struct("field", "fragment"), "nth").alias("m"))
    return first.select("id", "term", F.col("m.field").alias("source_field"), F.col("m.fragment").alias("fragment"))


def matched_orders(d: Domain) -> DataFrame:
    """Orders as records with a title, a body and a message, and part types' words as registered errors."""
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("seen: Urgent_"), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("all "), F.lower("o_orderpriority"), F.lit(".")))
    message = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ERROR "), F.col("o_orderstatus"), F.lit(" URGENT low")))
    own = d.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("order "), F.col("o_orderstatus")).alias("title"), body.alias("body"), message.alias("message"))
    terms = d.spark.createDataFrame([(t,) for t in ("Urgent", "order f", "error o", "medium", "low", "")], "term string")
    return field_matches(own, terms).select(F.col("id").alias("o_orderkey"), "term", "source_field", "fragment")


def open_escalations(d: Domain) -> DataFrame:
    """Months of a feature that reached three tickets: the latest is open, and its issue's number is its sequence."""
    return patterns.escalation_sequence(d).where("is_open = 1")


def escalation_actions(found: DataFrame, state: DataFrame) -> DataFrame:
    """What a sweep does with each feature over the threshold: (project, feature, action, sequence, tickets, added).

    ``found``: project, feature, ticket_id of open tickets over the threshold; ``state``: project, feature, sequence,
    issue (null where the issue could not be made), is_closed, ticket_id (null without). Tickets of any issued escalation
    are linked already. With ``none`` left nothing happens; an escalation without issue is tried again; an open one is
    appended to; after a closed one the next in sequence is made, of three new tickets at least.
    """
    linked = state.where("issue is not null and ticket_id is not null").select("project", "feature", "ticket_id").distinct()
    fresh = found.join(linked, ["project", "feature", "ticket_id"], "left_anti").groupBy("project", "feature").agg(F.count("*").alias("added"))
    whole = found.groupBy("project", "feature").agg(F.count("*").alias("tickets"))
    last = state.groupBy("project", "feature").agg(F.max(F.struct("sequence", F.col("issue").isNotNull().alias("issued"), "is_closed")).alias("s"))
    both = whole.join(fresh, ["project", "feature"], "left").join(last, ["project", "feature"], "left").withColumn("added", F.coalesce("added", F.lit(0)))
    action = (
        F.when(F.col("s").isNull(), F.when(F.col("tickets") >= 3, "create").otherwise("none"))
        .when(~F.col("s.issued"), "retry")
        .when(F.col("added") == 0, "none")
        .when(~F.col("s.is_closed"), "append")
        .when(F.col("added") >= 3, "create")
        .otherwise("none")
    )
    sequence = F.coalesce(F.col("s.sequence"), F.lit(0)) + F.when(action == "create", 1).otherwise(0)
    return both.select("project", "feature", action.alias("action"), sequence.alias("sequence"), "tickets", "added")


def escalation_sweep(d: Domain) -> DataFrame:
    """Features with three open tickets against escalations issued for the tickets of 1995 and before."""
    near = d.affects.join(d.tickets.where("status = 'open'").select(*KEY, "created_on"), KEY)
    often = near.groupBy("project", "feature").agg(F.count("*").alias("n")).where("n >= 3")
    found = near.join(often, ["project", "feature"], "left_semi").select("project", "feature", "ticket_id")
    number = F.regexp_extract("feature", r"([0-9]+)$", 1).cast("int")
    old = near.where("created_on < date'1996-01-01'").withColumn("number", number)
    state = old.select("project", "feature", "ticket_id", F.lit(1).alias("sequence"), F.when(F.col("number") % 3 != 0, F.col("number")).alias("issue"), (F.col("number") % 2 == 0).alias("is_closed"))
    return escalation_actions(found, state)


def new_investigations(d: Domain) -> DataFrame:
    """Actionable matches as investigations, each made once by its composite id; those of fix 0 are there already."""
    named = graph.known_issue_fixes(d).select("project", F.concat_ws("--", F.col("ticket_id").cast("string"), F.concat(F.lit("ki-"), F.col("issue").cast("string")), F.concat(F.lit("fix-"), F.col("fix").cast("string")), F.lit("actionable")).alias("investigation"), "fix")
    there = named.where("fix = 0").select("project", "investigation")
    return named.select("project", "investigation").distinct().join(there, ["project", "investigation"], "left_anti")


#: What the checks of proposed metadata know.
DOC_TYPES = ("hld", "lld", "spec", "testing", "runbook", "known-issue", "release-notes")
LISTS = ("modules", "source_files", "test_files", "error_signatures", "tags")
FILLERS = ("the document is about", "this document describes", "based on the document", "the file mentions")


def proposal_verdict(features: Column, modules: Column, errors: Column) -> Column:
    """The first check that a proposed field fails, or "valid".

    On columns field, value (array; null for none), is_list, evidence, missing and existing (arrays of field names); the
    arguments are arrays of registered slugs. The evidence is judged first, for the whole proposal.
    """
    said = F.coalesce(F.col("evidence"), F.lit(""))
    filler = F.lit(False)
    for f in FILLERS:
        filler = filler | F.lower(F.trim(said)).startswith(f)
    one = F.get("value", F.lit(0))
    empty = F.col("value").isNull() | (F.size("value") == 0) | (~F.col("is_list") & (F.coalesce(one, F.lit("")) == ""))
    is_listed = F.col("field").isin(*LISTS)
    return (
        F.when((F.length(said) < 15), "evidence_too_short")
        .when(filler, "evidence_is_filler")
        .when(~F.array_contains("missing", F.col("field")), "not_requested")
        .when(F.array_contains("existing", F.col("field")), "would_overwrite")
        .when(empty, "empty")
        .when((F.col("field") == "doc_type") & ~one.isin(*DOC_TYPES), "unknown_value")
        .when(F.col("field").isin("feature_slug", "feature") & ~F.array_contains(features, one), "unknown_slug")
        .when(is_listed & ~F.col("is_list"), "not_a_list")
        .when(is_listed & (F.size(F.array_distinct("value")) < F.size("value")), "duplicates")
        .when((F.col("field") == "modules") & (F.size(F.array_except("value", modules)) > 0), "unknown_modules")
        .when((F.col("field") == "error_signatures") & (F.size(F.array_except("value", errors)) > 0), "unknown_errors")
        .otherwise("valid")
    )


#: Worked proposals: (field, value by bars, whether a list, evidence, missing, existing).
PROPOSALS = (
    ("feature", "video", False, "quoted from the body", "feature", ""), ("feature", "none", False, "quoted from the body", "feature", ""), ("feature", "video", False, "too short", "feature", ""),
    ("feature", "video", False, "This document describes all", "feature", ""), ("feature", "video", False, "quoted from the body", "modules", ""), ("feature", "video", False, "quoted from the body", "feature", "feature"),
    ("doc_type", "lld", False, "quoted from the body", "doc_type", ""), ("doc_type", "novel", False, "quoted from the body", "doc_type", ""), ("tags", "a", False, "quoted from the body", "tags", ""),
    ("tags", "a|a", True, "quoted from the body", "tags", ""), ("tags", "", True, "quoted from the body", "tags", ""), ("modules", "core|ui", True, "quoted from the body", "modules", ""),
    ("modules", "core|x", True, "quoted from the body", "modules", ""), ("error_signatures", "boom", True, "quoted from the body", "error_signatures", ""), ("error_signatures", "bang", True, "quoted from the body", "error_signatures", ""),
    ("title", "", False, "quoted from the body", "title", ""), ("title", "any", False, "quoted from the body", "title", ""),
)


def verified_fields(d: Domain) -> DataFrame:
    """Parts as proposals of the worked ones in turn, with their verdicts."""
    bars = lambda c: F.filter(F.split(c, r"\|"), lambda w: w != "")
    rows = [(k, *p) for k, p in enumerate(PROPOSALS)]
    worked = d.spark.createDataFrame(rows, "k int, field string, said string, is_list boolean, evidence string, m string, e string")
    own = d.table("part").select("p_partkey", F.pmod("p_partkey", F.lit(len(PROPOSALS))).cast("int").alias("k")).join(F.broadcast(worked), "k")
    own = own.select("p_partkey", "field", bars(F.col("said")).alias("value"), "is_list", "evidence", bars(F.col("m")).alias("missing"), bars(F.col("e")).alias("existing"))
    slugs = lambda *x: F.array(*map(F.lit, x))
    return own.select("p_partkey", proposal_verdict(slugs("video", "audio"), slugs("core", "ui"), slugs("boom")).alias("verdict"))


def slug_registry(names: DataFrame) -> DataFrame:
    """(slug, name) of (nth, name): names of a slug that are equal but for case and ends are one, the longest; the last
    of those that differ from the slug's first takes the slug with -2."""
    own = names.select("nth", "name", text.slugify(F.col("name")).alias("s"), F.lower(F.trim("name")).alias("norm"))
    own = own.withColumn("slug", F.when(F.col("s") == "", "unnamed").otherwise(F.col("s")))
    first = own.groupBy("slug").agg(F.min_by("norm", "nth").alias("first"))
    both = own.join(first, "slug")
    same = both.where("norm = first").groupBy("slug").agg(F.max_by("name", F.struct(F.length("name"), -F.col("nth"))).alias("name"))
    other = both.where("norm <> first").groupBy(F.concat("slug", F.lit("-2")).alias("slug")).agg(F.max_by("name", "nth").alias("name"))
    return same.unionByName(other)


def part_registry(d: Domain) -> DataFrame:
    """Part types, written in four ways by the part's number, as names of features."""
    shape = F.col("p_partkey") % 4
    name = F.when(shape == 0, F.col("p_type")).when(shape == 1, F.concat(F.lower("p_type"), F.lit("  "))).when(shape == 2, F.concat(F.col("p_type"), F.lit("!"))).otherwise(F.upper("p_type"))
    return slug_registry(d.table("part").select(F.col("p_partkey").alias("nth"), name.alias("name")))

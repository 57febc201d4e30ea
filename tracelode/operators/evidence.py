"""Evidence for candidate files of tickets, its scores, and the ranked candidates."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import rules, text
from tracelode.operators import blocks, graph
from tracelode.sources.domain import Domain
from tracelode.sources.work import folder, kept, removed

KEY = ["project", "ticket_id"]
#: What a piece of evidence is worth by type.
WORTH = {
    "feature_primary_file": 9.0, "feature_anchor": 3.0, "ticket_mention": 10.0, "element_anchor_match": 6.0, "recent_commit": 1.5,
    "commit_message_match": 9.0, "function_anchor_match": 6.0, "dependency_change": 5.0, "recent_test_failure": 9.0,
}
WEAK = ("recent_commit", "feature_anchor")


def feature_score(is_primary: Column) -> Column:
    return F.when(is_primary, WORTH["feature_primary_file"]).otherwise(WORTH["feature_anchor"])


def typed_feature_evidence(near: DataFrame) -> DataFrame:
    kind = F.when(F.col("is_primary"), "feature_primary_file").otherwise("feature_anchor")
    return near.select(*KEY, "path", "role", kind.alias("type"), feature_score(F.col("is_primary")).alias("score"), F.col("feature").alias("why"))


def feature_evidence(d: Domain) -> DataFrame:
    """All files of a ticket's features; a primary file counts more."""
    return typed_feature_evidence(d.affects.join(d.files.select("project", "feature", "path", "role", "is_primary"), ["project", "feature"]))


def commit_evidence(d: Domain, cap: int = 10, flags: DataFrame | None = None) -> DataFrame:
    """Each touch of a file by one of the ticket's latest commits; ``flags`` narrows the tickets."""
    recent = graph.recent_commits(d, cap, flags).select(*KEY, "sha")
    roles = d.files.select("project", "path", "role").distinct()
    near = recent.join(d.touches.select("project", "sha", "path"), ["project", "sha"]).join(roles, ["project", "path"])
    return near.select(*KEY, "path", "role", F.lit("recent_commit").alias("type"), F.lit(WORTH["recent_commit"]).alias("score"), F.col("sha").alias("why"))


def by_type(evidence: DataFrame) -> DataFrame:
    """Points of each type of a candidate's evidence: each further piece, from the highest, counts half of the one before."""
    order = Window.partitionBy(*KEY, "path", "role", "type").orderBy(F.desc("score"))
    ranked = evidence.withColumn("nth", F.row_number().over(order))
    gain, loss = F.col("score") >= 0, F.when(F.col("score") < 0, F.col("score")).otherwise(0.0)
    decayed = F.when(gain, F.col("score") * F.pow(F.lit(0.5), (F.col("nth") - 1).cast("double"))).otherwise(0.0)
    return ranked.groupBy(*KEY, "path", "role", "type").agg(F.sum(decayed).alias("points"), F.sum(loss).alias("loss"), F.max(gain.cast("int")).alias("counts"), F.count("*").alias("pieces"))


def scored(evidence: DataFrame) -> DataFrame:
    return scored_types(by_type(evidence))


def scored_types(typed: DataFrame) -> DataFrame:
    """Per candidate: several types of evidence, of which one isn't weak, earn three points for each type beyond the
    first, up to four; negative pieces are taken off. ``raw`` are these points to one decimal. A file that can't hold a
    bug loses three quarters of them, which is a negative piece of its own, and is scored again."""
    strong = F.max(F.when(F.col("counts") == 1, (~F.col("type").isin(*WEAK)).cast("int")).otherwise(0)) == 1
    bonus = F.when(strong, 3.0 * F.greatest(F.lit(0), F.least(F.sum("counts") - 1, F.lit(4)))).otherwise(0.0)
    total = typed.groupBy(*KEY, "path", "role").agg((F.sum("points") + bonus + F.sum("loss")).alias("total"), F.count("*").alias("types"))
    return of_total(total)


def of_total(total: DataFrame, share: Column | None = None) -> DataFrame:
    """``raw`` and ``score`` in place of ``total``; ``share`` is the path's actionability where that was found before."""
    total = total.withColumn("raw", rules.points(F.col("total")))
    share = rules.actionability(F.col("path")) if share is None else share
    penalty = F.when(share < 1, rules.points(F.col("raw") * (share - 1))).otherwise(0.0)
    return total.withColumn("score", rules.points(F.col("total") + penalty)).drop("total")


def of_each_total(total: DataFrame) -> DataFrame:
    """``raw`` and ``score`` in place of ``total`` and ``share``. Few of these differ, and rounding takes long, so each is rounded once."""
    each = total.select("total", "share").distinct().withColumn("of", F.col("total"))
    return total.withColumnRenamed("total", "of").join(F.broadcast(of_total(each, F.col("share"))), ["of", "share"]).drop("of", "share")


def candidates(evidence: DataFrame, cap: int = 20) -> DataFrame:
    """The best candidates of each ticket and kind, with their confidence."""
    order = Window.partitionBy(*KEY, F.col("role") == "test").orderBy(F.desc("score"), "path")
    best = scored(evidence).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    return best.select(*KEY, "path", "role", "score", text.confidence(F.col("score")).alias("confidence"), "types", "rank")


def debug_candidates(d: Domain, cap: int = 20) -> DataFrame:
    """For every open ticket, the files to look at first.

    A file without commit evidence is worth its feature evidence alone, so of these only the ``cap`` best of each
    feature and kind can be among a ticket's best. They are found once for each feature; files with commit
    evidence join beside them. The pairs of tickets and files so stay in proportion to the tickets.
    """
    open_ones = d.tickets.where("status = 'open'").select(*KEY)
    affects = d.affects.join(open_ones, KEY, "left_semi")
    commits = commit_evidence(d, flags=d.flags.join(open_ones, KEY, "left_semi"))
    files = d.files.select("project", "feature", "path", "role", "is_primary").withColumn("base", feature_score(F.col("is_primary")))
    worth = F.col("base") * rules.actionability(F.col("path"))
    order = Window.partitionBy("project", "feature", F.col("role") == "test").orderBy(worth.desc(), "path")
    top = files.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)
    alone = affects.join(top, ["project", "feature"]).select(*KEY, "path", "role", "is_primary", "feature")
    touched = commits.select(*KEY, "path").distinct().join(files, ["project", "path"]).join(affects, [*KEY, "feature"]).select(*KEY, "path", "role", "is_primary", "feature")
    features = typed_feature_evidence(alone.union(touched).distinct())
    return candidates(features.unionByName(commits), cap)


def held_once(files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files that one row has, and the rows of all others."""
    counted = files.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    return counted.where("n = 1").drop("n"), counted.where("n > 1").drop("n")


def without(affects: DataFrame, single: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs of tickets and their features' files, except those in ``own`` (KEY, feature, path). ``single`` has a file once."""
    own = own.groupBy(*KEY, "feature").agg(F.collect_set("path").alias("left_out"))
    tickets = kept(affects.join(own, [*KEY, "feature"], "left"))
    return blocks.pairs_but(tickets, single, ["project", "feature"], "left_out", "path")


def covered_tests(d: Domain) -> DataFrame:
    """Test files of a ticket's features that no commit evidence names, with the features that cover them.

    These are nearly all pairs of a feature's tickets and test files. They aren't shuffled; only test files of several
    features are grouped.
    """
    affects, tests = kept(d.affects), graph.feature_tests(d)
    of_file = kept(tests.groupBy("project", "path").agg(F.count("*").alias("n"), F.min("feature").alias("feature")).withColumn("file", F.monotonically_increasing_id()))
    named = commit_pieces(d, affects, of_file, 1)
    shared = held_once(tests, ["project", "path"])[1]
    several = affects.join(shared, ["project", "feature"]).join(named.where("n > 1"), [*KEY, "path"], "left_anti")
    several = several.groupBy(*KEY, "path").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("covering"))
    alone = without(affects, of_file.where("n = 1").drop("n", "file"), named.where("n = 1 and own").select(*KEY, "feature", "path"))
    return alone.select(*KEY, "path", F.col("feature").alias("covering")).unionByName(several)


def packets(d: Domain, cap: int = 5) -> DataFrame:
    """One nested document per open ticket, as JSON: anchors, known issues, fixes and best files."""
    files = debug_candidates(d).where(F.col("rank") <= cap)
    files = files.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "path", "confidence"))).alias("files"))
    features = d.affects.groupBy(*KEY).agg(F.array_sort(F.collect_set("feature")).alias("features"))
    issues = graph.rank_known_issues(d).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "issue", "match_count"))).alias("known_issues"))
    fixes = graph.rank_fixes(d).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "fix", "match_count"))).alias("prior_fixes"))
    whole = files.join(features, KEY, "left").join(issues, KEY, "left").join(fixes, KEY, "left")
    return whole.select(*KEY, F.to_json(F.struct("features", "files", "known_issues", "prior_fixes")).alias("packet"))


def quick_summary(d: Domain) -> DataFrame:
    features = d.affects.groupBy(*KEY).agg(F.array_join(F.array_sort(F.collect_set("feature")), ", ").alias("features"))
    errors = d.ticket_errors.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_set("error")), lambda e: e.cast("string")), ", ").alias("errors"))
    both = d.tickets.select(*KEY).join(features, KEY, "left").join(errors, KEY, "left")
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    return both.select(*KEY, F.concat_ws(" · ", part("Features", "features"), part("Errors", "errors")).alias("summary"))


#: Fixed: tickets' commit evidence for all files is found in so many parts, one after the other, so that scratch holds one part's shuffles.
PARTS = 4


def commit_pieces(d: Domain, affects: DataFrame, of_file: DataFrame, parts: int = PARTS) -> DataFrame:
    """KEY, ``pieces`` (how many rows of ``commit_evidence`` a ticket has for a file), the columns of ``of_file`` (project, path,
    feature, ``file`` (a number of its own for each row) and others), and ``own``: the feature is one of the ticket's in ``affects``.

    Touches of other files are left out, and the rest meet their file, before tickets multiply them, of which
    only numbers are shuffled. Frames that several plans
    use are written; each goes as soon as the last of these is done.
    """
    spark = affects.sparkSession
    at_flags, at_touches, at_recent, at_near, at_named = (folder(spark) for _ in range(5))
    touches, flags = kept(d.touches, at_touches), kept(d.flags, at_flags)
    recent = graph.recent_commits(SimpleNamespace(flags=flags, touches=touches)).select(*KEY, "sha")
    features = affects.groupBy(*KEY).agg(F.collect_set("feature").alias("features"))
    recent = kept(recent.join(features, KEY, "left"), at_recent)
    removed(spark, at_flags)
    near = kept(touches.select("project", "sha", "path").join(of_file.select("project", "path", "file", "feature"), ["project", "path"]).drop("path"), at_near)
    removed(spark, at_touches)
    own = F.coalesce(F.array_contains("features", F.col("feature")), F.lit(False)).alias("own")
    for part in range(parts):
        mine = F.pmod(F.xxhash64(*KEY), F.lit(parts)) == part
        pieces = recent.where(mine).join(near, ["project", "sha"]).groupBy(*KEY, "file", own).agg(F.count("*").alias("pieces"))
        named = kept(pieces.join(of_file.drop("project"), "file").drop("file"), at_named)
    removed(spark, at_recent, at_near)
    return named


def scored_touched(named: DataFrame) -> DataFrame:
    """Candidates with ``pieces`` of commit evidence and, where ``own`` is true, one of their feature, by the rules of ``scored``."""
    commits = 2 * WORTH["recent_commit"] * (1 - F.pow(F.lit(0.5), F.col("pieces").cast("double")))
    strong = F.lit("feature_primary_file" not in WEAK) & F.col("is_primary") | F.lit("feature_anchor" not in WEAK)
    feature = F.when(F.col("own"), feature_score(F.col("is_primary")) + F.when(strong, 3.0).otherwise(0.0)).otherwise(0.0)
    types = F.when(F.col("own"), 2).otherwise(1).cast("long")
    return of_each_total(named.select(*KEY, "path", "role", types.alias("types"), (commits + feature).alias("total"), "share"))


def all_scored(d: Domain, role: str | None = None) -> DataFrame:
    """All candidates, ranked or not, with their points; ``role`` narrows them.

    Nearly all are pairs of a feature's tickets and files without commit evidence. Their points are the file's, which are
    found once; the pairs aren't shuffled. Those with commit evidence are counted once and written; files of several rows
    are scored pair by pair.
    """
    files = d.files if role is None else d.files.where(F.col("role") == role)
    files, names = files.select("project", "feature", "path", "role", "is_primary"), ["path", "role"]
    affects, shared = kept(d.affects), held_once(files, ["project", *names])[1]
    of_file = files.groupBy("project", *names).agg(F.count("*").alias("n"), F.first("feature").alias("feature"), F.first("is_primary").alias("is_primary"))
    of_file = kept(of_file.withColumn("share", rules.actionability(F.col("path"))).withColumn("file", F.monotonically_increasing_id()))
    named = commit_pieces(d, affects, of_file, PARTS if role is None else 1)
    once, several = named.where("n = 1"), named.where("n > 1")
    commits = several.select(*KEY, "path", "role", F.lit("recent_commit").alias("type"), F.lit(WORTH["recent_commit"]).alias("score"), F.explode(F.array_repeat(F.lit(""), F.col("pieces").cast("int"))).alias("why"))
    general = scored(typed_feature_evidence(affects.join(shared, ["project", "feature"])).unionByName(commits))
    worth = of_file.where("n = 1").select("project", "feature", *names, F.lit(1).cast("long").alias("types"), feature_score(F.col("is_primary")).alias("total"), "share")
    alone = without(affects, kept(of_each_total(worth)), once.where("own").select(*KEY, "feature", "path")).drop("feature")
    return alone.unionByName(scored_touched(once)).unionByName(general)


def document_penalty(d: Domain) -> DataFrame:
    """Documents among the candidates with their points before and after the penalty."""
    return all_scored(d, "doc").select(*KEY, "path", "raw", "score")


def confidence_labels(d: Domain) -> DataFrame:
    return debug_candidates(d).groupBy("role", "confidence").agg(F.count("*").alias("n"))

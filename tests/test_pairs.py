"""Results of all pairs of tickets and files: equal to the plain joins, and their pairs aren't shuffled."""

from __future__ import annotations

import datetime
import re
import time
import uuid
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tracelode.operators import blocks, evidence, graph

TICKETS, FILES = 400, 300
KEY = evidence.KEY


@pytest.fixture(scope="module")
def few(spark):
    """One project, one feature with many tickets and files; a path of two features, one of two roles, one null."""
    day = datetime.date(2020, 1, 1)
    files = [("p", "f", "m", k, f"{'tests/test_' if role == 'test' else ''}{k}.{'md' if role == 'doc' else 'py'}", role, k % 2 == 0) for k in range(FILES) for role in (("source", "test", "doc")[k % 3],)]
    files += [("p", "g", "m", 9000 + k, path, role, True) for k, (path, role) in enumerate([("tests/test_1.py", "test"), ("2.md", "doc"), ("3.py", "source"), ("6.py", "doc"), (None, "doc")])]
    affects = [("p", t, "f") for t in range(TICKETS)] + [("p", t, "g") for t in (0, 1, 2, TICKETS)]
    touches = [("p", f"c{k}-202001", day, f[4]) for k in range(3) for f in files[k::7] if f[4]]
    flags = [("p", t, path) for t in range(0, TICKETS, 5) for path in ("tests/test_1.py", "2.md", "6.py")] + [("p", 7777, "3.py")]
    made = spark.createDataFrame
    return SimpleNamespace(
        files=made(files, "project string, feature string, module string, part long, path string, role string, is_primary boolean").localCheckpoint(),
        affects=made(affects, "project string, ticket_id long, feature string").localCheckpoint(),
        touches=made(touches, "project string, sha string, committed date, path string").localCheckpoint(),
        flags=made(flags, "project string, ticket_id long, path string").localCheckpoint(),
    )


def rows(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def most_shuffled(spark, frame):
    """Records that the stage with most of them writes for a shuffle, while all rows are counted."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    frame.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    return max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def plain_scores(d):
    return evidence.scored(evidence.feature_evidence(d).unionByName(evidence.commit_evidence(d)))


def test_pairs_are_the_join(spark):
    left = spark.createDataFrame([("a", n) for n in range(50)] + [("b", 1), ("b", 1), ("c", 2), (None, 3)], "k string, x int")
    right = spark.createDataFrame([("a", f"{n}") for n in range(30)] + [("b", "1"), ("b", None), ("d", "2"), (None, "3")], "k string, y string")
    assert rows(blocks.pairs(left, right, ["k"], side=7)) == rows(left.join(right, "k"))


def test_covered_tests(spark, few):
    named = evidence.commit_evidence(few).select(*KEY, "path").distinct()
    plain = few.affects.join(graph.feature_tests(few), ["project", "feature"]).join(named, [*KEY, "path"], "left_anti")
    plain = plain.groupBy(*KEY, "path").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("covering"))
    got = evidence.covered_tests(few)
    assert rows(got) == rows(plain) and any("f,g" in r for r in rows(got))
    assert most_shuffled(spark, got) < got.count() / 4


def test_score_decay(spark, few):
    from tracelode.plans import catalogue

    got, plain = catalogue.OPERATORS["score_decay"](few), plain_scores(few)
    assert rows(got.select(*plain.columns)) == rows(plain)
    assert most_shuffled(spark, got) < got.count() / 4


def test_kept_leaves_no_shuffle_files(spark):
    from tracelode.sources.work import kept

    def files():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return {p.name for p in Path(local).rglob("shuffle_*.data")}

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getParent()
    before = files()
    assert len(kept(spark.range(1000).repartition(3).groupBy("id").count()).collect()) == 1000
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left


def test_commit_tables_go(spark, few):
    """Commits are looked up part by part; the tables that only this needs go before the result is made, which stays whole."""
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    got = evidence.all_scored(few)
    tables = [spark.read.parquet(str(p)) for p in set(root.iterdir()) - before]
    assert not any("sha" in t.columns for t in tables) and sum("pieces" in t.columns for t in tables) == 1
    assert rows(got.select(*KEY, "path", "score")) == rows(plain_scores(few).select(*KEY, "path", "score"))


def test_touches_are_distinct(spark):
    """Of repeated lines, parts and nulls too."""
    from tracelode.sources.domain import Domain

    lines = [("p", day, by, part) for day in ("2020-01-05", "2020-01-20", None) for by in (1, 2, None) for part in (1, 2, 3)] * 2
    d = Domain(spark, "")
    d.lines = spark.createDataFrame(lines, "project string, l_shipdate string, l_suppkey long, l_partkey long")
    d.parts = spark.createDataFrame([(1, "a/1.py"), (1, "a/1.py"), (2, "b/2.py")], "part long, path string")
    one, month = [(f"c{by}-202001" if by else None) for by in (1, 2, None)], datetime.date(2020, 1, 1)
    want = [("p", sha, month, path) for sha in one for path in ("a/1.py", "b/2.py")] + [("p", None, None, path) for path in ("a/1.py", "b/2.py")]
    assert rows(d.touches) == sorted(map(repr, want))


def test_rows_are_dealt_to_few_blocks(spark):
    """A row is shuffled once for each block of the other side."""
    frame = spark.range(8000).selectExpr("'k' k", "id x")
    assert blocks.in_blocks(frame, ["k"], "left", 2048).count() == 4
    assert blocks.in_blocks(frame.where("x < 1600"), ["k"], "left", 2048).count() == 4
    sides = [frame, frame.select("k", F.col("x").alias("y"))]
    met = blocks.pairs(*sides, ["k"])
    assert most_shuffled(spark, met) <= 8000 and met.count() == 64_000_000


def test_pairs_are_not_held(spark):
    """Generated code would hold all pairs of two blocks in memory before the first is written."""
    sides = [spark.range(2000).selectExpr("'k' k", f"id {c}") for c in "xy"]
    plan = blocks.pairs(*sides, ["k"])._jdf.queryExecution()
    made = plan.toRdd().toDebugString() and plan.executedPlan().toString()
    assert made.count("Generate explode") >= 2 and not re.search(r"\*\s*\(\d+\) Generate", made)


def test_doc_penalty(spark, few):
    got, plain = evidence.document_penalty(few), plain_scores(few).where("role = 'doc'").select(*KEY, "path", "raw", "score")
    assert rows(got) == rows(plain) and any("None" in r for r in rows(got))
    assert most_shuffled(spark, got) < got.count() / 4


def test_elements_write_no_tables(spark, sf_dir, monkeypatch):
    from tracelode.operators import packet
    from tracelode.sources.domain import Domain

    def none(frame):
        raise AssertionError("a table was written")

    monkeypatch.setattr(packet, "kept", none)
    assert packet.element_evidence(Domain(spark, sf_dir)).count() > 0


def test_pairs_but_leaves_out(spark):
    """Nulls and repeats too; what is left out isn't carried in pairs, and left rows are taken one by one."""
    left = spark.createDataFrame([("a", n, ["1", "2"] if n % 3 else None) for n in range(40)] + [("b", 1, ["9"]), ("b", 1, ["9"]), ("c", 2, None), (None, 3, None)], "k string, x int, out array<string>")
    right = spark.createDataFrame([("a", f"{n}") for n in range(30)] + [("b", "9"), ("b", None), ("d", "2"), (None, "3")], "k string, y string")
    want = left.join(right, "k").where("not coalesce(array_contains(out, y), false)").select("k", "x", "y")
    got = blocks.pairs_but(left, right, ["k"], "out", "y", side=7)
    assert rows(got) == rows(want) and any("None" in r for r in rows(got))
    plan = got._jdf.queryExecution()
    made = plan.toRdd().toDebugString() and plan.executedPlan().toString().partition("Initial Plan")[0]
    assert len(re.findall(r"\*\s*\(\d+\) Generate explode", made)) == 1 and made.count("Generate explode") == 2
    assert not re.search(r"Filter NOT coalesce\(array_contains", made)


@pytest.mark.parametrize("query, role", [("covered_tests", "test"), ("doc_penalty", "doc")])
def test_only_own_touches_meet_tickets(spark, few, monkeypatch, query, role):
    """Touches of files that a query doesn't return are left out before tickets multiply them."""
    from tracelode.plans import catalogue

    written, keep = [], evidence.kept
    monkeypatch.setattr(evidence, "kept", lambda frame, *at: written.append((frame.columns, frame.collect())) or keep(frame, *at))
    catalogue.OPERATORS[query](few)
    own = {f["path"] for f in few.files.where(F.col("role") == role).collect()}
    near = [x for columns, x in written if "sha" in columns and "file" in columns]
    assert len(near) == 1 and len(near[0]) == few.touches.distinct().where(F.col("path").isin(*own - {None})).count() > 0
    assert all(x["path"] in own for columns, table in written if "pieces" in columns for x in table)


def test_like_totals_are_rounded_once(spark, monkeypatch):
    """Rounding a total takes longer than all else that is done with its row."""
    from tracelode.functions import rules

    named = spark.range(3000).selectExpr("'p' project", "id ticket_id", "'docs/1.md' path", "'doc' role", "1L n", "'f' feature", "true is_primary", "0.25D share", "id % 2 = 0 own", "1 + id % 3 pieces").localCheckpoint()
    want = rows(evidence.scored_touched(named).select("ticket_id", "types", "raw", "score"))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def rounded(x):
        calls.add(1)
        return round(x, 1)

    monkeypatch.setattr(rules, "points", rounded)
    assert rows(evidence.scored_touched(named).select("ticket_id", "types", "raw", "score")) == want
    assert 0 < calls.value < 100

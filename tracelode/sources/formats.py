"""Readers of the texts that artefacts come in: markdown, git logs and diffs, JUnit archives, manifests, code.

Line formats are parsed by Catalyst expressions. Only what needs a real parser (Python source, zip archives,
TOML, diffs with state over lines) runs in Arrow batches of ``mapInPandas``.
"""

from __future__ import annotations

import ast
import io
import re
import tomllib
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions import text


def headings(docs: DataFrame) -> DataFrame:
    """(doc, level, heading, slug, line_start, line_end) of H2 and H3; a section ends before the next heading."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    own = lines.where(F.col("line").rlike(r"^#{2,3}\s+\S"))
    last = docs.select("doc", F.size(F.split("text", "\n")).alias("lines"))
    order = Window.partitionBy("doc").orderBy("k")
    own = own.join(last, "doc").withColumn("next", F.lead("k").over(order))
    title = F.trim(F.regexp_replace("line", r"^#{2,3}\s+", ""))
    return own.select("doc", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), title.alias("heading"), text.slugify(title).alias("slug"), (F.col("k") + 1).alias("line_start"), F.coalesce("next", "lines").alias("line_end"))


def sections(docs: DataFrame) -> DataFrame:
    """(doc, section, body): text below each H2, trimmed; empty ones and what precedes the first H2 are left out."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    is_head = F.col("line").rlike(r"^##\s+\S")
    run = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("n", F.sum(is_head.cast("int")).over(run)).where("n > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_head, F.struct("k", "line")))), lambda x: x["line"]), "\n")
    title = F.max(F.when(is_head, F.trim(F.regexp_replace("line", r"^##\s+", ""))))
    out = numbered.groupBy("doc", "n").agg(title.alias("section"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    return out.where("body <> ''").select("doc", F.col("n").cast("int").alias("n"), "section", "body")


def ticket_markdown(files: DataFrame) -> DataFrame:
    """(ticket_id, source, subject) from "# Ticket: id", "**Source:** name" and the text under "## Subject"."""
    one = lambda p: F.regexp_replace(F.regexp_extract("text", p, 1), r"^\s+|\s+$", "")
    return files.select(one(r"(?m)^# Ticket:\s*(.+)$").alias("ticket_id"), one(r"(?m)^\*\*Source:\*\*\s*(.+)$").alias("source"), one(r"(?ms)^## Subject\s*\n(.*?)(?=^## |\z)").alias("subject"))


def git_log(logs: DataFrame) -> DataFrame:
    """(sha, committed, author, subject, status, path) from records of "COMMIT sha", date, author, e-mail, subject,
    a blank line and "X<TAB>path" lines; a row for each path."""
    record = F.explode(F.filter(F.split("text", r"(?m)^COMMIT "), lambda r: r != ""))
    lines = logs.select(record.alias("r")).select(F.split("r", "\n").alias("l"))
    paths = F.explode(F.filter(F.slice("l", 6, F.size("l")), lambda x: x.rlike(r"^[A-Z][0-9]*\t")))
    got = lines.select(*[F.trim(F.get("l", F.lit(k))).alias(n) for k, n in enumerate(("sha", "committed", "author", "email", "subject"))], paths.alias("p"))
    return got.select("sha", "committed", "author", "subject", F.substring("p", 1, 1).alias("status"), F.regexp_extract("p", r"\t([^\t]+)$", 1).alias("path"))


_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@ ?(.*)$")
_DEFINED = re.compile(r"^\+\s*(?:(?:async\s+)?def|class|function|func|fn)\s+([A-Za-z_]\w*)")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(sha, path, line, added, context, defines) of each hunk of a unified diff."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for sha, body in zip(pdf["sha"], pdf["text"], strict=True):
                path = ""
                for line in (body or "").split("\n"):
                    if line.startswith("+++ "):
                        path = line[6:] if line.startswith("+++ b/") else ""
                    elif (m := _HUNK.match(line)) and path:
                        rows.append([sha, path, int(m[1]), int(m[2] or 1), m[3].strip(), []])
                    elif rows and (m := _DEFINED.match(line)):
                        rows[-1][5].append(m[1])
            yield pd.DataFrame(rows, columns=["sha", "path", "line", "added", "context", "defines"])

    return diffs.select("sha", "text").mapInPandas(parse, "sha string, path string, line int, added int, context string, defines array<string>")


def junit(archives: DataFrame, longest: int = 2000) -> DataFrame:
    """(run, classname, name, seconds, status, message, trace) of the cases in all XML files of zip archives."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for run, content in zip(pdf["run"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".xml")):
                        for case in ElementTree.fromstring(z.read(name)).iter("testcase"):
                            bad = case.find("failure") if case.find("failure") is not None else case.find("error")
                            status = "failed" if bad is not None else "skipped" if case.find("skipped") is not None else "passed"
                            rows.append((run, case.get("classname", ""), case.get("name", ""), float(case.get("time") or 0), status, bad.get("message", "") if bad is not None else None, (bad.text or "")[:longest] if bad is not None else None))
            yield pd.DataFrame(rows, columns=["run", "classname", "name", "seconds", "status", "message", "trace"])

    return archives.select("run", "content").mapInPandas(parse, "run string, classname string, name string, seconds double, status string, message string, trace string")


def requirements(files: DataFrame) -> DataFrame:
    """(manifest, name, spec) from requirements texts; of repeated names the last counts."""
    lines = files.select("manifest", F.posexplode(F.split("text", "\n")).alias("k", "line")).withColumn("r", text.requirement(F.col("line"))).where("r is not null")
    return lines.groupBy("manifest", F.col("r.name").alias("name")).agg(F.max_by("r.spec", "k").alias("spec"))


def pyproject(files: DataFrame) -> DataFrame:
    """(manifest, line) of the dependencies of PEP 621 files; malformed files have none."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for manifest, body in zip(pdf["manifest"], pdf["text"], strict=True):
                try:
                    rows += [(manifest, str(x)) for x in tomllib.loads(body or "").get("project", {}).get("dependencies", [])]
                except tomllib.TOMLDecodeError:
                    continue
            yield pd.DataFrame(rows, columns=["manifest", "line"])

    return files.select("manifest", "text").mapInPandas(parse, "manifest string, line string")


def python_facts(files: DataFrame) -> DataFrame:
    """(path, fact, name, parent, line_start, line_end): classes, functions, methods, class attributes and imports
    of Python sources; one fact "error" for a source that doesn't parse."""

    def facts(path: str, source: str) -> list[tuple]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return [(path, "error", "", None, 0, 0)]
        rows = []

        def walk(body: list, parent: str | None) -> None:
            for node in body:
                if isinstance(node, ast.ClassDef):
                    rows.append((path, "class", node.name, parent, node.lineno, node.end_lineno))
                    walk(node.body, node.name)
                elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                    rows.append((path, "method" if parent else "function", node.name, parent, node.lineno, node.end_lineno))
                elif isinstance(node, ast.Import):
                    rows.extend((path, "import", a.name, None, node.lineno, node.end_lineno) for a in node.names)
                elif isinstance(node, ast.ImportFrom):
                    rows.append((path, "import", "." * node.level + (node.module or ""), None, node.lineno, node.end_lineno))
                elif parent and isinstance(node, ast.Assign | ast.AnnAssign):
                    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                    rows.extend((path, "attribute", t.id, parent, node.lineno, node.end_lineno) for t in targets if isinstance(t, ast.Name))

        walk(tree.body, None)
        return rows

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for p, s in zip(pdf["path"], pdf["text"], strict=True) for r in facts(p, s or "")]
            yield pd.DataFrame(rows, columns=["path", "fact", "name", "parent", "line_start", "line_end"])

    return files.select("path", "text").mapInPandas(parse, "path string, fact string, name string, parent string, line_start int, line_end int")

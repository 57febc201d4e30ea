"""Small rules over paths, names, versions and matches, as Catalyst expressions."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracelode.functions import text

#: Extensions of source files, and of files that a text may mention.
SOURCE_SUFFIXES = (".py", ".c", ".h", ".cpp", ".hpp", ".js", ".ts", ".jsx", ".tsx", ".rs", ".go", ".java", ".rb", ".swift", ".sh")
MENTIONED_SUFFIXES = ("c", "h", "cpp", "hpp", "py", "js", "ts", "md", "sh", "yaml", "yml")
#: manifests' names and their ecosystems, the first that fits.
MANIFESTS = (
    ("requirements*.txt", "pypi"), ("pyproject.toml", "pypi"), ("Pipfile", "pypi"), ("Pipfile.lock", "pypi"), ("poetry.lock", "pypi"),
    ("uv.lock", "pypi"), ("package.json", "npm"), ("package-lock.json", "npm"), ("yarn.lock", "npm"), ("*.csproj", "nuget"),
    ("packages.config", "nuget"), ("Directory.Packages.props", "nuget"), ("Gemfile", "rubygems"), ("Gemfile.lock", "rubygems"),
    ("go.mod", "go"), ("go.sum", "go"), ("Cargo.toml", "cargo"), ("Cargo.lock", "cargo"),
)
#: Kinds of blocks, and fields that a document's type requires.
BLOCK_KINDS = ("failure_mode", "known_issue", "fix", "risk", "diagnostic_note")
REQUIRED = {"lld": ("feature", "modules", "source_files", "test_files"), "spec": ("feature",), "adr": ("feature",)}


def segments(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")


def is_test_path(path: Column) -> Column:
    parts = segments(path)
    return F.element_at(parts, -1).startswith("test_") | F.array_contains(parts, "tests")


def is_source_path(path: Column) -> Column:
    """By extension, or a file without one under a folder ``scripts``."""
    suffix = F.lower(F.regexp_extract(text.base_of(path), r"^\.*[^.].*(\.[^.]*)$", 1))
    parts = segments(path)
    script = F.array_contains(F.slice(parts, F.lit(1), F.size(parts) - 1), "scripts") & (suffix == "")
    return suffix.isin(*SOURCE_SUFFIXES) | script


def actionability(path: Column) -> Column:
    """What a candidate's points are worth: files that can't hold a bug count a quarter."""
    return F.when(is_source_path(path) | is_test_path(path), 1.0).otherwise(0.25)


def mentioned_files(said: Column) -> Column:
    """Paths with a folder and a known extension that a text mentions, in order."""
    return F.regexp_extract_all(said, F.lit(r"(?U)\b([\w.-]+/[\w./-]+\.(?:" + "|".join(MENTIONED_SUFFIXES) + r"))\b"), F.lit(1))


def anchor_tokens(*terms: Column) -> Column:
    """Distinct tokens of all terms of the given arrays."""
    return F.array_distinct(F.flatten(F.transform(F.concat(*terms), text.tokenize)))


def matching_definitions(names: Column, anchors: Column) -> Column:
    """Names that share a token with ``anchors``, in order."""
    return F.filter(names, lambda n: F.arrays_overlap(text.tokenize(n), anchors))


def dependency_explanation(package: Column, before: Column, after: Column, manifest: Column, files: Column) -> Column:
    version = F.when(F.coalesce(before, F.lit("")) != "", F.concat(before, F.lit(" -> "), after)).otherwise(after)
    return F.concat(package, F.lit(" "), version, F.lit(" ("), manifest, F.lit("), used by "), F.array_join(files, ", "))


def failure_explanation(classname: Column, name: Column, run: Column, message: Column) -> Column:
    return F.concat(classname, F.lit("::"), name, F.lit(" failed in run "), run, F.lit(": "), message)


def slug_of_stem(stem: Column) -> Column:
    return F.replace(stem, F.lit("_"), F.lit("-"))


def slug_of_folder(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "/_", "--"), "^-+|-+$", "")


def package_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def bump_title(title: Column, package: Column) -> Column:
    """(from, to) of a version bump's title if it names the package, else null."""
    name, said = r"([A-Za-z0-9][A-Za-z0-9._-]*)", F.trim(F.coalesce(title, F.lit("")))
    out = F.lit(None).cast("struct<from:string,to:string>")
    for shape in (rf"(?i)^Update\s+{name}\s+requirement\s+from\s+(\S+)\s+to\s+(\S+)", rf"(?i)^Bump\s+{name}\s+from\s+(\S+)\s+to\s+(\S+)"):
        fits = said.rlike(shape) & (package_name(F.regexp_extract(said, shape, 1)) == package_name(package))
        out = F.when(fits, F.struct(F.regexp_extract(said, shape, 2).alias("from"), F.regexp_extract(said, shape, 3).alias("to"))).otherwise(out)
    return out


def resolved_version(package: Column, before: Column, after: Column, review: Column, by_bot: Column, title: Column) -> Column:
    """(from, to, relationship, source): the review's entry, else a bot's title, else what the manifests say.

    ``review``: array of (name, version, relationship).
    """
    entry = F.get(F.filter(review, lambda e: package_name(e["name"]) == package_name(package)), F.lit(0))
    said = bump_title(title, package)
    given = lambda c: F.when(c != "", c)  # noqa: E731  an empty text is none
    made = lambda a, b, how, source: F.struct(a.alias("from"), b.alias("to"), how.alias("relationship"), F.lit(source).alias("source"))
    unknown = F.lit("unknown")
    reviewed = made(before, F.coalesce(given(entry["version"]), after), F.coalesce(given(entry["relationship"]), unknown), "dependency_review")
    titled = made(said["from"], said["to"], unknown, "dependabot_title")
    return F.when(entry.isNotNull(), reviewed).when(by_bot & said.isNotNull(), titled).otherwise(made(before, after, unknown, "manifest_diff"))


def import_purl(module: Column, overrides: dict[str, str], ecosystem: str = "pypi") -> Column:
    """The package that an import comes from; null for the standard library of the running Python."""
    top = F.substring_index(module, ".", 1)
    known = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else None
    name = F.coalesce(F.try_element_at(known, top), top) if overrides else top
    return F.when(~top.isin(*sorted(sys.stdlib_module_names)), text.purl(F.lit(ecosystem), name))


def glob_pattern(glob: str) -> str:
    """A shell pattern of *, ? and [..] as a regular expression for whole names."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c, "\\" + c if c in r"\.^$+{}()|[]*?" else c)
        k += 1
    return rf"(?s)^{out}\z"


def manifest_ecosystem(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for glob, ecosystem in reversed(MANIFESTS):
        out = F.when(text.base_of(path).rlike(glob_pattern(glob)), ecosystem).otherwise(out)
    return out


def is_manifest(path: Column, globs: list[str] | None = None) -> Column:
    fits = F.lit(True) if globs is None else F.lit(False)
    for glob in globs or []:
        fits = fits | path.rlike(glob_pattern(glob))
    return manifest_ecosystem(path).isNotNull() & fits


def covers(path: Column, roots: Column, files: Column) -> Column:
    """Whether a module of these source roots and files has the path."""
    under = F.exists(roots, lambda r: path.startswith(F.concat(F.regexp_replace(r, "/+$", ""), F.lit("/"))) | (path == r))
    return under | F.array_contains(files, path)


def pull_number(fix: Column) -> Column:
    return F.regexp_replace(fix, "^gh-", "")


def investigation_id(system: Column, ticket: Column, issue: Column, fix: Column, query: Column) -> Column:
    return F.concat_ws("--", F.concat_ws("-", system, ticket), issue, fix, query)


def milestone_investigation_id(system: Column, ticket: Column) -> Column:
    return F.concat_ws("-", system, ticket)


def missing_match_fields(match: Column) -> Column:
    """Required fields that a match lacks; which are required depends on what it says it is.

    ``match``: a map from field to text.
    """
    has = lambda k: F.coalesce(F.try_element_at(match, F.lit(k)), F.lit("")) != ""
    fields = lambda *names: F.array(*map(F.lit, names))
    ticket = fields("project_slug", "source_system", "ticket_id")
    wanted = F.when(has("milestone_kind"), ticket).when(has("since_commit"), fields("project_slug", "file_path", "since_commit"))
    wanted = wanted.when(has("feature_slug"), fields("project_slug", "feature_slug")).otherwise(ticket)
    return F.filter(wanted, lambda k: F.coalesce(F.try_element_at(match, k), F.lit("")) == "")


def missing_frontmatter(doc_type: Column, present: Column) -> Column:
    """Fields that the document's type requires and that aren't given."""
    known = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_except(F.coalesce(F.try_element_at(known, doc_type), F.array().cast("array<string>")), present)


def is_stale(status: Column, began: Column, now: Column, minutes: int = 5) -> Column:
    """A run that says it runs but began over five minutes ago has failed."""
    return F.coalesce((status == "running") & (F.unix_micros(now) - F.unix_micros(began) > minutes * 60_000_000), F.lit(False))


def ratio(matched: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(F.try_divide(matched.cast("double"), total.cast("double")))


def points(x: Column) -> Column:
    """One decimal, by the double's exact binary value, halves to even."""
    return F.call_function("format_number", x, F.lit("0.0")).cast("double")


def decoded(base64: Column) -> Column:
    return F.decode(F.unbase64(base64), "utf-8")


def line_count(content: Column) -> Column:
    """Lines as their ends cut them; the last needs none."""
    ends = F.regexp_count(content, F.lit(r"\r\n|\n|\r"))
    return F.when(content == "", 0).otherwise(ends + F.when(content.rlike(r"[\r\n]\z"), 0).otherwise(1))


def short_message(message: Column, longest: int = 120) -> Column:
    """A commit message's first line, cut."""
    return F.substring(F.substring_index(message, "\n", 1), 1, longest)


@F.pandas_udf(StringType())
def embedded_json(noisy: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first JSON object in a noisy text, written with sorted keys; null where there is none."""
    read = json.JSONDecoder().raw_decode

    def first(said: str | None) -> str | None:
        at = (said or "").find("{")
        while at >= 0:
            try:
                return json.dumps(read(said, at)[0], sort_keys=True)
            except json.JSONDecodeError:
                at = said.find("{", at + 1)
        return None

    for batch in noisy:
        yield batch.map(first)

"""Worked cases of small rules: each part gets one, so a query runs over the whole table. Expected values are by hand from the rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.functions import rules, text
from tracelode.sources.domain import Domain


def _strings(x: str) -> Column:
    """An array of the parts between bars; none where the text is empty."""
    return F.filter(F.split(F.lit(x), r"\|"), lambda w: w != "")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|", "null")


def _sorted(c: Column) -> Column:
    return _joined(F.array_sort(c))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _number(c: Column) -> Column:
    return F.format_string("%.4f", c)


def _match(x: str) -> Column:
    """A map from "key=value" parts."""
    return F.str_to_map(F.lit(x), F.lit(r"\|"), F.lit("="))


def _review(x: str) -> Column:
    parts = F.filter(F.split(F.lit(x), r"\|"), lambda w: w != "")
    return F.transform(parts, lambda p: F.struct(F.split(p, ",")[0].alias("name"), F.split(p, ",")[1].alias("version"), F.split(p, ",")[2].alias("relationship")))


def _none(x: str) -> Column:
    return F.lit(None if x == "null" else x).cast("string")


#: For each query: the rule on a case's arguments, and (arguments, expected) of every case.
CASES: dict[str, tuple[Callable[..., Column], list[tuple[tuple[str, ...], str]]]] = {
    "rule_tokenize": (lambda x: _sorted(text.tokenize(F.lit(x))), [
        (("parseHTTPHeader_fast",), "fast|header|http|parse"), (("client-signal-and-output",), "client|output|signal"), (("a-bc the-Token",), "token"), (("new when useThese",), "new|use|when"),
        (("HTTPServer2Go",), "http|server2"), (("",), ""), (("yes no into onto via",), "via"), (("XMLHttp XMLHttp",), "http|xml"),
    ]),
    "rule_text_tokens": (lambda x: _sorted(text.text_tokens(F.lit(x))), [
        (("the parseHeader call in foo_bar2.",), "bar2|call|foo|header|parse"), (("9abc abc9 über Prüfung café naïve plain",), "abc9|plain"), (("a b cd",), ""), (("x.loadFile(path)",), "file|load|path"),
    ]),
    "rule_anchor_tokens": (lambda a, b, c: _sorted(rules.anchor_tokens(_strings(a), _strings(b), _strings(c))), [
        (("video-export|audio", "DiskFull error", "slow start"), "audio|disk|error|export|full|slow|start|video"), (("", "", ""), ""), (("and-or", "x", "The"), ""),
    ]),
    "rule_matching_definitions": (lambda d, a: _joined(rules.matching_definitions(_strings(d), _strings(a))), [
        (("exportVideo|main|load_audio|exportVideo", "video|audio"), "exportVideo|load_audio|exportVideo"), (("main|run", "video"), ""), (("", "video"), ""),
    ]),
    "rule_file_mentions": (lambda x: _joined(rules.mentioned_files(F.lit(x))), [
        (("see src/a/b.py and lib/x.hpp, not y.py or a/b.txt",), "src/a/b.py|lib/x.hpp"), (("(docs/read-me.md): ../up/z.yml.",), "docs/read-me.md|up/z.yml"), (("a/b.python a/b.cpp",), "a/b.cpp"), (("none",), ""),
    ]),
    "rule_test_path": (lambda x: _text(rules.is_test_path(F.lit(x))), [
        (("tests/a.py",), "true"), (("src/test_a.py",), "true"), (("a\\tests\\b.c",), "true"), (("src/a_test.py",), "false"), (("test/a.py",), "false"), (("mytests/a.py",), "false"), (("x/tests",), "true"),
    ]),
    "rule_source_path": (lambda x: _text(rules.is_source_path(F.lit(x))), [
        (("a/b.PY",), "true"), (("a/b.md",), "false"), (("scripts/deploy",), "true"), (("scripts/deploy.txt",), "false"), (("scripts",), "false"), (("a.d/run",), "false"), (("x/.sh",), "false"),
        (("x.swift",), "true"), (("x.cs",), "false"), (("ops/scripts/in/run",), "true"),
    ]),
    "rule_actionability": (lambda x: _text(rules.actionability(F.lit(x))), [
        (("src/a.py",), "1.0"), (("docs/a.md",), "0.25"), (("tests/data.json",), "1.0"), (("scripts/run",), "1.0"), (("a/test_notes.md",), "1.0"), (("LICENSE",), "0.25"),
    ]),
    "rule_role": (lambda x: _text(text.role_of(F.lit(x))), [
        (("a/x.g.cs",), "generated"), (("Intermediate/test_a.py",), "generated"), (("src/a_props.py",), "test"), (("src/TestA.cs",), "test"), (("Test/conf.toml",), "test"), (("pyproject.toml",), "config"),
        (("a/.env.local",), "config"), ((".env",), "config"), (("requirements-dev.txt",), "config"), (("notes.txt",), "source"), (("app/VERSION",), "config"), (("MYVERSION",), "config"), (("Makefile",), "config"),
        ((".gitignore",), "config"), (("docs/a.md",), "docs"), (("LICENSE",), "docs"), (("spec/Model.cfg",), "config"), (("spec/run",), "docs"), (("docs/a.py",), "source"), (("dist/app.min.js",), "source"), (("contest.py",), "source"), (("latest_tests.go",), "test"),
    ]),
    "rule_language": (lambda x: _text(text.language_of(F.lit(x))), [
        (("a.py",), "python"), (("a.H",), "cpp"), (("b/c.cc",), "cpp"), (("x.tsx",), "typescript"), (("x.jsx",), "javascript"), (("m.rs",), "rust"), (("m.go",), "go"), (("s.bash",), "shell"), (("l.umap",), "unreal_asset"),
        (("p.uproject",), "unreal_project"), (("d.mdx",), "markdown"), (("c.yml",), "yaml"), (("Makefile",), "unknown"), ((".py",), "unknown"), (("a.cs",), "csharp"), (("t.toml",), "toml"), (("j.json",), "json"), (("r.rst",), "unknown"),
    ]),
    "rule_dependency_explanation": (lambda p, a, b, m, f: rules.dependency_explanation(F.lit(p), _none(a), F.lit(b), F.lit(m), _strings(f)), [
        (("numpy", "1.0", "2.0", "req.txt", "a.py|b.py"), "numpy 1.0 -> 2.0 (req.txt), used by a.py, b.py"), (("numpy", "null", "2.0", "req.txt", "a.py"), "numpy 2.0 (req.txt), used by a.py"), (("x", "", "1", "m", ""), "x 1 (m), used by "),
    ]),
    "rule_failure_explanation": (lambda *x: rules.failure_explanation(*map(F.lit, x)), [(("tests.A", "test_x", "12", "boom"), "tests.A::test_x failed in run 12: boom"), (("", "t", "r", ""), "::t failed in run r: ")]),
    "rule_slugify": (lambda x: text.slugify(F.lit(x)), [
        (("Foo.bar & baz",), "foobar-baz"), (("Size (s)",), "size-s"), (("★ ☂ Stars",), "stars"), (("Ünïcode! x",), "n-code-x"), (("a/b [c] {d}",), "ab-c-d"), (("",), ""), (("snake_case - x",), "snake-case-x"),
        (("a" * 30 + " " + "b" * 30,), "a" * 30), (("c" * 50,), "c" * 40), (("It's what? #1",), "its-what-1"),
    ]),
    "rule_slug_to_name": (lambda x: text.slug_to_name(F.lit(x)), [(("audio-EXPORT-2go",), "Audio Export 2go"), (("x",), "X"), (("a--b",), "A  B"), (("two words-here",), "Two words Here")]),
    "rule_slug_of_stem": (lambda x: rules.slug_of_stem(F.lit(x)), [(("video_export_core",), "video-export-core"), (("plain",), "plain")]),
    "rule_slug_of_folder": (lambda x: rules.slug_of_folder(F.lit(x)), [(("src/core_lib/",), "src-core-lib"), (("_a/b_",), "a-b")]),
    "rule_bump_title": (lambda t, p: _text(F.concat_ws(">", rules.bump_title(F.lit(t), F.lit(p))["from"], rules.bump_title(F.lit(t), F.lit(p))["to"])), [
        (("Bump Foo_Bar from 1.0 to 2.0 in /x", "foo-bar"), "1.0>2.0"), (("  update foo requirement from >=1 to >=2", "Foo"), ">=1>>=2"), (("Bump foo from 1 to 2", "bar"), ""), (("Fix foo", "foo"), ""), (("Bump foo.baz from 1 to 2", "foo--baz"), "1>2"),
    ]),
    "rule_version_source": (lambda p, a, b, r, bot, t: _joined(F.array(*[F.coalesce(rules.resolved_version(F.lit(p), _none(a), _none(b), _review(r), F.lit(bot == "bot"), F.lit(t))[k], F.lit("null")) for k in ("from", "to", "relationship", "source")])), [
        (("Foo", "1", "2", "foo,2.1,direct", "bot", "Bump foo from 1.0 to 2.0"), "1|2.1|direct|dependency_review"), (("foo", "1", "2", "foo,,", "", ""), "1|2|unknown|dependency_review"),
        (("foo", "1", "2", "bar,9,direct", "bot", "Bump foo from 1.0 to 2.0"), "1.0|2.0|unknown|dependabot_title"), (("foo", "1", "2", "", "", "Bump foo from 1.0 to 2.0"), "1|2|unknown|manifest_diff"), (("foo", "null", "2", "", "bot", "else"), "null|2|unknown|manifest_diff"),
    ]),
    "rule_import_purl": (lambda x: _text(rules.import_purl(F.lit(x), {"yaml": "PyYAML", "cv2": "opencv_python"})), [(("os.path",), "null"), (("yaml.loader",), "pkg:pypi/pyyaml"), (("cv2",), "pkg:pypi/opencv-python"), (("My_Pkg.sub.x",), "pkg:pypi/my-pkg"), (("json",), "null")]),
    "rule_manifest": (lambda x: _text(rules.manifest_ecosystem(F.lit(x))), [
        (("a/requirements-dev.txt",), "pypi"), (("requirements.txt",), "pypi"), (("pyproject.toml",), "pypi"), (("web/package.json",), "npm"), (("App.csproj",), "nuget"), (("Gemfile.lock",), "rubygems"), (("go.sum",), "go"),
        (("Cargo.toml",), "cargo"), (("cargo.toml",), "null"), (("xpackage.json",), "null"), (("requirements.md",), "null"), (("uv.lock",), "pypi"),
    ]),
    "rule_manifest_globs": (lambda x, g: _text(rules.is_manifest(F.lit(x), None if g == "" else g.split("|"))), [
        (("a/go.mod", ""), "true"), (("a/go.mod", "a/*"), "true"), (("b/go.mod", "a/*|c/*"), "false"), (("a/x.py", "a/*"), "false"), (("s1/go.mod", "s[0-9]/go.mod"), "true"), (("sx/go.mod", "s[!a-z]/go.mod"), "false"), (("ab/go.mod", "a?/go.mod"), "true"),
    ]),
    "rule_module_covers": (lambda p, r, f: _text(rules.covers(F.lit(p), _strings(r), _strings(f))), [
        (("src/core/a.py", "src/core/", ""), "true"), (("src/core2/a.py", "src/core", ""), "false"), (("src/core", "src/core", ""), "true"), (("x/y.py", "src", "x/y.py"), "true"), (("x/y.py", "", ""), "false"),
    ]),
    "rule_closing_refs": (lambda x: _joined(F.transform(text.closing_references(F.lit(x)), lambda n: n.cast("string"))), [
        (("Fixes #12, closes #7; Resolve  #9",), "12|7|9"), (("fixed #1, closed #2, resolved #3",), ""), (("prefix #4 and FIX #5",), "4|5"), (("fixes 6",), ""),
    ]),
    "rule_label_kind": (lambda x: _text(text.label_kind(_strings(x))), [
        (("type: bug|x",), "bug"), (("Feature request",), "feature_request"), (("enhancements|DEBUG",), "bug"), (("misc",), "null"), (("",), "null"), (("kind/Enhancement",), "feature_request"),
    ]),
    "rule_pull_number": (lambda x: rules.pull_number(F.lit(x)), [(("gh-12",), "12"), (("12",), "12"), (("x-gh-3",), "x-gh-3")]),
    "rule_short_message": (lambda x: rules.short_message(F.lit(x)), [(("first\nsecond",), "first"), (("m" * 130,), "m" * 120), (("",), "")]),
    "rule_embedded_json": (lambda x: _text(rules.embedded_json(F.lit(x))), [
        (('noise {"b": 1, "a": "}{"} tail',), '{"a": "}{", "b": 1}'), (('{bad {"x": [1, {"y": null}]}',), '{"x": [1, {"y": null}]}'), (("none",), "null"), (('{"open": 1',), "null"), (('{} {"a": 1}',), "{}"),
    ]),
    "rule_base64": (lambda x: rules.decoded(F.lit(x)), [(("aGVsbG8=",), "hello"), (("w7xiZXI=",), "über"), (("",), "")]),
    "rule_line_count": (lambda x: _text(rules.line_count(F.lit(x))), [(("a\nb\n",), "2"), (("a\r\nb\rc",), "3"), (("",), "0"), (("one",), "1"), (("\n",), "1")]),
    "rule_round": (lambda x: _text(rules.points(F.lit(x).cast("double"))), [(("2.25",), "2.2"), (("2.75",), "2.8"), (("-6.75",), "-6.8"), (("3.0",), "3.0"), (("2.3125",), "2.3"), (("4.65",), "4.7"), (("0.15",), "0.1"), (("1234.5",), "1234.5")]),
    "rule_investigation_id": (lambda *x: rules.investigation_id(*map(F.lit, x)), [(("gh", "7", "ki-1", "fix-2", "actionable"), "gh-7--ki-1--fix-2--actionable")]),
    "rule_milestone_id": (lambda *x: rules.milestone_investigation_id(*map(F.lit, x)), [(("gh", "7"), "gh-7")]),
    "rule_match_fields": (lambda x: _joined(rules.missing_match_fields(_match(x))), [
        (("project_slug=p|source_system=g|ticket_id=1",), ""), (("project_slug=p|milestone_kind=k",), "source_system|ticket_id"), (("since_commit=c|project_slug=",), "project_slug|file_path"), (("feature_slug=f",), "project_slug"), (("feature_slug=f|since_commit=c|project_slug=p",), "file_path"), (("x=1",), "project_slug|source_system|ticket_id"),
    ]),
    "rule_frontmatter": (lambda t, p: _joined(rules.missing_frontmatter(F.lit(t), _strings(p))), [(("lld", "feature|modules"), "source_files|test_files"), (("spec", ""), "feature"), (("adr", "feature"), ""), (("note", ""), "")]),
    "rule_block_kind": (lambda x: _text(F.lit(x).isin(*rules.BLOCK_KINDS)), [(("fix",), "true"), (("known_issue",), "true"), (("Fix",), "false"), (("",), "false"), (("risk",), "true")]),
    "rule_stale_run": (lambda s, b, n: _text(rules.is_stale(F.lit(s), _none(b).cast("timestamp"), F.lit(n).cast("timestamp"))), [
        (("running", "2024-01-01 00:00:00", "2024-01-01 00:05:00"), "false"), (("running", "2024-01-01 00:00:00", "2024-01-01 00:05:00.001"), "true"), (("done", "2024-01-01 00:00:00", "2024-01-02 00:00:00"), "false"), (("running", "null", "2024-01-01 00:00:00"), "false"),
    ]),
    "rule_ratio": (lambda a, b: _number(rules.ratio(F.lit(int(a)), F.lit(int(b)))), [(("1", "4"), "0.2500"), (("3", "0"), "0.0000"), (("0", "5"), "0.0000"), (("2", "3"), "0.6667")]),
    "rule_confidence_band": (lambda b, up, down: _joined(F.transform(F.array(*[text.confidence_band(F.lit(float(b)), F.transform(_strings(up), lambda x: x.cast("double")), F.transform(_strings(down), lambda x: x.cast("double")))[k] for k in ("score", "low", "high")]), _number)), [
        (("0.5", "0.5", "0.2"), "0.6000|0.5400|0.6600"), (("1.2", "", ""), "1.0000|0.9400|1.0000"), (("-0.5", "", ""), "0.0000|0.0000|0.0600"), (("0.9", "0.5", ""), "0.9500|0.8900|1.0000"), (("0.5", "", "1.0"), "0.0000|0.0000|0.0600"),
    ]),
    "rule_requirement": (lambda x: _text(F.concat_ws(" ", text.requirement(F.lit(x))["name"], text.requirement(F.lit(x))["spec"])), [
        (("Foo.Bar[extra] >=1.0 ; python_version > '3' # why",), "Foo.Bar >=1.0"), (("plain",), "plain "), (("-r other.txt",), ""), (("# only",), ""), (("two words",), ""), (("x==1.0;m",), "x ==1.0"), (("a ; b",), ""),
    ]),
}


def query(name: str) -> Callable[[Domain], DataFrame]:
    """(p_partkey, value): the rule on the part's case."""
    rule, cases = CASES[name]

    def over(d: Domain) -> DataFrame:
        case = F.pmod("p_partkey", F.lit(len(cases)))
        value = F.lit(None).cast("string")
        for k, (arguments, _) in enumerate(cases):
            value = F.when(case == k, rule(*arguments)).otherwise(value)
        return d.table("part").select("p_partkey", value.alias("value"))

    return over


def sql(name: str) -> str:
    """The expected values by part."""
    quoted = ", ".join("'" + want.replace("'", "''") + "'" for _, want in CASES[name][1])
    return f"SELECT p_partkey, list_extract([{quoted}], CAST(p_partkey % {len(CASES[name][1])} AS INTEGER) + 1) AS value FROM part"

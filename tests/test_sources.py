from __future__ import annotations

import io
import zipfile

from tracelode.sources import formats


def test_git_log(spark):
    log = "COMMIT abc\n2024-01-01\nAnn\na@b.c\nfirst\n\nM\tsrc/a.py\nR100\told.py\tnew.py\nCOMMIT def\n2024-01-02\nBo\nb@b.c\nsecond\n\nA\tx y.py\n"
    got = sorted((r["sha"], r["status"], r["path"]) for r in formats.git_log(spark.createDataFrame([(log,)], "text string")).collect())
    assert got == [("abc", "M", "src/a.py"), ("abc", "R", "new.py"), ("def", "A", "x y.py")]


def test_diff_hunks(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def outer():\n+def inner(a):\n+    pass\n@@ -9 +12 @@\n-gone\n"
    got = formats.diff_hunks(spark.createDataFrame([("s", diff), ("t", None)], "sha string, text string")).collect()
    assert [(r["path"], r["line"], r["added"], r["context"], r["defines"]) for r in got] == [("x.py", 3, 4, "def outer():", ["inner"]), ("x.py", 12, 1, "", [])]


def test_junit(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("r.xml", '<testsuite><testcase classname="a.B" name="ok" time="0.5"/><testcase classname="a.B" name="bad"><failure message="m">trace</failure></testcase></testsuite>')
        z.writestr("note.txt", "no")
    got = formats.junit(spark.createDataFrame([("r1", raw.getvalue())], "run string, content binary")).collect()
    assert [(r["name"], r["status"], r["message"], r["trace"]) for r in got] == [("ok", "passed", None, None), ("bad", "failed", "m", "trace")]


def test_manifests(spark):
    req = spark.createDataFrame([("m", "a==1\n# no\nb[x]>=2\na==3\n")], "manifest string, text string")
    assert sorted((r["name"], r["spec"]) for r in formats.requirements(req).collect()) == [("a", "==3"), ("b", ">=2")]
    toml = spark.createDataFrame([("m", '[project]\ndependencies = ["a>=1", "b"]\n'), ("bad", "[")], "manifest string, text string")
    assert [r["line"] for r in formats.pyproject(toml).collect()] == ["a>=1", "b"]


def test_python_facts(spark):
    src = "import os\nfrom . import x\nclass A:\n    k = 1\n    def m(self):\n        pass\nasync def f():\n    pass\n"
    got = formats.python_facts(spark.createDataFrame([("p", src), ("q", "def (")], "path string, text string")).collect()
    assert sorted((r["path"], r["fact"], r["name"], r["parent"]) for r in got) == [("p", "attribute", "k", "A"), ("p", "class", "A", None), ("p", "function", "f", None), ("p", "import", ".", None), ("p", "import", "os", None), ("p", "method", "m", "A"), ("q", "error", "", None)]

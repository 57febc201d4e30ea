from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelode.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "want"), [("parseHTTPHeader_fast", ["parse", "http", "header", "fast"]), ("a-bc the-Token", ["token"]), ("", [])])
def test_tokenize(spark, name, want):
    assert one(spark, name, text.tokenize) == want


@pytest.mark.parametrize(("heading", "want"), [("Size (s)", "size-s"), ("  Ünïcode! x", "n-code-x"), ("", ""), ("a" * 30 + " " + "b" * 30, "a" * 30)])
def test_slugify(spark, heading, want):
    assert one(spark, heading, text.slugify) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=60), min_size=1, max_size=20))
def test_slugs_hold_only_slug_characters(spark, names):
    got = spark.createDataFrame([(n,) for n in names], "x string").select(text.slugify(F.col("x")).alias("y")).collect()
    assert all(set(r["y"]) <= set("abcdefghijklmnopqrstuvwxyz0123456789-") and len(r["y"]) <= 40 for r in got)


def test_requirement(spark):
    r = one(spark, "Foo.Bar[extra] >=1.0 ; python_version > '3' # why", text.requirement)
    assert (r["name"], r["spec"]) == ("Foo.Bar", ">=1.0")
    assert one(spark, "# only a comment", text.requirement) is None


def test_closing_references(spark):
    assert one(spark, "Fixes #12, closes #7 and resolved #9; see #5", text.closing_references) == [12, 7]


def test_paths(spark):
    assert one(spark, "a.b.C", text.candidate_paths) == ["a/b/C.py", "a/b.py", "a.py"]
    assert one(spark, "x/y/z.py", text.path_suffixes) == ["x/y/z.py", "y/z.py", "z.py"]
    assert [one(spark, p, text.role_of) for p in ("tests/a.py", "src/a_test.go", "docs/x.md", "src/x.py")] == ["test", "test", "docs", "source"]


def test_natural_id_equals_hashlib(spark):
    import hashlib

    got = spark.createDataFrame([("file", "p", None)], "a string, b string, c string").select(text.natural_id(F.col("a"), F.col("b"), F.col("c")).alias("i")).first()["i"]
    assert got == int.from_bytes(hashlib.sha256(b"file\0p\0").digest()[:8], "big", signed=True)

"""Checks of proposed metadata, merges of proposals, and grouping of code into modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.sources import formats
from tracelode.sources.domain import Domain


def merged_candidates(d: Domain) -> DataFrame:
    """Per brand, the distinct types in the order they are first seen."""
    own = d.table("part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    lists = own.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("first", "p_type"))).alias("l"))
    return lists.select("p_brand", F.array_join(F.transform("l", lambda x: x["p_type"]), ",").alias("types"))


def module_groups(d: Domain, least: int = 2) -> DataFrame:
    """Folders that hold ``least`` source files are modules of their own, with how many stems are ambiguous."""
    own = d.parts.where("role = 'source'").select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"))
    return own.groupBy("folder").agg(F.count("*").alias("files"), F.countDistinct("stem").alias("stems")).where(F.col("files") >= least)


def unclaimed_files(d: Domain) -> DataFrame:
    """Source files of modules that no returned line touches."""
    claimed = d.table("lineitem").where("l_returnflag = 'R' and l_quantity >= 45").select(F.col("l_partkey").alias("part")).distinct()
    return d.parts.where("role = 'source'").join(claimed, "part", "left_anti").select("path")


def duplicate_modules(d: Domain) -> DataFrame:
    """Pairs of modules of one feature whose sets of file sizes are equal, or one within the other."""
    sizes = d.table("part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("s"))
    a, b = sizes.alias("a"), sizes.alias("b")
    pairs = a.join(b, (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_type") < F.col("b.p_type")))
    common = F.size(F.array_intersect("a.s", "b.s"))
    return pairs.select(F.col("a.p_brand").alias("feature"), F.col("a.p_type").alias("left_type"), F.col("b.p_type").alias("right_type"), common.alias("common"), (common == F.least(F.size("a.s"), F.size("b.s"))).cast("int").alias("is_subset"))


def part_sources(d: Domain) -> DataFrame:
    """(path, text): a small Python source for each part, for the code readers."""
    name = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("import os\nfrom typing import Any\n\nclass Part"), name, F.lit(":\n    size = "), F.col("p_size").cast("string"), F.lit("\n    def price(self):\n        return 1\n\ndef build_"), name, F.lit("():\n    return Part"), name, F.lit("()\n"))
    return d.table("part").select(F.concat(F.lit("src/"), name, F.lit(".py")).alias("path"), body.alias("text"))


def code_facts(d: Domain) -> DataFrame:
    return formats.python_facts(part_sources(d)).groupBy("fact").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def part_docs(d: Domain) -> DataFrame:
    """(doc, text): a markdown text for each part."""
    text_of = F.concat(F.lit("# "), F.col("p_name"), F.lit("\nintro\n## About "), F.col("p_brand"), F.lit("\nbody one\n\n### Size (s)\n"), F.col("p_size").cast("string"), F.lit("\n## Type: "), F.col("p_type"), F.lit("\n\n## Price\ncosts"))
    return d.table("part").select(F.col("p_partkey").alias("doc"), text_of.alias("text"))


def part_headings(d: Domain) -> DataFrame:
    return formats.headings(part_docs(d))


def part_sections(d: Domain) -> DataFrame:
    return formats.sections(part_docs(d))


def ticket_files(d: Domain) -> DataFrame:
    body = F.concat(F.lit("# Ticket: "), F.col("o_orderkey").cast("string"), F.lit("\n**Source:** "), F.col("o_orderpriority"), F.lit("\n\n## Subject\nstatus "), F.col("o_orderstatus"), F.lit("\n\n## Rest\nmore"))
    return formats.ticket_markdown(d.table("orders").select(body.alias("text")))


def git_records(d: Domain) -> DataFrame:
    """Suppliers as commits that touch two files each."""
    body = F.concat(F.lit("COMMIT c"), F.col("s_suppkey").cast("string"), F.lit("\n2024-01-01\n"), F.col("s_name"), F.lit("\nx@y.z\nfix it\n\nM\tsrc/a"), F.col("s_nationkey").cast("string"), F.lit(".py\nA\ttests/b.py\n"))
    return formats.git_log(d.table("supplier").select(body.alias("text")))


def label_kinds(d: Domain) -> DataFrame:
    labels = F.array(F.when(F.col("o_orderpriority") == "1-URGENT", "Bug").when(F.col("o_orderpriority") == "2-HIGH", "Enhancement").otherwise("misc"), F.lit("x"))
    return d.table("orders").select("o_orderkey", text.label_kind(labels).alias("kind"))


def searched_headings(d: Domain, wanted: str) -> DataFrame:
    """Headings that hold the wanted text, whatever its case."""
    return part_headings(d).where(F.lower("heading").contains(wanted.lower()))

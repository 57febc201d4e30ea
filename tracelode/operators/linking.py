"""Links from free text to registered terms, and facts drawn from paths, names and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.sources.domain import Domain


#: A character of a word, as in the reference's patterns.
WORD = r"[\p{L}\p{N}_]"


def error_links(d: Domain) -> DataFrame:
    """(doc_id, item_id): registered terms that occur in documents as whole runs of words.

    Terms are looked up by their first three words, or all where there are fewer, so only documents that hold
    these in a row are searched for the whole term. Where a term ends in a character of a word, the word must end
    there too. Terms without words are searched in all documents; empty ones are in none.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(f"{WORD}+"), F.lit(0))
    key = lambda w, i, n: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])
    head = lambda w: F.concat_ws(" ", F.slice(w, 1, 3))
    term = F.lower("text").alias("term")
    terms = d.table("benchmark").where("text <> ''").select("item_id", term, head(words(F.col("text"))).alias("k"))
    docs = d.table("documents").select("doc_id", F.lower("text").alias("low"), words(F.col("text")).alias("w"))
    runs = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: key(F.col("w"), i, n))
    spots = docs.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[runs(n) for n in (1, 2, 3)])))).alias("k"))
    near = spots.join(terms.where("k <> ''"), "k").select("doc_id", "item_id", "term").distinct()
    near = near.join(docs.select("doc_id", "low"), "doc_id").unionByName(docs.select("doc_id", "low").crossJoin(F.broadcast(terms.where("k = ''").select("item_id", "term"))))
    quoted = F.concat(F.lit(r"\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    start = F.when(F.col("term").rlike(f"^{WORD}"), f"(?<!{WORD})").otherwise("")
    end = F.when(F.col("term").rlike(rf"{WORD}\z"), f"(?!{WORD})").otherwise("")
    return near.where(F.col("low").contains(F.col("term")) & F.rlike("low", F.concat(start, quoted, end))).select("doc_id", "item_id")


def text_token_counts(d: Domain) -> DataFrame:
    """Distinct tokens per document of any language, over whole texts."""
    return d.table("documents").select("doc_id", F.size(text.text_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))


def module_tokens(d: Domain) -> DataFrame:
    named = d.parts.select("module").distinct()
    return named.select("module", F.explode(text.tokenize(F.col("module"))).alias("token"))


def slugs(d: Domain) -> DataFrame:
    """Part names as slugs, and names made of these again; equal slugs share the longest name."""
    own = d.table("part").select("p_partkey", F.col("p_name").alias("name"), text.slugify(F.col("p_name")).alias("slug"))
    best = own.groupBy("slug").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("kept"), F.count("*").alias("n"))
    return best


def packages(d: Domain) -> DataFrame:
    """Package urls and requirements parsed from made-up lines of parts."""
    line = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_type"), F.lit("[extra]>="), F.col("p_size").cast("string"), F.lit(" ; python_version > '3' # pinned"))
    own = d.table("part").select("p_partkey", line.alias("line"))
    own = own.withColumn("r", text.requirement(F.regexp_replace("line", "#", "-")))
    return own.select("p_partkey", text.purl(F.lit("pypi"), F.col("r.name")).alias("purl"), F.col("r.spec").alias("spec"))


def roles(d: Domain) -> DataFrame:
    return d.parts.select(text.role_of(F.col("path")).alias("role"), text.language_of(F.col("path")).alias("language")).groupBy("role", "language").agg(F.count("*").alias("n"))


def mirrored(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test_path, path): sources of the name that a test's name, without its test_ or _test, mirrors, in any folder."""
    base, suffix = text.base_of(F.col("test_path")), F.regexp_extract(text.base_of(F.col("test_path")), r"(\.[^.]*)$", 1)
    stem = F.substr(base, F.lit(1), F.length(base) - F.length(suffix))
    bare = F.when(stem.startswith("test_"), F.substr(stem, F.lit(6))).when(stem.endswith("_test"), F.regexp_replace(stem, "_test$", "")).otherwise(stem)
    named = tests.withColumn("name", F.concat(bare, suffix))
    return named.join(sources.select("path", text.base_of(F.col("path")).alias("name")), "name").select("test_path", "path").distinct()


def mirrored_coverage(d: Domain) -> DataFrame:
    """Parts' tests, named in three ways, with the sources that they mirror: how many, and the first."""
    key, number = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 97).cast("string")
    own = d.table("part")
    sources = own.select(F.concat(F.lit("src/"), "p_type", F.lit("/m"), number, F.lit(".py")).alias("path")).distinct()
    shape = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("/test_m"), number)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/m"), number, F.lit("_test"))).otherwise(F.concat(F.lit("/m"), number))
    tests = own.select(F.concat(F.lit("tests/"), key, shape, F.lit(".py")).alias("test_path"))
    return mirrored(tests, sources).groupBy("test_path").agg(F.count("*").alias("covers"), F.min("path").alias("first_source"))


def closing_turns(d: Domain) -> DataFrame:
    """Users' turns as ticket texts: all issue numbers that they close, in order, and the text's length."""
    own = d.table("conversations").where("role = 'user'").withColumn("text", F.coalesce("text", F.lit("")))
    said = F.concat(F.col("text"), F.lit(" Closed #1, closes #2 and FIX #"), F.col("conv_id").cast("string"))
    closes = F.array_join(F.transform(text.closing_references(said), lambda n: n.cast("string")), ",")
    return own.select("conv_id", "turn", closes.alias("closes"), F.length("text").alias("length"))


def bands(d: Domain) -> DataFrame:
    """Customers' confidence from their balance: boosts and penalties folded into [0, 1]."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000))
    return d.table("customer").select("c_custkey", text.confidence_band(base, F.array(F.lit(0.5), F.lit(0.25)), F.array(F.lit(0.5))).alias("band")).select("c_custkey", "band.*")


def slug_collisions(d: Domain) -> DataFrame:
    """Slugs that several names share."""
    return slugs(d).where("n > 1")

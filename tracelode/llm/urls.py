"""URL filters: given rules by longest match, and association rules that FP-growth mines from labels.

A url's tokens are its scheme, host labels, path words (digits as one sign), extension, parameter names and
whether it has a fragment. Labelled pages are transactions of tokens and one label. Tokens that fewer than ``MIN_ROWS``
pages hold are left out, and tokens that exactly the same pages hold are one item, so neither long urls nor words that
always come together multiply combinations. FP-growth finds the combinations that ``MIN_SUPPORT`` of the pages and
``MIN_ROWS`` at least hold. Rules that lead to a label with ``MIN_CONFIDENCE`` are kept
unless a rule of fewer items does as well. A url has an item if it has one of its tokens. An inverted index holds
each rule under its rarest item, so a url meets the rules of its own items only; the surest rule met decides, then the better supported one, then the later antecedent and the later verdict. A url
that meets no rule is allowed.

Defined results: a null url, or one without "://", has an empty host and path and no tokens, fits no rule and is
allowed; urls of any length are read whole; repeated rows are judged alike, and each trains; without labels nothing is mined and the rest is allowed; an empty
table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.common import table, work_dir, written

#: Rules as host and path with their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_ROWS = 0.002, 0.5, 5
#: Bytes of rules' tokens that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
LABEL = "label="

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as (rule, verdict); null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, rest = rule.split("/", 1)
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens; empty for what is no url."""
    tagged = lambda tag, words: F.transform(words, lambda w: F.concat(F.lit(tag), w))
    host, path = host_of(url), F.regexp_replace(path_of(url), "[0-9]+", "0")
    words = F.filter(F.split(path, "[/._-]+"), lambda w: w != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.filter(F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1)), lambda w: w != "")
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^(?s:(.*?))://", 1))),
        tagged("host:", F.filter(F.split(host, r"\."), lambda w: w != "")),
        tagged("path:", words),
        tagged("param:", names),
        F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def items_of(rows: DataFrame, work: str) -> DataFrame:
    """(t, item): tokens of ``MIN_ROWS`` rows at least, and the first of those that the same rows hold.

    Sets of rows are told apart by their number and two sums of their rows' hashes.
    """
    held = rows.select(F.explode("tokens").alias("t"), F.xxhash64("row").cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), "row").cast("decimal(38,0)").alias("b"))
    often = held.groupBy("t").agg(F.count("*").alias("often"), F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("often") >= MIN_ROWS)
    often = written(often, f"{work}/often")
    first = often.groupBy("often", "a", "b").agg(F.min("t").alias("item"))
    return written(often.join(first, ["often", "a", "b"]).select("t", "item", "often"), f"{work}/items")


def mined(labelled: DataFrame, work: str, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(key, antecedent, verdict, confidence, support) from (tokens, verdict), key being the rarest item, and (t, item, often)."""
    spark = labelled.sparkSession
    rows = labelled.where("verdict is not null and size(tokens) > 0").select("tokens", "verdict")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), f"{work}/labelled")
    items = items_of(rows, work)
    schema = "key string, antecedent array<string>, verdict string, confidence double, support double"
    total = rows.count()
    if total < MIN_ROWS:
        return spark.createDataFrame([], schema), items
    named = rows.select("row", "verdict", F.explode("tokens").alias("t")).join(items, "t")
    baskets = named.groupBy("row", "verdict").agg(F.collect_set("item").alias("items"))
    baskets = baskets.select(F.array_append("items", F.concat(F.lit(LABEL), F.col("verdict"))).alias("items"))
    # Labels stand in all rows, so shares are of those that hold an item.
    baskets = written(baskets, f"{work}/baskets")
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], schema), items
    least = max(math.ceil(support * total), MIN_ROWS)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent")[0].startswith(LABEL))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 99).alias("verdict"), "confidence", (F.col("support") * n / total).alias("support"))
    rules = written(rules, f"{work}/rules")
    # A rule goes where dropping one of its items leaves a rule to the same label that is no less sure.
    less = rules.where(F.size("antecedent") > 1).select("antecedent", "verdict", "confidence", F.explode("antecedent").alias("t"))
    less = less.select("antecedent", "verdict", F.col("confidence").alias("own"), F.array_remove("antecedent", F.col("t")).alias("shorter"))
    wider = rules.select(F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("of_shorter"))
    needless = less.join(wider, ["shorter", "verdict"]).where("of_shorter >= own").select("antecedent", "verdict").distinct()
    kept = rules.join(needless, ["antecedent", "verdict"], "left_anti")
    often = items.select(F.col("item").alias("t"), "often").distinct()
    keyed = kept.withColumn("t", F.explode("antecedent")).join(often, "t").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("often", "t"))["t"].alias("key"))
    return written(keyed.select(*[c.split()[0] for c in schema.split(", ")]), f"{work}/kept"), items


def small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` to be broadcast where the bytes of ``size`` of all rows are few."""
    return F.broadcast(df) if (df.agg(F.sum(size + 64)).first()[0] or 0) <= BROADCAST_BYTES else df


def judged(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict, and the mined rule that decided, if one did.

    ``labels``: (page_id, verdict); pages without one don't train.
    """
    work = work_dir(pages.sparkSession)
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    seen = seen.withColumn("given", given_rule(F.col("host"), F.col("path"))).withColumn("row", F.monotonically_increasing_id())
    seen = written(seen, f"{work}/seen")
    once = labels.where("page_id is not null").groupBy("page_id").agg(F.min("verdict").alias("verdict"), F.max("verdict").alias("other")).where("verdict = other").select("page_id", "verdict")
    rules, items = mined(seen.join(once, "page_id").select("tokens", "verdict"), work)
    used = rules.select(F.explode("antecedent").alias("item")).distinct()
    used = written(items.select("t", "item").join(used, "item"), f"{work}/used")
    asked = seen.where("given is null").select("row", F.explode("tokens").alias("t")).join(small(used, F.length("t") + F.length("item")), "t")
    asked = asked.groupBy("row").agg(F.collect_set("item").alias("items")).select("row", "items", F.explode("items").alias("key"))
    width = F.aggregate("antecedent", F.length("key"), lambda n, x: n + F.length(x))
    met = asked.join(small(rules, width), "key").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = met.groupBy("row").agg(F.max(F.struct("confidence", "support", "antecedent", F.col("verdict").alias("said"))).alias("best"))
    out = seen.join(best, "row", "left")
    verdict = F.coalesce("given.verdict", "best.said", F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.col("best.antecedent").alias("mined"), F.col("best.confidence").alias("confidence"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is the document of its id; poor or toxic ones are to be blocked."""
    labels = table(spark, sf_dir, "labels").where("quality is not null or toxic is not null")
    labels = labels.select(F.col("doc_id").alias("page_id"), F.when((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0), "block").otherwise("allow").alias("verdict"))
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), labels)

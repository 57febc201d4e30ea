"""Benchmark decontamination in DataFrame operations only: SimHash windows, Hamming blocks, exact check.

An item of n words meets documents' windows of n words; a shorter document is one window with the shingles
that it has. Words are lower-cased. A window is only built where it can reach the threshold: a weighted similarity
of 0.8 needs four fifths of the item's shingles, so of a fifth of them and one more it has one (see ``anchors``);
where a document has one of such a set, all windows that hold it are cut, and each remembers the anchors it was cut for.

Windows and items get 64-bit SimHash fingerprints of their distinct shingles; the 64 bits are cut into ``RADIUS + 1``
blocks, of which two fingerprints within ``RADIUS`` share one at least, so an equi-join on (anchor, words, block, value)
finds all of them; the anchor keeps windows from meeting items that they have no shingle of. Exact weighted
similarity of five-word shingles (occurrences in common over occurrences in either) decides.

RADIUS: at 0.8 two windows without repeated shingles have at most one distinct shingle in nine apart, so a bit
differs with a probability of 0.151 at most, and more than 24 of 64 differ in 2.4 of a million such windows at
the very threshold (20: 3 of 10,000). Repeated shingles weigh in the similarity but not in fingerprints, so pairs
where either side has some don't depend on fingerprints: all of them that share an anchor go to the exact check.

Defined results: null or empty texts and items hold no words and match nothing; an item of fewer than five
words is one shingle of all of them; texts of any length are searched whole; of a document's windows that match an item
equally well the first is given; repeated items and rows count once each; rows with a null doc_id or item_id take no
part (``clean`` keeps such documents); an empty table gives an empty result; extra columns, of any name, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm.common import table, work_dir, written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Bytes of anchors that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """Lower-cased words; null and blank texts have one empty word."""
    return F.split(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit("\x20\x09\x0a\x0b\x0c\x0d")), r"[\x20\x09-\x0D]+")


def shingle(w: Column, at: Column, n: int) -> Column:
    """The hash of the n words from ``at``."""
    return F.xxhash64(*[F.get(w, at + k) for k in range(n)])


def shingles(w: Column, n: int) -> Column:
    """All shingle hashes in order; one of all the words where there are fewer than n."""
    size = F.size(w)
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: shingle(w, i, n))).when(size > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: DataFrame, *keys: str) -> DataFrame:
    """SimHash by key of the rows' hashes ``h``: 64 signed sums and their signs."""
    sums = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(64)]
    value = F.lit(0).cast("long")
    for b in range(64):
        value = value.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")))
    return hashes.groupBy(*keys).agg(*sums).select(*keys, value.alias("mark"))


def blocks(mark: Column, radius: int) -> Column:
    """The values of radius + 1 runs of bits, each with its number."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(mark, a).bitwiseAND((1 << (b - a)) - 1).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def anchors(items: DataFrame, similarity: float, n: int) -> DataFrame:
    """(item_id, n_words, word, offset, size, h): shingles of which a window that reaches the threshold holds one.

    Such a window, of whatever size, has at least sT of the item's T shingles, so of any (1-s)T + 1 shingles
    it has one. Those with the longest words are taken, as these are rare. ``word`` is the shingle's longest word,
    ``offset`` its place there and ``size`` the shingle's words.
    """
    total = F.size("s")
    spare = F.floor(total * (1 - similarity) + 1e-9).cast("int") + 1
    at = items.select("item_id", "n_words", "w", spare.alias("spare"), F.posexplode("s").alias("k", "h"))
    own = at.withColumn("own", F.slice("w", F.col("k") + 1, F.least("n_words", F.lit(n))))
    long = own.withColumn("word", F.array_max(F.transform("own", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"])
    rank = F.row_number().over(Window.partitionBy("item_id", "w").orderBy(F.desc(F.length("word")), "word", "k"))
    chosen = long.withColumn("rank", rank).where("rank <= spare")
    offset = (F.array_position("own", F.col("word")) - 1).cast("int")
    return chosen.select("item_id", "n_words", "word", offset.alias("offset"), F.size("own").alias("size"), "h").distinct()


def starts(at: Column, size: Column, words_of: Column, n_words: Column) -> Column:
    """Where windows of n_words words start that hold the ``size`` words from ``at`` of a text of ``words_of`` words."""
    return F.sequence(F.greatest(F.lit(0), at - n_words + size), F.greatest(F.lit(0), F.least(at, words_of - n_words)))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity, at, n_words): for each document and item that match, the best window.

    ``n_words`` is the item's, also where the whole document has fewer words.
    """
    spark = docs.sparkSession
    work = work_dir(spark)
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w")).where(F.get("w", F.lit(0)) != "").distinct()
    items = written(items.select("item_id", "w", F.size("w").alias("n_words"), shingles(F.col("w"), n).alias("s")), f"{work}/items")
    anchored = written(anchors(items, similarity, n), f"{work}/anchored")
    held = anchored.groupBy("word", "offset", "size", "h").agg(F.array_sort(F.collect_set("n_words")).alias("sizes"))
    held = written(held, f"{work}/held")

    texts = docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("w"))
    spots = texts.select("doc_id", "w", F.posexplode("w").alias("place", "word"))
    at = F.col("place") - F.col("offset")
    same = F.when(F.col("size") == n, shingle(F.col("w"), at, n)).otherwise(F.xxhash64(F.concat_ws(" ", F.slice("w", at + 1, F.col("size")))))
    inside = (at >= 0) & (at + F.col("size") <= F.size("w"))
    hit = F.when(inside, same) == F.col("h")
    window = F.slice("w", F.col("start") + 1, F.col("n_words")).alias("w")
    room = held.agg(F.sum(F.length("word") + 4 * F.size("sizes") + 64)).first()[0] or 0
    if room <= BROADCAST_BYTES:  # a window is cut where its shingle is met, so no text is moved
        near = spots.join(F.broadcast(held), "word").where(hit).select("doc_id", "w", "h", at.alias("at"), "size", F.explode("sizes").alias("n_words"))
        near = near.select("doc_id", "w", "h", "n_words", F.explode(starts(F.col("at"), F.col("size"), F.size("w"), F.col("n_words"))).alias("start"))
        cut = near.select("doc_id", "n_words", "start", "h", window)
    else:  # a word moves with the shingles around it instead of the text
        around = F.transform(F.sequence(F.lit(1 - n), F.lit(0)), lambda k: shingle(F.col("w"), F.col("place") + k, n))
        short = F.transform(F.sequence(F.lit(1 - n), F.lit(0)), lambda k: F.when(F.col("place") + k >= 0, F.slice("w", F.col("place") + k + 1, n)))
        met = spots.select("doc_id", F.size("w").alias("words_of"), "place", "word", around.alias("around"), short.alias("short")).join(held, "word")
        other = F.xxhash64(F.concat_ws(" ", F.slice(F.get("short", n - 1 - F.col("offset")), 1, F.col("size"))))
        same = F.when(F.col("size") == n, F.get("around", n - 1 - F.col("offset"))).otherwise(other)
        met = met.where(F.when((at >= 0) & (at + F.col("size") <= F.col("words_of")), same) == F.col("h"))
        met = met.select("doc_id", "h", "words_of", at.alias("at"), "size", F.explode("sizes").alias("n_words"))
        met = met.select("doc_id", "n_words", "h", F.explode(starts(F.col("at"), F.col("size"), F.col("words_of"), F.col("n_words"))).alias("start"))
        windows = written(met.distinct(), f"{work}/windows")
        cut = windows.join(texts, "doc_id").select("doc_id", "n_words", "start", "h", window)
    # A row for each window; rows of one doc_id can have different texts.
    cut = cut.groupBy("doc_id", "n_words", "start", F.xxhash64("w").alias("of")).agg(F.first("w").alias("w"), F.collect_set("h").alias("anchors")).drop("of")
    cut = written(cut.withColumn("win", F.monotonically_increasing_id()), f"{work}/cut")
    plain = lambda s: F.size(s) == F.size(F.array_distinct(s))
    of_win = cut.select("win", "n_words", "anchors", plain(shingles(F.col("w"), n)).alias("plain"))
    of_item = items.withColumn("number", F.monotonically_increasing_id())
    of_item = written(of_item.select("number", "item_id", "n_words", "s", plain(F.col("s")).alias("item_plain")), f"{work}/numbered")
    marks = fingerprint(cut.select("win", F.explode(F.array_distinct(shingles(F.col("w"), n))).alias("h")), "win")
    item_marks = fingerprint(of_item.select("number", F.explode(F.array_distinct("s")).alias("h")), "number")
    own_anchors = anchored.select("item_id", "n_words", "h").distinct()
    left = written(of_win.join(marks, "win").withColumn("h", F.explode("anchors")).drop("anchors"), f"{work}/left")
    right = of_item.join(item_marks, "number").select("number", "item_id", "n_words", "item_plain", F.col("mark").alias("item_mark"))
    right = written(right.join(own_anchors, ["item_id", "n_words"]).drop("item_id"), f"{work}/right")
    split = lambda df, mark: df.withColumn("b", F.explode(blocks(F.col(mark), radius))).select(*df.columns, "b.*")
    alike = split(left, "mark").join(split(right, "item_mark"), ["h", "n_words", "block", "value"])
    alike = alike.where(F.bit_count(F.col("mark").bitwiseXOR(F.col("item_mark"))) <= radius).select("win", "number")
    repeats = left.join(right, ["h", "n_words"]).where("not (plain and item_plain)").select("win", "number")
    alike = written(alike.union(repeats).distinct(), f"{work}/alike")

    own = cut.select("win", F.explode(shingles(F.col("w"), n)).alias("h")).groupBy("win", "h").agg(F.count("*").alias("c"))
    theirs = of_item.select("number", "item_id", F.explode("s").alias("h")).groupBy("number", "item_id", "h").agg(F.count("*").alias("item_c"))
    common = alike.join(own, "win").join(theirs, ["number", "h"]).groupBy("win", "number", "item_id").agg(F.sum(F.least("c", "item_c")).alias("common"))
    total = lambda size: F.greatest(size - n + 1, F.lit(1))
    found = common.join(cut.select("win", "doc_id", "start", "n_words", total(F.size("w")).alias("own")), "win")
    either = total(F.col("n_words")) + F.col("own") - F.col("common")
    found = found.withColumn("similarity", F.col("common") / either).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", -F.col("start"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.similarity").alias("similarity"), (-F.col("m.col2")).cast("long").alias("at"), F.col("m.n_words").cast("long").alias("n_words"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item.

    All rows of a doc_id go if one of them holds an item; rows with a null doc_id and blank texts stay; an empty
    table, or an empty benchmark, changes nothing; the columns are those that came, whatever their names.
    """
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)

"""Mixing sources to target weights: Pareto order sampling of whole documents by words.

Within a source a document is expected as many times as its relative weight says, at most ``LIMIT`` times: rate =
least(LIMIT, weight * level), the level being such that the expected words are the source's target, so what the limit cuts
off is reshared over the others. Weights are the number of binary digits of a document's size where the caller gives
none: longer documents are drawn more often. Whole copies are certain. What is left, in (0, 1), is the document's inclusion
odds p: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being uniform by a hash of the id, and the least ranks
are taken up to the source's remaining words, the last one only where that comes nearer to the target.

The rank's order is cut into ``CELLS`` intervals whose words are summed (combined before the shuffle), and
the interval that crosses the target is cut again; only documents of the last interval meet in a window. Windows over
sources hold a row a source, those over weights a row a weight of the source (64 at most unless the caller gives others).

Defined results: a null or blank text has size 0 and is taken 0 times in words; texts of any length are counted whole; a
null source is one source, ranked last; repeated rows of a doc_id share their random number and are separate rows, and ties of
rank go by doc_id and size; rows with a null doc_id are ranked by their text; a null weight is 1; an empty table gives an
empty result; extra columns are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelode.llm.common import WORD, table, work_dir, written

WEIGHTS, SHARE, LIMIT = (5, 2, 1), 1.5, 2
CELLS = 1024


def uniform(text_id: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from 52 bits of md5: the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat(text_id, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): shares by weight, cut at ``limit`` times the size, the excess reshared.

    ``sizes``: (source, source_size), a row a source: no more than sources exist meet in the window. The
    sources that end cut are the first by limit over weight; the level of the rest follows from sums.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.array(*[F.lit(w) for w in weights])
    out = sizes.withColumn("w", F.get(pick, (F.row_number().over(by_name) - 1) % n)).withColumn("cap", F.col("source_size") * limit)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("goal", share * F.sum("source_size").over(whole))
    left = F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    out = out.withColumn("level", left / rest).withColumn("cut", F.col("w") * F.col("level") >= F.col("cap"))
    out = out.withColumn("level", F.min(F.when(~F.col("cut"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"])
    return out.select("source", "source_size", F.when(F.col("cut") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def odds(u: Column, p: Column) -> Column:
    return (u / (1.0 - u)) / (p / (1.0 - p))


def levels(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, level): what a weight is to be multiplied by; null where all rates are the limit.

    ``classes``: source, target, weight, words (of all documents of that weight). The weights that end at the limit are
    the source's greatest; the level of the rest follows from sums.
    """
    order = Window.partitionBy("source").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("weight") * F.col("words")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = F.when(rest > 0, (F.col("target") - limit * before) / rest)
    out = classes.withColumn("level", level).withColumn("open", F.col("weight") * F.col("level") < limit)
    return out.groupBy("source").agg(F.max_by("level", F.when(F.col("open"), F.col("weight"))).alias("level"))


def mixed(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): ``copies`` times the document, ``taken`` words."""
    spark = docs.sparkSession
    work = work_dir(spark)
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.length(F.bin(size)).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size"), uniform(key).alias("u"), own.alias("weight")), f"{work}/sized")
    classes = written(sized.groupBy("source", "weight").agg(F.sum("size").alias("words")), f"{work}/classes")
    goals = written(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))), f"{work}/goals")
    of = lambda df: df.select([F.col("source").alias("s"), *[c for c in df.columns if c != "source"]])
    weighed = classes.join(of(goals), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goals = written(goals.join(of(levels(weighed)), F.col("source").eqNullSafe(F.col("s"))).drop("s"), f"{work}/levels")
    # Every document is expected rate times; a source's certain copies leave the rest of the target to the ranks.
    rate = F.when(F.col("source_size") > 0, F.least(F.coalesce(F.col("weight") * F.col("level"), F.lit(float(LIMIT))), F.lit(float(LIMIT)))).otherwise(F.lit(0.0))
    ranked = sized.join(goals, sized["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    ranked = ranked.withColumn("rate", rate).withColumn("certain", F.floor("rate").cast("long"))
    ranked = ranked.withColumn("p", F.col("rate") - F.col("certain")).withColumn("q", F.when((F.col("p") > 0) & (F.col("size") > 0), odds(F.col("u"), F.col("p"))))
    ranked = written(ranked.withColumn("cell", F.least(F.floor(F.col("q") / (1.0 + F.col("q")) * CELLS), F.lit(CELLS - 1)).cast("int")), f"{work}/ranked")

    def crossing(df: DataFrame, keys: list[str], cell: str, start: Column) -> DataFrame:
        """The first cell by key whose running words reach the words left, and the words before it."""
        own = df.groupBy(*keys, cell).agg(F.sum("size").alias("words"), F.max(start).alias("left"))
        run = own.withColumn("upto", F.sum("words").over(Window.partitionBy(*keys).orderBy(cell)))
        hit = run.where(F.col("upto") >= F.col("left")).groupBy(*keys).agg(F.min(F.struct(cell, (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"))).alias("c"))
        return hit.select(*keys, F.col(f"c.{cell}").alias(f"at_{cell}"), F.col("c.left").alias(f"left_{cell}"))

    left = ranked.groupBy("source").agg((F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("left"))
    left = written(left.select(F.col("source").alias("s"), "left"), f"{work}/left")
    open_ranks = ranked.where("q is not null").join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    first = written(crossing(open_ranks.withColumn("name", F.col("source")), ["name"], "cell", F.col("left")), f"{work}/first")
    inside = ranked.where("q is not null").join(first, F.col("source").eqNullSafe(F.col("name")) & (F.col("cell") == F.col("at_cell")))
    within = F.col("q") / (1.0 + F.col("q")) * CELLS - F.col("cell")
    inside = written(inside.withColumn("fine", F.least(F.floor(within * CELLS), F.lit(CELLS - 1)).cast("int")), f"{work}/inside")
    second = written(crossing(inside, ["name"], "fine", F.col("left_cell")), f"{work}/second")
    last = inside.select("name", "fine", "doc_id", "u", "q", "size").join(second.withColumnRenamed("name", "n2"), F.col("name").eqNullSafe(F.col("n2")) & (F.col("fine") == F.col("at_fine")))
    run = F.sum("size").over(Window.partitionBy("name").orderBy("q", "doc_id", "u", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("over", run - F.col("left_fine"))
    # Taken up to the target, and beyond by the one document that crosses it if that ends nearer.
    last = last.where((F.col("over") <= 0) | ((F.col("over") < F.col("size")) & (F.col("over") <= F.col("size") - F.col("over"))))
    ends = written(last.groupBy("name").agg(F.max(F.struct("q", "doc_id", "u", "size")).alias("end")), f"{work}/ends")

    cut = first.join(second.select(F.col("name").alias("n2"), "at_fine"), F.col("name").eqNullSafe(F.col("n2"))).join(ends.select(F.col("name").alias("n3"), "end"), F.col("name").eqNullSafe(F.col("n3")), "left").select("name", "at_cell", "at_fine", "end")
    cut = written(cut, f"{work}/cut")
    final = ranked.join(cut, F.col("source").eqNullSafe(F.col("name")), "left")
    fine = F.least(F.floor(within * CELLS), F.lit(CELLS - 1)).cast("int")
    mine = F.struct("q", "doc_id", "u", "size")
    drawn = F.when(F.col("q").isNull(), F.lit(False)).when(F.col("at_cell").isNull(), F.lit(True))
    drawn = drawn.when(F.col("cell") != F.col("at_cell"), F.col("cell") < F.col("at_cell")).when(fine != F.col("at_fine"), fine < F.col("at_fine"))
    drawn = drawn.otherwise(F.coalesce(mine <= F.col("end"), F.lit(False)))
    copies = F.col("certain") + drawn.cast("long")
    return final.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("copies")


def copies_of(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document of ``docs`` as often as it is drawn; the columns are those that came, whatever their names.

    Blank documents count no words and go, as rows without doc_id do; each of repeated rows is drawn as often as the doc_id is
    drawn most; an empty table stays empty.
    """
    n, k = (f"{c}_{uuid.uuid4().hex}" for c in ("copies", "copy"))
    drawn = mixed(docs).where("copies > 0 and size > 0 and doc_id is not null").groupBy("doc_id").agg(F.max("copies").cast("int").alias(n))
    out = docs.join(drawn, "doc_id").withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n))))
    return out.select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '') || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, source_size * 2 AS cap, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sums),
level AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / w::DOUBLE, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, w * level >= cap AS cut FROM level),
goals AS (
  SELECT source, source_size, CASE WHEN cut OR flat IS NULL THEN CAST(cap AS DOUBLE) ELSE w * flat END AS target
  FROM (SELECT *, first_value(level) OVER (ORDER BY cut, cap / w::DOUBLE, source IS NULL, encode(source)) AS flat FROM levels)),
classes AS (SELECT source, length(bin(size)) AS weight, CAST(sum(size) AS BIGINT) AS words FROM sized GROUP BY ALL),
steps AS (
  SELECT c.source, weight, (target - 2 * coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
    CAST(nullif(sum(weight * words) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS DOUBLE) AS level
  FROM classes c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source WINDOW w AS (PARTITION BY c.source ORDER BY weight DESC)),
pick AS (SELECT source, max_by(level, weight) FILTER (WHERE weight * level < 2) AS level FROM steps GROUP BY source),
ranked AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(coalesce(length(bin(s.size)) * p.level, 2.0::DOUBLE), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source JOIN pick p ON s.source IS NOT DISTINCT FROM p.source),
parts AS (SELECT *, CAST(floor(rate) AS BIGINT) AS certain, rate - floor(rate) AS p FROM ranked),
drawn AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, target - sum(certain * size) OVER (PARTITION BY source) AS remaining
  FROM parts),
run AS (SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id, u, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - remaining AS over FROM drawn)
SELECT doc_id, size, source_size, target,
  CAST(size * (certain + CASE WHEN q IS NOT NULL AND (over <= 0 OR (over < size AND over <= size - over)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
